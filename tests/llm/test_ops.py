"""Each operator against a plain version of its own, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
xxhash = pytest.importorskip("xxhash")

from lodegraph.llm import bpe, decontaminate, html, langid, linededup, pii, queries, simhash, tokencount, topk, warc  # noqa: E402
from lodegraph.llm.common import _ends, connected_components, linked_groups  # noqa: E402

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    letters = lambda k: "".join(chr(97 + int(d)) for d in f"{k:03d}")
    return " ".join(f"w{letters(rng.randrange(vocabulary))}q" for _ in range(n))


def docs_frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOC)


ODD = [None, "", " \n\t ", "a", "x" * 5000, "é ß 你好 🙂", "'s 're  don't\n\n", "word " * 3000]


# Connected components.


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(8, 30)] + [(5, 5), (1, 2), (2, 1)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[j] for j in range(7, 30)} == {7}
    assert got[1] == got[2] == 1
    assert 5 not in got


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("crowded", [False, True])
def test_linked_groups_reach_what_all_pairs_reach(spark, crowded, monkeypatch):
    """Random keys and a random relation that isn't transitive: components are those of all pairs that share a key and are related."""
    import lodegraph.llm.common as common

    monkeypatch.setattr(common, "CROWDED", 0 if crowded else 64)
    rng = random.Random(11)
    rows = [(rng.randrange(12), node) for node in range(120) for _ in range(2)]
    related = {(a, b) for a in range(120) for b in range(a + 1, 120) if rng.random() < 0.03 and a % 3 == b % 3}
    frame = spark.createDataFrame(sorted(related), "a long, b long")
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return common.materialize(pairs.join(frame, ["a", "b"]))

    attributes = spark.range(120).selectExpr("id AS node", "id % 3 AS r")
    split = lambda r: r.selectExpr("key * 3 + node % 3 AS key", "node")
    got = dict(connected_components(linked_groups(spark.createDataFrame(rows, "key long, node long"), attributes, F.col("r_a") == F.col("r_b"), verify, split)).collect())
    keys = {n: {k for k, m in rows if m == n} for n in range(120)}
    label = list(range(120))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in sorted(related):
        if keys[a] & keys[b]:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    assert {n: r for n, r in got.items() if n != r} == {n: find(n) for n in range(120) if find(n) != n}


# 1. Decontamination.


def plain_scan(text, items, n=10):
    ws = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        iw = decontaminate.words_of(body)
        size = min(n, len(iw))
        grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1) if size else ():
            if tuple(ws[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_is_the_plain_scan(spark, block_bytes):
    items = [(1, words(1, 25)), (2, words(2, 10)), (3, "Only Three words"), (4, None), (5, ""), (6, words(1, 14)), (6, words(3, 12))]
    texts = [*ODD, words(9, 30) + ". " + words(1, 25).upper() + "! " + words(8, 5), words(2, 9), "so only, three-words here", words(3, 12) + " " + words(2, 10), words(1, 25) * 2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs_frame(spark, texts).withColumn("n_hit", F.lit("clash")), bench, block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["hit_items"]) == plain_scan(texts[r["doc_id"]], items)
    clean = decontaminate.decontaminate(docs_frame(spark, texts), bench, block_bytes=block_bytes)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in got if not r["n_hit"]}
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs_frame(spark, texts), bench, mode="spans", block_bytes=block_bytes).collect()}
    assert spans[len(ODD)].split() == (words(9, 30) + ". " + "! " + words(8, 5)).split()
    assert spans[0] is None and spans[5] == ODD[5]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.scan(docs_frame(spark, ["a b", None]), none).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["hit_items"]) for r in got] == [(2, 0, []), (0, 0, [])]
    assert decontaminate.scan(docs_frame(spark, []), none).count() == 0


def test_a_benchmark_of_several_measured_blocks(spark):
    items = [(i, words(i, 60, 5000)) for i in range(90)] + [(90, None), (91, "")]
    texts = [words(1000 + i, 80, 5000) + " " + items[i][1] for i in range(0, 90, 9)] + [words(2000 + i, 80, 5000) for i in range(5)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, hit_mask long, __mask string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.Index([x for x in items], 10)
    got = decontaminate.scan(frame, bench, index_bytes=whole.nbytes() // 3)
    for r in got.collect():
        hit, found = whole.scan(texts[r["doc_id"]])
        assert (r["n_hit"], r["hit_items"], r["__mask"]) == (int(hit.sum()), sorted(found), "x")
    assert sum(bool(r["hit_items"]) for r in got.collect()) == 10
    # Flat arrays: some tens of bytes a word, whatever the item.
    assert whole.nbytes() < 300 * sum(len(t.split()) for _, t in items if t)


def test_equal_benchmark_rows_end_and_count_once(spark):
    """However small an index may be: a block of one distinct row isn't split."""
    items = [(1, words(1, 40)), (1, words(1, 40)), (2, words(2, 40)), (2, words(2, 40)), (None, words(1, 40)), (3, words(1, 40))]
    frame = docs_frame(spark, ["x " + words(1, 40), words(2, 40), words(3, 40)])
    got = decontaminate.scan(frame, spark.createDataFrame(items, "item_id long, text string"), index_bytes=200).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["hit_items"]) for r in got] == [(40, [1, 3]), (40, [2]), (0, [])]


def test_masks_of_many_blocks_are_united(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STAGE_BLOCKS", 1)
    items = [(i, words(i, 12)) for i in range(5)]
    frame = docs_frame(spark, [" ".join(t for _, t in items), words(9, 30)])
    got = decontaminate.scan(frame, spark.createDataFrame(items, "item_id long, text string"), index_bytes=200).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["hit_items"]) for r in got] == [(60, [0, 1, 2, 3, 4]), (0, [])]


# 2. Byte-level BPE.


def test_bpe_is_the_library_and_comes_back(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoder(path, public_tokenizers.PATTERN)
    long_text = (words(4, 20_000) + "\n\n  x\x1c y") * 2
    texts = [*ODD, long_text, "ab1" * 40_000, " " * 70_000 + "end", "<|endoftext|>"]
    df = bpe.decode(bpe.encode(docs_frame(spark, texts), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == enc.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_pieces_join_to_the_text():
    for text in [words(1, 5000), "x" * 1000, " y" * 1000, "a\x1cb " * 500]:
        assert "".join(bpe.split_safely(text, 64)) == text


def test_bpe_of_odd_tables(spark):
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = spark.createDataFrame([(1, "a b", "x", 5)] * 2 + [(None, None, None, None)], "doc_id long, text string, token_ids string, decoded long")
    got = bpe.decode(bpe.encode(rows, ranks, pattern), ranks, pattern).collect()
    assert [bytes(r["decoded"]) for r in sorted(got, key=lambda r: r["doc_id"] or 0)] == [b"", b"a b", b"a b"]
    assert bpe.decode(bpe.encode(rows.limit(0), ranks, pattern), ranks, pattern).count() == 0


# 3. Line dedup.


def edit_similar(a, b, least=0.8):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1] <= int(max(len(a), len(b)) * (1 - least) + 1e-9)


def plain_norm(line):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line.lower()).strip() or " ".join(line.split())


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    word = lambda k: "".join(random.Random(k * 7 + 1).choices("abcdefghijklmnopqrstuvwxyzé", k=2 + k % 7))
    return " ".join(word(rng.randrange(vocabulary)) for _ in range(n))


def linked(x, y):
    """Whether two normalised lines share a key and are alike enough, told plainly."""
    return x[1] & y[1] and len(x[2] & y[2]) >= linededup.OVERLAP * max(len(x[2]), len(y[2])) and (x[0] ^ y[0]).bit_count() <= linededup.RADIUS and any((x[0] ^ y[0]) >> 8 * j & 255 == 0 for j in range(8))


def plain_keys(body):
    ws = list(body) if regex.match(r"\p{Han}", body) else body.split(" ")
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(ws)]
    fp = sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    bits = {("bits", a, b, fp >> 21 * a & 2097151, fp >> 21 * b & 2097151) for a in range(3) for b in range(a)}
    return fp, bits | set(regex.findall(linededup._BLOCK, " ".join(ws))), set(ws)


def plain_line_dedup(texts, candidates=True):
    """Every pair of different normalised lines is compared, by the operator's keys or by edit similarity alone; a line is one unit here."""
    places = {}
    for d, t in enumerate(texts):
        for k, line in enumerate(t.split("\n") if t is not None else ()):
            if plain_norm(line):
                places.setdefault(plain_norm(line), []).append((d, k))
    names = list(places)
    keys = {x: plain_keys(x) for x in names}
    label = {x: x for x in names}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(names):
        for y in names[:i]:
            if find(x) != find(y) and (not candidates or linked(keys[x], keys[y])) and edit_similar(x, y):
                label[find(x)] = find(y)
    groups = {}
    for x in names:
        groups.setdefault(find(x), []).extend(places[x])
    gone = {p for g in groups.values() for p in g if p != min(g)}
    out = []
    for d, t in enumerate(texts):
        kept = None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (d, k) not in gone)
        out.append((kept, sum(1 for x in gone if x[0] == d)))
    return out


def deduped(spark, texts):
    rows = linededup.dedup_lines(docs_frame(spark, texts)).collect()
    return [(r["text"], r["n_removed"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_lines_exact_near_and_kept(spark):
    base = [prose(i, 30) for i in range(40)]
    near = base[0].replace(base[0].split()[3], "changed", 1)
    long_line = " ".join(base[i] for i in range(10, 30))
    texts = [
        "\n".join([base[0], "short line", base[1]]), "\n".join([base[0].upper() + "!", "short line", base[2]]), "\n".join([base[3], base[1] + " 123", ""]),
        None, "", "\n\n", near + "\n" + base[5], base[1] + "\n" + base[2], long_line, long_line + "\n" + base[30],
    ]
    got = deduped(spark, texts)
    assert len(got) == len(texts)
    assert got[0] == (texts[0], 0) and got[1] == (base[2], 2) and got[2] == (base[3] + "\n", 1)
    assert [got[i][0] for i in (3, 4, 5)] == [None, "", "\n\n"]
    assert got[6] == (base[5], 1) and got[7] == ("", 2) and got[8] == (long_line, 0) and got[9][0] == base[30]
    staged = {r["doc_id"] for r in linededup.dedup_stage(docs_frame(spark, texts)).collect()}
    assert staged == set(range(10)) - {7}


def test_line_dedup_is_that_of_all_pairs(spark):
    """The whole query, against edit similarities of all pairs of lines: near copies with a few changed words, lines in another order
    of words (of one fingerprint), numbers that differ, short lines, signs, and lines of a script without blanks."""
    rng = random.Random(5)
    texts = []
    for i in range(70):
        ws = prose(i % 10, 24, 300).split()
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(24)] = "other"
        lines = [" ".join(ws)]
        if i % 5 == 0:
            lines.append(" ".join(reversed(ws)))
        lines += [f"reading of station {i % 4 * 1111} was {i % 7} degrees", "---", rng.choice(["Les.", "les", "Les!"]), "今天天气很好我们一起去公园散步吧" + "好" * (i % 2)]
        texts.append("\n".join(lines))
    texts += [None, "", "\n \n"]
    got = deduped(spark, texts)
    assert got == plain_line_dedup(texts)
    # Against edit similarity alone: only short lines lose links.
    assert sum(n for _, n in got) >= 0.9 * sum(n for _, n in plain_line_dedup(texts, False))


def test_classes_of_one_fingerprint_keep_their_links(spark):
    """Reversed line, line, and line with two adjacent words swapped: all three have one fingerprint, the last two are near copies."""
    texts = []
    for i in range(8):
        ws = prose(100 + i, 30).split()
        swapped = [*ws[:4], ws[5], ws[4], *ws[6:]]
        texts += [" ".join(reversed(ws)), " ".join(ws), " ".join(swapped)]
    got = deduped(spark, texts)
    assert [n for _, n in got] == [0, 0, 1] * 8


def test_numbers_count_and_equal_rows_keep_one_occurrence(spark):
    far = ["station 17 reads 4 of north", "station 998877 reads 3141592 of north"]
    assert deduped(spark, far) == [(x, 0) for x in far]
    chinese = "今天天气很好我们一起去公园散步吧" * 4
    assert deduped(spark, [chinese] * 3) == [(chinese, 0), ("", 1), ("", 1)]
    rows = spark.createDataFrame([(1, "one line\n\nother words here", 5, 6)] * 3 + [(None, "one line", 7, 8)], "doc_id long, text string, n_removed long, row long")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in linededup.dedup_lines(rows).collect())
    assert got == [(0, "one line", 0), (1, "", 2), (1, "", 2), (1, "\nother words here", 1)]
    assert linededup.dedup_lines(rows).columns == ["doc_id", "text", "row", "n_removed"]
    assert linededup.dedup_stage(rows).columns == rows.columns
    assert linededup.dedup_lines(rows.limit(0)).count() == 0


def test_a_dense_group_of_lines_costs_its_rows_and_no_pairs(spark):
    base = prose(7, 60)
    texts = []
    for i in range(300):
        ws = base.split()
        ws[i % 60] = f"v{i}"
        texts.append(" ".join(ws))
    units = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "unit long, class long, body string")
    roots = {r["root"] for r in linededup.similar_classes(units, units).collect()}
    assert roots == {0}
    keys = linededup._keys(units, linededup.fingerprints(units)).withColumnRenamed("class", "node")
    assert _ends(keys).count() < 10 * 2 * len(texts)


def test_every_pair_within_the_thresholds_is_linked(spark):
    """Fingerprints of one to RADIUS differing bits without a common key, short texts, and sizes of the greatest ratio: every_pair loses none."""
    rng = random.Random(11)
    texts = []
    for i in range(60):
        ws = prose(3000 + i, rng.choice([2, 4, 7, 10, 25, 40]), 5000).split()
        other = list(ws)
        for k in range(1 + len(ws) // 6):
            other[(k * 6 + i) % len(ws)] += "xy"
        texts += [" ".join(ws), " ".join(other)]
    texts += ["a" * 8, "a" * 10, "b" * 80, "b" * 100, "c" * 7, "c" * 9, "x", "y"]
    bodies = sorted({plain_norm(t) for t in texts})
    prints, label = [plain_keys(b) for b in bodies], {b: b for b in bodies}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    unkeyed = 0
    for i, x in enumerate(bodies):
        for j in range(i):
            y = bodies[j]
            near = max(len(x), len(y)) <= linededup.SHORT or (prints[i][0] ^ prints[j][0]).bit_count() <= linededup.RADIUS
            if near and edit_similar(x, y):
                unkeyed += not linked(prints[i], prints[j])
                label[find(x)] = find(y)
    assert unkeyed > 10
    units = spark.createDataFrame([(i, i, b) for i, b in enumerate(bodies)], "unit long, class long, body string")
    got = {r["class"]: r["root"] for r in linededup.similar_classes(units, units, every_pair=True).collect()}
    groups = {}
    for i, b in enumerate(bodies):
        groups.setdefault(find(b), []).append(i)
    assert got == {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


def test_tiles_compare_every_pair_once(spark):
    """Forty tiles of a few rows in one band, and others of all sizes: no tile grows with the table, no pair is lost or met twice, none of one root comes."""
    rng = random.Random(12)
    rows = []
    for i in range(500):
        size = 400 if i < 200 else rng.randrange(60, 500)
        sign = rng.choice([0, 2**62 - 1, 0x5555555555555555 >> 1]) ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(11)))
        rows.append((i * 7919 - 10**6, (i if i % 3 else i // 20 * 20) * 7919 - 10**6, size, sign))
    frame = spark.createDataFrame(rows, "node long, root long, size int, fp long")
    met = linededup._met(frame, "fp", F.lit(linededup.RADIUS), lambda of: F.greatest(*of("size")) > 64, 0.8, tile=5)
    want = []
    for x in rows:
        for y in rows:
            alike = (x[3] ^ y[3]).bit_count() <= linededup.RADIUS and min(x[2], y[2]) >= max(x[2], y[2]) * 0.8 - 1e-9 and max(x[2], y[2]) > 64
            if x[0] < y[0] and x[1] != y[1] and alike:
                want.append((x[0], y[0]))
    assert len(want) > 1000
    assert sorted((r["a"], r["b"]) for r in met.collect()) == sorted(want)


def test_components_grow_by_further_edges(spark):
    rng = random.Random(13)
    first, more = ([(rng.randrange(300), rng.randrange(300)) for _ in range(n)] for n in (90, 60))
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    got = linededup._extended(linededup.connected_components(frame(first)), frame(more)).collect()
    want = linededup.connected_components(frame(first + more)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert linededup._extended(linededup.connected_components(frame(first)), frame(first).limit(0)).count() == linededup.connected_components(frame(first)).count()


def test_near_lines_are_found(spark):
    """Recall of linked pairs against edit similarity alone, without the fingerprint: a word in twelve replaced, dropped or added."""
    rng = random.Random(9)
    texts, pairs = [], 0
    for i in range(200):
        ws = prose(1000 + i, rng.randrange(15, 70), 5000).split()
        other = []
        for w in ws:
            kind = rng.random()
            other += [w] if kind > 0.08 else [["new", "word"][rng.randrange(2)] + str(rng.randrange(99))] if kind > 0.05 else [w, "more"] if kind > 0.025 else []
        if edit_similar(" ".join(ws), " ".join(other)):
            texts += [" ".join(ws), " ".join(other)]
            pairs += 1
    removed = sum(n for _, n in deduped(spark, texts))
    assert pairs > 100 and removed >= 0.85 * pairs


# 4. SimHash.


def plain_fingerprint(text, n=3):
    ws = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("tile", [4096, 3])
def test_fingerprint_links_reach_what_all_pairs_reach(spark, tile):
    rng = random.Random(3)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for _ in range(rng.randrange(3)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints) + [0, (1 << 64) - 1]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=tile)
    got = dict(connected_components(links).collect())
    label = {p: p for p in signed}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, p in enumerate(signed):
        for q in signed[:i]:
            if ((p ^ q) & ((1 << 64) - 1)).bit_count() <= 2:
                a, b = find(p), find(q)
                label[max(a, b)] = min(a, b)
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_components_with_odd_rows(spark):
    texts = [*ODD, words(1, 200), words(1, 200), words(1, 200) + " tail", words(2, 200)]
    df = docs_frame(spark, texts).unionAll(docs_frame(spark, texts[-1:]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = simhash.components(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] is not None:
            assert r["simhash"] & ((1 << 64) - 1) == plain_fingerprint(texts[r["doc_id"]])
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[9] == 8 and by[None] == by[11]
    kept = simhash.drop_near_duplicates(df).collect()
    assert sum(r["doc_id"] is None for r in kept) == 1 and {r["doc_id"] for r in kept if r["doc_id"] is not None} == {c for c in by.values()}
    assert simhash.components(docs_frame(spark, [])).count() == 0


def test_near_documents_are_those_of_all_pairs_by_shingle_similarity(spark):
    rng = random.Random(9)
    texts = [None, "", "one two", "one two"]
    for i in range(40):
        ws = words(i % 8, rng.choice([6, 40, 300])).split()
        for _ in range(rng.randrange(1 + len(ws) // 20)):
            ws[rng.randrange(len(ws))] = f"other{rng.randrange(99)}"
        texts.append("the same head for all of these texts " * (i % 3) + " ".join(ws))
    sets = [{tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} for ws in ((t or "").split() for t in texts)]
    label = list(range(len(texts)))
    missed = 0
    for i in range(len(texts)):
        for j in range(i):
            a, b = plain_fingerprint(texts[i], 5), plain_fingerprint(texts[j], 5)
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
            missed += alike and (a ^ b).bit_count() > 2
            if alike or (a ^ b).bit_count() <= 2:
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    assert missed > 5
    got = simhash.components(docs_frame(spark, texts), n=5, least=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))
    kept = simhash.drop_near_duplicates(docs_frame(spark, texts), n=5, least=0.8).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label))


def test_a_word_repeated_often_does_not_hide_a_similar_text(spark):
    """Fingerprints count repeats and sets don't: a copy with one word two thousand times more is far by the one, near by the other."""
    base = words(5, 400)
    texts = [base, base + " again" * 2000, words(6, 400), "same " * 40, "same " * 900]
    prints = [plain_fingerprint(t, 5) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() > 22
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(docs_frame(spark, texts), n=5, least=0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


# 5. Revisits.


@pytest.mark.parametrize("slice_rows", [50_000, 3])
def test_revisits(spark, slice_rows):
    kind = "record_id long, url string, ts long, warc_type string, status int, etag string, last_modified string, headers map<string,string>"
    rows = [
        (1, "http://www.A.com:80/x/", 1, "response", 200, '"1"', None, {"etag": '"1"', "content-type": "h"}),
        (2, "https://a.com/x#f", 2, "revisit", 304, 'W/"1"', None, {"date": "d2", "content-length": "9"}),
        (3, "http://a.com/x", 3, "response", 404, '"9"', None, {}),
        (4, "http://a.com/x", 4, "revisit", 304, '"2"', None, {}),
        (5, "http://a.com/y?b=2&a=1", 5, "revisit", 304, '"1"', None, None),
        (6, "http://a.com/z", 6, "response", 200, None, "m", None),
        (7, "http://a.com/z", 7, "revisit", 304, '"1"', "m", None),
        (8, "http://a.com/z", 8, "revisit", 304, '"1"', None, None),
        (9, None, None, "revisit", 304, None, None, None),
        (10, "http://a.com/x", 40, "response", 200, '"2"', None, {"k": "v"}),
        (11, "http://a.com/x", 41, "revisit", 304, '"2"', None, {"etag": '"2"'}),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, kind), slice_rows).collect()}
    assert {k: (r["outcome"], r["response_id"]) for k, r in got.items()} == {2: ("resolved", 1), 4: ("mismatch", None), 5: ("no_response", None), 7: ("resolved", 6), 8: ("unverified", None), 9: ("no_response", None), 11: ("resolved", 10)}
    assert got[2]["headers"] == {"etag": '"1"', "content-type": "h", "date": "d2"}
    assert got[11]["headers"] == {"k": "v", "etag": '"2"'}
    assert warc.resolve_revisits(spark.createDataFrame([], kind)).count() == 0


def test_revisits_of_a_hot_url_ties_and_repeats(spark):
    """One URL with most rows, equal times, repeated rows, null times and a column that clashes, against a plain search."""
    rng = random.Random(7)
    kind = "record_id long, url string, ts long, warc_type string, status int, etag string, last_modified string, headers map<string,string>, slice long, canonical string"
    rows = []
    for i in range(600):
        url = "http://hot.com/" if rng.random() < 0.7 else f"http://h{i % 5}.com/"
        kind_ = "revisit" if rng.random() < 0.4 else "response"
        status = 304 if kind_ == "revisit" else rng.choice([200, 200, 404])
        rows.append((i, url, rng.choice([None, *range(40)]), kind_, status, f'"{rng.randrange(3)}"', None, {"k": str(i)}, 1, "c"))
    rows += rows[:20]
    got = warc.resolve_revisits(spark.createDataFrame(rows, kind), 30).collect()
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    want = []
    for r in rows:
        if r[3] == "revisit":
            earlier = [p for p in rows if p[1] == r[1] and p[3] == "response" and p[4] == 200 and key(p) < key(r)]
            best = max(earlier, key=key, default=None)
            want.append((r[0], "no_response" if not best else "resolved" if best[5] == r[5] else "mismatch", best[0] if best and best[5] == r[5] else None))
    assert sorted(map(str, want)) == sorted(str((r["record_id"], r["outcome"], r["response_id"])) for r in got)


def test_payload_comes_with_the_response(spark):
    resolved = spark.createDataFrame([(2, 1), (3, None)], "record_id long, response_id long")
    got = warc.with_payload(resolved, spark.createDataFrame([(1, "body")], "record_id long, payload string")).collect()
    assert {r["record_id"]: r["payload"] for r in got} == {2: "body", 3: None}


# 6. Top-k.


@pytest.mark.parametrize(("row_block", "query_block"), [(1 << 16, 2048), (17, 3)])
def test_top_k_is_brute_force(spark, row_block, query_block):
    """Nulls, empty vectors, vectors of another length, huge components, repeated ids and a query's own copies."""
    import math

    rng = np.random.default_rng(1)
    vectors = [rng.integers(-3, 4, 6).astype(float) / 8 for _ in range(90)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(200, None), (201, []), (220, []), (202, [float("nan")] * 6), (203, [None] * 6), (260, [1.0, 2.0]), (240, [0.0] * 6)]
    rows += [(7, vectors[3].tolist()), *[(40, vectors[40].tolist())] * 6, (301, [600000.0, 0.0, 0.0, 0.0, 0.0, 0.5]), (320, [-1.5e12, 0.0, 1.0, 0.0, 0.0, 0.0]), (340, [3e200, 0.0, 0.0, 0.0, 0.0, 1.0]), (204, [float("inf")] * 6)]
    rows += [(360, [-1e-20, -0.0, 1e300, 0.0, 1e-20, 0.5]), (361, [64.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (380, [64.0, 64.0, 0.0, 0.0, 64.0, 0.0]), (362, [-1e-20, -0.0, 0.0, 0.0, 1e-20, 0.0])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, v long")
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=5, row_block=row_block, query_block=query_block).collect()
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    limit = (1 << 63) - 1
    for q in {i for i, _ in good if i % 20 == 0}:
        v = min(w for i, w in good if i == q)
        best = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(w, v, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


# 7. Token counts.


def test_counts_are_the_library_s(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["'", "'s", "'re", "'ll", "r", "v", "l", "e", "the", " ", "  ", "\n", "\t", "　", "12", "é", "你好", "!", "<|endoftext|>", "🙂", "\x1c"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)), "a" * 3000, " " * 3000 + "x"]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs_frame(spark, texts), path).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_counts_of_odd_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(1, "a b", 5, 6)] * 3 + [(None, None, None, None), (2, "<|endoftext|> x" * 9000, 7, 8)], "doc_id long, text string, n_tokens long, piece long")
    got = tokencount.count_tokens(rows, path)
    assert got.count() == 5 and sorted(got.columns) == sorted(rows.columns)
    assert sorted(r["piece"] or 0 for r in got.collect()) == [0, 6, 6, 6, 8]
    assert len({r["n_tokens"] for r in got.where("doc_id = 1").collect()}) == 1 and got.where("text IS NULL").first()["n_tokens"] == 0
    assert tokencount.count_tokens(rows.limit(0), path).count() == 0


# 8. HTML.


def test_blocks_and_zones():
    page = '<html><body><nav><li>menu<li>two</nav><div class="ad">buy</div><article><h1>T &amp; &eacute;</h1><p>one<br>two<p><b>three</b>four<div class="comments"><p>reader</div></article><footer>f</footer><script>x("<p>")</script></body>'
    assert [t for z, t in html.blocks_of(page) if z == html.MAIN] == ["T & é", "one two", "threefour"]
    assert html.blocks_of(None) == html.blocks_of("") == html.blocks_of("<p> </p><!-- x -->") == []


def test_weak_marks_in_an_article_drop_nothing_alone():
    inside = '<article><section class="related-work">a</section><section id="search-methods">b</section><p class="share-prices">c</p><p class="notice">d</p><div class="ad-box">e</div><ul class="comment-list"><li>f</ul><form>g</form><nav>h</nav></article>'
    assert dict((t, z) for z, t in html.blocks_of(inside)) == dict(zip("abcdefgh", [html.SOFT] * 4 + [html.OUT] * 4, strict=True))
    assert html.decide(html.blocks_of(inside), [])[0] == "a\nb\nc\nd"


def site(seed, n, marked):
    """Pages of one host: a menu, a notice and a footer that repeat, articles that don't; and what their text is."""
    rng = random.Random(seed)
    menu, notice, end = "".join(f"<li><a>{w}</a></li>" for w in words(seed, 8).split()), words(seed + 1, 14), words(seed + 2, 9)
    pages, want = [], []
    for i in range(n):
        body = [words(seed + 10 + i * 7 + k, rng.randrange(4, 60)) for k in range(rng.randrange(1, 4))]
        inner = "".join(f"<p>{b}</p>" for b in body)
        top = f"<nav>{menu}</nav>" if marked else f"<ul>{menu}</ul>"
        middle = f'<article><p class="notice">{notice}</p>{inner}</article>' if marked else f"<div>{notice}</div>{inner}"
        pages.append(f"<body>{top}{middle}<div>{end}</div></body>")
        want.append("\n".join(body))
    return pages, want


@pytest.mark.parametrize("marked", [False, True])
def test_boilerplate_is_what_different_pages_of_a_host_repeat(spark, marked):
    pages, want = site(3, 12, marked)
    copies = [f"<div>{words(77, 50)}</div><div>{words(78, 20)}</div>"] * 4
    rows = [(i, f"https://h.example/{i}", x) for i, x in enumerate(pages)] + [(100 + i, "https://copies.example/x", x) for i, x in enumerate(copies)]
    rows += [(50, "https://other.example/1", pages[0]), (51, "https://h.example/n", None), (52, None, "<p>alone</p>"), (52, None, "<p>alone</p>"), (53, "", "<p>" + "long " * 60000)]
    frame = spark.createDataFrame([(*x, 1, "b") for x in rows], "page_id long, url string, html string, host long, blocks string")
    found = html.extract(frame).collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and [got[i] for i in range(12)] == want
    assert all(got[100 + i] == words(77, 50) + "\n" + words(78, 20) for i in range(4))
    assert got[50].count("\n") > want[0].count("\n") and got[51] == "" and got[52] == "alone" and len(got[53]) == 5 * 60000 - 1
    assert all(r["by_repeats"] > 0 and not r["by_markup"] for r in found if r["page_id"] < 12)
    assert html.extract(frame.limit(0)).count() == 0


def test_extract_is_the_plain_count_of_repeats(spark):
    """The whole operator against windows counted in a dictionary, on sf0.01."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["page_id"], r["url"].split("/")[2].lower().split(":")[0] if r["url"] else "", html.blocks_of(r["html"])) for r in pages.collect()]
    token = lambda blocks: [w for z, t in blocks if z != html.MAIN for w in t.lower().split(" ")]
    held = {}
    for _, host, blocks in rows:
        ws, longest = token(blocks), max((t for _, t in blocks), key=len, default="")
        for i in range(len(ws) - html.MIN_TOKENS + 1):
            held.setdefault((host, *ws[i : i + html.MIN_TOKENS]), set()).add(longest)
    want = {}
    for page_id, host, blocks in rows:
        ws = token(blocks)
        want[page_id] = html.decide(blocks, [i for i in range(len(ws) - html.MIN_TOKENS + 1) if len(held[(host, *ws[i : i + html.MIN_TOKENS])]) >= html.MIN_PAGES])
    got = {r["page_id"]: (r["text"], r["runs"], r["by_repeats"], r["by_markup"], r["kept"]) for r in html.extract(pages).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 0


def test_suffix_array_and_windows():
    rng = np.random.default_rng(0)
    for _ in range(20):
        streams = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(5)]
        got = {(k, at): pages for k, at, pages, _ in html.repeated_windows(streams, 3)}
        grams = {}
        for k, s in enumerate(streams):
            for i in range(len(s) - 2):
                grams.setdefault(tuple(s[i : i + 3]), set()).add(k)
        assert got == {(k, i): len(grams[tuple(s[i : i + 3])]) for k, s in enumerate(streams) for i in range(len(s) - 2)}


# 9. PII.

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    import re

    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                ok = 16 <= len(digits) <= 19 and luhn % 10 == 0
            else:
                ok = kind == "email" or 8 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns(spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.z", ".", "com", "_", "1.2.3.4", "255", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-9999", "+", " ", "-", "12", "é", "🙂", "9" * 17, "\n"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)), "4111 1111 1111 1111 é x@y.z_q@w.de", "9" * 5000 + "@" + "a" * 5000, "1" * 4000 + "." * 5]
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs_frame(spark, texts)).collect()}
    order = list(pii.KINDS)
    for i, t in enumerate(texts):
        spans = [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]]
        assert spans == plain_spans(t), t
        assert [(order.index(s["kind"]), s["start"]) for s in got[i]] == sorted((order.index(s["kind"]), s["start"]) for s in got[i])


def test_many_matches_are_where_the_pattern_finds_them(spark):
    text = " ".join(f"é{i}@a.io" if i % 3 else "x" * (i % 50) for i in range(2000))
    row = pii.find(spark.createDataFrame([(1, text, 2, 3), (1, text, 2, 3)], "doc_id long, text string, spans long, kind long")).collect()
    assert len(row) == 2
    for r in row:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == plain_spans(text)
    assert pii.find(docs_frame(spark, [])).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(0, "é write to a.b@c.org now", 5), (1, None, 6), (2, "clean", 7), (2, "clean", 7), (2, "at 1.2.3.4", 7)], "doc_id long, text string, all long")
    got = sorted((r["doc_id"], str(r["text"]), r["all"]) for r in pii.redact(df).collect())
    assert got == [(0, "é write to [EMAIL] now", 5), (1, "None", 6), (2, "at [IP]", 7), (2, "clean", 7), (2, "clean", 7)]


def plain_em(patterns, prior, true, false, weight, rounds):
    """Expectation-maximisation told one span at a time."""
    start = (prior, [list(x) for x in true], [list(x) for x in false])
    spans = [v for v, c in patterns for _ in range(c)]
    for _ in range(rounds):
        post = []
        for v in spans:
            t, f = prior, 1 - prior
            for i, x in enumerate(v):
                t, f = t * true[i][x], f * false[i][x]
            post.append(t / (t + f))
        total = sum(post)
        true = [[(sum(p for p, v in zip(post, spans, strict=True) if v[i] == x) + weight * start[1][i][x]) / (total + weight) for x in range(3)] for i in range(len(true))]
        false = [[(sum(1 - p for p, v in zip(post, spans, strict=True) if v[i] == x) + weight * start[2][i][x]) / (len(spans) - total + weight) for x in range(3)] for i in range(len(false))]
        for i in (list(pii.LABELERS).index(x) for x in pii.ANCHORED):
            true[i], false[i] = start[1][i], start[2][i]
        prior = (total + weight * start[0]) / (len(spans) + weight)
    return prior, true, false


def drawn_votes(n, seed=1):
    """Votes of six labelers on spans of which two in five are true: two good ones, three fair ones, and one that guesses."""
    rng, counts = random.Random(seed), {}
    for _ in range(n):
        true = rng.random() < 0.4
        votes = tuple(0 if rng.random() < 0.2 else 2 if (rng.random() < (right if i < 5 else 0.5)) == (true if i < 5 else True) else 1 for i, right in enumerate((0.95, 0.9, 0.75, 0.75, 0.8, 0.5)))
        counts[votes] = counts.get(votes, 0) + 1
    return sorted(counts.items())


def test_em_is_the_plain_one_and_tells_good_labelers_from_guessing_ones():
    small = drawn_votes(150)
    guess = pii.first_guess()
    model = pii.em(small, rounds=20)
    prior, true, false = plain_em(small, guess.prior, guess.true.tolist(), guess.false.tolist(), pii.POOLED, 20)
    assert abs(model.prior - prior) < 1e-6 and np.allclose(model.true, true) and np.allclose(model.false, false)
    large = pii.em(drawn_votes(5000))
    assert abs(large.prior - 0.4) < 0.05
    assert large.true[0][2] > 0.65 and large.false[0][1] > 0.65 and abs(large.true[5][2] - large.false[5][2]) < 0.08


def test_added_spans_are_those_of_the_plain_votes(spark):
    """Planted spans: right ones in wider forms and secrets are found, wrong ones that look alike are left."""
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    right, wrong, clean = [], [], [words(i, 30) for i in range(100)]
    number = lambda: rng.choice("456") + digits(15)
    luhn = lambda t: sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(t))) % 10 == 0
    cards = [number() for _ in range(900)]
    right += [f"paid {c} then" for c in cards if luhn(c)]
    wrong += [f"thing {c} then" for c in cards if not luhn(c)][:90]
    for _ in range(60):
        right += [f'his token = "{hexes(40)}" then', f"mail me: joe.{digits(2)} (at) post.org please", f"call phone (415) 555-{digits(4)} today"]
        wrong += [f"version 3.{rng.randrange(300, 999)}.{digits(2)}.7000 of it", f"order {digits(13)}x of it", f"in file run_{digits(3)}_of_the_long_name it"]
    texts = right + wrong + clean
    got = {r["doc_id"]: r for r in pii.find(docs_frame(spark, texts)).collect()}
    caught = sum(bool(got[i]["spans"]) for i in range(len(right)))
    false = sum(bool(got[i]["spans"]) for i in range(len(right), len(texts)))
    assert caught >= 0.9 * len(right) and false <= 0.05 * (len(wrong) + len(clean))
    assert sum(r["n_rejected"] for r in got.values()) > 0
    # The same decisions from the vote table, the reliabilities and the weights, told in Python.
    spans = pii.spans_of(docs_frame(spark, texts).select("doc_id", "text"))
    weights = pii.train(pii.vote_table(spans))
    for k in pii.KINDS:
        rows = spans.select("doc_id", F.explode(f"loose_{k}").alias("x")).select("doc_id", "x.start", *pii.votes_on(F.col("x"), k)).collect()
        want = {(r["doc_id"], r["start"]) for r in rows if pii.features(np.array([r[2:]]))[0] @ weights[k] >= np.log(9)}
        assert want == {(i, s["start"]) for i, r in got.items() for s in r["spans"] if s["kind"] == k and not s["base"]}


# 10. Language identification.


def test_language_of_odd_rows_and_of_ties(spark):
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate([("the house of the lord " * 5, "en"), ("la casa de la mujer " * 5, "es")] * 40)] + [(900, "½ ² ① ៣", "en", 2), (901, None, "en", 2), (902, "", None, 2), (902, "", None, 2), (903, "the " * 50000, None, 2)], "doc_id long, text string, lang string, lang_pred long")
    got = langid.identify(docs).collect()
    assert len(got) == docs.count() and docs.columns[:3] == ["doc_id", "text", "lang"]
    assert {(r["lang_pred"], r["score"]) for r in got if 900 <= r["doc_id"] <= 902} == {("und", 0.0)}
    assert {r["lang_pred"] for r in got if r["doc_id"] == 903} < {"en", "es"}
    empty = langid.identify(docs.limit(0))
    assert empty.count() == 0
    even = langid.ByteCNN(["aa", "bb"])
    even.p["out"][:], even.p["bias"][:] = 0, 0
    assert even.predict(["some text"]) == [("aa", 0.5)]


def test_training_sample_has_the_smallest_hashes_whatever_the_counts(spark):
    rng = random.Random(2)
    rows = [(lang, rng.randrange(-(2**63), 2**63), f"p{i}") for i in range(3000) for lang in (("a",) if i % 10 else ("a", "b"))] + [("c", 5, "same")] * 4000 + [("c", -(2**63) + 9, "other")]
    got = langid._smallest(spark.createDataFrame(rows, "lang string, h long, piece string"), 50)
    want = sorted((h, p, x) for x in "abc" for h, p in sorted({(h, p) for y, h, p in rows if y == x})[:50])
    assert list(zip(got["h"], got["piece"], got["lang"], strict=True)) == want


def test_language_model_learns_and_repeats(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    extra = docs_frame(spark, [None, "", "123 !!"]).withColumn("doc_id", F.col("doc_id") + 10**6)
    got = langid.identify(docs.unionByName(extra)).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 10**6} == {"und"}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 10**6]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    model = langid.fit(docs)
    batch = np.random.default_rng(0).integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(model.forward(batch), model.apply(batch, model.tables()), atol=1e-5)
    assert langid.fit(docs.where("false")) is None
    again = langid.fit(docs)
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)


# The queries and the pipeline.


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, DATA).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_keeps_columns_and_takes_effect(spark):
    import corpus_pipeline

    docs = queries.table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "byte_bpe":
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0
    assert docs.where(~F.col("round_trip")).count() == 0
    assert docs.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, number):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names, and an empty table."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[number]
    kind = DOC + ", n_removed long, score double, lang_pred string, hit_items long, simhash long, k1 long, row long, token_ids string"
    extra = (1, 0.5, "x", 2, 3, 4, 5, "t")
    base = [words(i, 40) for i in range(6)]
    rows = [(i, t, "en", "s", 1, *extra) for i, t in enumerate([*base, None, "", " \n ", "word " * 40000])]
    rows += [(3, base[3], "en", "s", 1, *extra), (4, words(99, 50), None, None, None, *extra), (None, words(98, 50), "en", "s", 1, *extra), (None, None, *[None] * 11)]
    frame = spark.createDataFrame(rows, kind)
    out = stage(spark, frame, DATA)
    got = out.collect()
    if name == "byte_bpe":
        assert len(got) == len(rows)
        assert all(r["round_trip"] for r in got)
    else:
        assert out.columns == frame.columns
        assert {r["n_removed"] for r in got} <= {1, None} and {r["token_ids"] for r in got} <= {"t", None}
        assert base[0] in {r["text"] for r in got} or name == "language_id"
    assert stage(spark, frame.limit(0), DATA).count() == 0


def test_near_dedup_stage_keeps_one_text_of_an_id_and_says_which(spark):
    rows = [(1, words(1, 30), 5), (1, words(2, 30), 4), (1, words(2, 30), 3), (2, words(3, 30), 1)]
    kept = sorted((r["doc_id"], r["text"], r["x"]) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x long"), n=5, least=0.8).collect())
    assert kept == sorted([min((i, t, x) for i, t, x in rows if i == 1), (2, words(3, 30), 1)])


def test_digests_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_letter_junk_goes_and_clean_held_out_documents_stay(spark):
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz    ") for _ in range(300)) for _ in range(20)]
    table = docs.unionAll(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], docs.schema))
    kept = {r[0] for r in langid.keep_known(table).select("doc_id").collect()}
    clean = [r[0] for r in docs.where(langid.held_out(F.col("doc_id"))).where(F.length(F.trim("text")) >= 200).select("doc_id").collect()]
    assert not {-1 - i for i in range(20)} & kept
    assert sum(i in kept for i in clean) >= 0.99 * len(clean) > 0
