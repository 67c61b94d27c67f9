"""Periodic runs, the similarity join of shingle sets and the divergence of sources against plain versions of their own."""

import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pytest.importorskip("xxhash")

from lodegraph.llm import divergence, jaccard, runs  # noqa: E402

# Periodic runs.


def plain_runs(w):
    """Every period in turn, every stretch that keeps it, unless a smaller period does."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            if w[k] != w[k + q]:
                k += 1
                continue
            start = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            x = w[start : k + q]
            if len(x) >= max(6, 4 * q) and not any(x[: len(x) - r] == x[r:] for r in range(1, q)):
                found.append((start, len(x), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    n, k = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        p, a = rng.randrange(1, 9), rng.randrange(n)
        w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return w


@pytest.mark.parametrize("broken", [False, True])
def test_runs_are_those_of_all_periods(broken, monkeypatch):
    """Also if the hashes tell nothing: what they propose is compared word by word."""
    if broken:
        monkeypatch.setattr(runs, "_BASE", 0)
        monkeypatch.setattr(runs, "DIRECT", 1)
    rng = random.Random(5)
    for _ in range(1500):
        w = repetitive(rng)
        assert runs.runs_of(w) == plain_runs(w), w


def test_long_repeats_and_words_that_hide_runs():
    rng = random.Random(6)
    for p in (1, 2, 17, 300):
        base = list(range(p))
        w = [-1] + base * (6000 // p) + base[: p // 2] + [-2]
        assert runs.runs_of(w) == [(1, len(w) - 2, p)]
    w = [rng.randrange(2) for _ in range(400)]
    assert runs.runs_of(w) == plain_runs(w)


def plain_tail(doc_id, words):
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_query_is_the_plain_one(spark):
    """The whole query on a small fixture: tails, runs, the strongest, what is collapsed; nulls, blanks, signs, repeats and clashing names."""
    import hashlib
    from fractions import Fraction

    from lodegraph.llm import queries

    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["a", "b", "Ab", "é", "x y"]) for _ in range(rng.randrange(0, 60))) for i in range(120)}
    texts |= {200: None, 201: "", 202: " \n\t\x0b\x0c\r ", 203: "a " * 5000, 204: "x y\n" * 700 + "z", -5: "q r " * 9}
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in [*texts.items(), (7, texts[7]), (None, "a a a a a a a")]], "doc_id long, text string, Runs string, w int")
    found = runs.find_runs(runs.with_repeated_tails(frame))
    assert found.columns == ["doc_id", "text", "w", "runs", "strongest", "collapsed"]
    rows = found.select("doc_id", "strongest.*", F.size("runs").alias("n"), runs.run_text(F.col("runs")).alias("lines"), "collapsed").collect()
    assert len(rows) == len(texts) + 2 and sum(r["doc_id"] == 7 for r in rows) == 2
    periodic = 0
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts.get(r["doc_id"], "a a a a a a a") or "")
        words = plain_tail(r["doc_id"], words) if r["doc_id"] is not None else words
        want = plain_runs(words)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best and r["n"] == len(want)
        assert r["lines"] == "".join(f"{s},{n},{p}\n" for s, n, p in want)
        assert r["collapsed"] == " ".join(x for i, x in enumerate(words) if not any(s + p <= i < s + n for s, n, p in want))
        periodic += bool(want)
    assert periodic > 8
    assert runs.find_runs(frame.limit(0)).count() == 0
    got = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").where("doc_id = 3").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 3").first()["text"]
    words = plain_tail(3, re.findall(r"[^\x20\x09-\x0D]+", text))
    want = plain_runs(words)
    assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in want).encode()).hexdigest()


# The join of shingle sets.


def plain_components(rows, n=5):
    """Components of all pairs, smallest id."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc), doc)
    return [(doc, len(sets[k]), least[find(k)]) for k, (doc, _) in enumerate(rows)]


def edited(rng, words, share):
    return [rng.choice(["zz", "yy", "xx"]) + str(rng.randrange(50)) if rng.random() < share else w for w in words]


def near_copies(seed, vocabulary=60):
    """Groups of near copies on both sides of the threshold, chains, copies, shared passages and odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.015, 0.03, 0.06]))))
    chain = [f"c{i}" for i in range(60)]
    for _ in range(12):
        chain = [*chain[2:], *[word() for _ in range(2)]]
        texts.append(" ".join(chain))
    texts += [" ".join([word() for _ in range(10)] + passage + [word() for _ in range(4)]) for _ in range(8)]
    texts += [None, "", " \n\t", "Three short words", "three SHORT words", "É x", "é x", "a", "a", "x" * 5000, "same again " * 900, "same again " * 300]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("cell_rows", "seed"), [(4096, 1), (4096, 2), (4, 3), (2, 4)])
def test_similar_documents_are_those_of_all_pairs(spark, cell_rows, seed, monkeypatch):
    """Also where families are too large for a search of their own and keys too frequent for one."""
    monkeypatch.setattr(jaccard, "CELL_ROWS", cell_rows)
    rows = near_copies(seed)
    frame = spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, set_key string, size int").repartition(3)
    got = sorted(map(tuple, jaccard.components(frame).collect()))
    want = sorted(plain_components(rows))
    assert got == want and len({c for _, _, c in want}) < len(rows) - 15


def test_search_is_all_pairs_whatever_the_lists():
    """DivideSkip alone: random sets, sizes about the threshold, components from its links."""
    import numpy as np

    rng = random.Random(9)
    for _ in range(60):
        base = [rng.sample(range(400), rng.randrange(3, 60)) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = set(rng.choice(base))
            for _ in range(rng.randrange(0, 8)):
                s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and len(s) > 1 else s.add(rng.randrange(400))
            sets.append(s)
        a, b = jaccard.links_of(np.arange(len(sets)), np.array([len(s) for s in sets]), [np.array(sorted(s), np.int64) for s in sets])
        alike = lambda x, y: 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
        assert all(alike(x, y) for x, y in zip(a, b, strict=True))

        def labels(pairs, n=len(sets)):
            label = list(range(n))
            for _ in range(n):
                for x, y in pairs:
                    label[x] = label[y] = min(label[x], label[y])
            return label

        assert labels(list(zip(a, b, strict=True))) == labels([(x, y) for x in range(len(sets)) for y in range(x) if alike(x, y)])


def test_similar_documents_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.components(spark.createDataFrame([], schema)).count() == 0
    assert sorted(map(tuple, jaccard.components(spark.createDataFrame([(2, None), (1, "")], schema)).collect())) == [(1, 0, 1), (2, 0, 2)]
    rows = [(5, "one two three"), (None, "one two three"), (5, "one two three"), (None, "alone here"), (3, "ONE two\nthree")]
    got = sorted(map(tuple, jaccard.components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 1, 3), (5, 1, 3), (None, 1, 3), (None, 1, None), (3, 1, 3)], key=str)


# Divergence of sources.


def plain_audit(rows, least_docs=3, top=200):
    from collections import Counter, defaultdict

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731,B023
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize(("tile_terms", "tile_groups", "entries"), [(4096, 64, 1 << 18), (7, 2, 5)])
def test_divergences_are_the_plain_ones(spark, tile_terms, tile_groups, entries, monkeypatch):
    """One tile and many, one block of groups and several; groups without terms, languages without kept terms, nulls and ties."""
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefé你" for b in ("", "x", "Y", "zz")]
    rows = []
    for _ in range(150):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "é", None, "s4"])
        rows.append((rng.choice([" ", "1", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(0, 30))), lang, source))
    rows += [(None, "en", "empty"), ("", "xx", "a"), ("12 34", "xx", "b"), ("only once", "yy", "a"), ("word " * 3000, "en", "s1"), ("word", "en", "s2"), ("WORD", "en", "s4")]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    got = sorted(map(tuple, divergence.audit(frame, tile_terms=tile_terms, tile_groups=tile_groups, top=12).collect()))
    assert got == plain_audit(rows, top=12)


def test_divergences_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0


def test_shares_do_not_overflow():
    import numpy as np

    counts = np.array([0, 5, 10**15 - 1], np.int64)
    assert divergence.scaled_share(counts, 10**15, 3).tolist() == [1 + 10**9 * (int(c) + 1) // (10**15 + 3) for c in counts]
    assert divergence.scaled_share(np.array([0]), 0, 1).tolist() == [1 + 10**9]
