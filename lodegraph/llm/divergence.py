"""How far the sources of a language differ in their words: exact divergences from dense tiles of groups by terms."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize, release, texts_of

#: A term is kept in a language that has it in so many documents; terms of a group that are returned.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Terms and groups on one side of a tile, about; entries a task holds before it hands partial counts on; cells of one broadcast.
TILE_TERMS, TILE_GROUPS, ENTRIES, CELLS = 4096, 64, 1 << 18, 1 << 20
SCALE = 1_000_000_000
#: Bytes that stand in no term, as blanks.
_LETTERS = bytes(c if c > 0x7F or chr(c).isalpha() else 0x20 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): partial counts, one row for each term of a group and piece of a task.

    Terms are runs of letters A-Z and of characters beyond ASCII, A-Z lower-cased. docs: documents that hold the term.
    """

    def run(batches):
        n: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}

        def rows():
            for (lang, source), counts in n.items():
                terms, docs_of = list(counts), held[lang, source]
                for at in range(0, len(terms), 1 << 16):
                    part = terms[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([counts[t] for t in part], pa.int64()), pa.array([docs_of[t] for t in part], pa.int64()),
                    ], names=["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in batches:
            for lang, source, text in zip(*[texts_of(batch, c) for c in ("lang", "source", "text")], strict=True):
                # On bytes, lower() changes A-Z alone; blanks are all that split() then cuts at.
                terms = text.encode().lower().translate(_LETTERS).split()
                key = lang, source
                counts, docs_of = n.setdefault(key, Counter()), held.setdefault(key, Counter())
                before = len(counts)
                counts.update(terms)
                docs_of.update(set(terms))
                size += len(counts) - before
                if size > ENTRIES:
                    yield from rows()
                    n, held, size = {}, {}, 0
        yield from rows()
        pa.default_memory_pool().release_unused()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def scaled_share(count: np.ndarray, total, kinds: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kinds)), by long division in steps of a thousand so that nothing overflows."""
    rest, whole, by = count + 1, np.zeros_like(count), np.asarray(total + kinds, np.int64)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // by, rest % by
    return whole + 1


def _tile(rows: pa.Table, heads: pa.Table, top: int) -> pa.Table:
    """Partial sums of all pairs of groups and the strongest terms of each group, of one block of terms.

    rows: (g, term, n) with g = 0 for the whole language; heads: (g, side, source, total, kinds), g = 0 again for the language.
    """
    lang, ga, gb = heads.column("lang")[0].as_py(), heads.column("ga")[0].as_py(), heads.column("gb")[0].as_py()
    g, side, totals = (heads.column(c).to_numpy() for c in ("g", "side", "total"))
    sources, kinds = heads.column("source").to_pylist(), heads.column("kinds")[0].as_py()
    order = np.argsort(g, kind="stable")
    g, side, totals, sources = g[order], side[order], totals[order], [sources[k] for k in order]
    coded = rows.column("term").combine_chunks().dictionary_encode()
    counts = np.zeros((len(g), len(coded.dictionary)), np.int64)
    counts[np.searchsorted(g, rows.column("g").to_numpy()), coded.indices.to_numpy()] = rows.column("n").to_numpy()
    p = scaled_share(counts, totals[:, None], kinds)

    out: dict[str, list] = {"part": [], "source": [], "item": [], "value": []}

    def add(part, source, items, values):
        out["part"] += [part] * len(items)
        out["source"] += [source] * len(items)
        out["item"] += items
        out["value"] += values

    left, right = np.flatnonzero((side & 1) > 0), np.flatnonzero((side & 2) > 0)
    for one, other in ((left, right),) if ga == gb else ((left, right), (right, left)):
        step = max(1, CELLS // max(1, len(other) * p.shape[1]))
        for at in range(0, len(one), step):
            some = one[at : at + step]
            gap = p[some][:, None, :] - p[other][None, :, :]
            values = (gap * gap // p[other][None, :, :]).sum(2)
            for k, a in enumerate(some):
                there = [b for b in range(len(other)) if other[b] != a]
                add("pair", sources[a], [sources[other[b]] for b in there], [int(values[k, b]) for b in there])
    if ga == gb:
        names, q = [x.encode() for x in coded.dictionary.to_pylist()], p[0]
        for a in left:
            at = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            gap = p[a][at] - q[at]
            best = heapq.nsmallest(top, zip((-(gap * gap // q[at])).tolist(), [names[k] for k in at.tolist()], strict=True))
            add("term", sources[a], [t.decode() for _, t in best], [-v for v, _ in best])
    types = {"part": pa.string(), "source": pa.string(), "item": pa.string(), "value": pa.int64()}
    return pa.table({"lang": pa.array([lang] * len(out["part"]), pa.string()), **{c: pa.array(v, types[c]) for c, v in out.items()}})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and its strongest terms.

    Each language keeps the terms that ``least_docs`` of its rows hold. Part ``pair``: the divergence of a source from every other
    source of the language, summed over all kept terms (0 if none is kept). Part ``term``: the ``top`` terms that a source has more
    often than its language. Shares are whole numbers scaled to 10**9 after adding one to each count, a term's divergence is
    floor((p - q) ** 2 / q); all is exact in 64 bits. Ranks go by falling value, then by item in UTF-8.

    Tasks count terms by source, a shuffle sums them, and blocks of terms by hash become dense matrices (groups by terms, with 0 where a
    source lacks a term), each of about ``tile_terms`` terms and twice ``tile_groups`` groups. Every block compares all pairs of its
    groups by broadcasting; partial sums of pairs add up, and the blocks' strongest terms merge by group. So a common term is one
    row a source, whatever its count, and no task holds a language.

    Null text, lang and source are read as ''. Repeated rows count each. An empty table gives none; a language of one
    source has no pairs. Other columns aren't read.
    """
    base = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = materialize(term_counts(base).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    sizes = materialize(whole.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")))
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("kinds") / F.lit(tile_terms))).cast("int").alias("block")
    kept = materialize(whole.join(sizes, "lang").select("lang", "term", "n", block))
    inside = materialize(counts.join(kept.select("lang", "term", "block"), ["lang", "term"]).select("lang", "source", "term", "n", "block"))

    totals = inside.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    named = base.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes.select("lang", "kinds"), "lang", "left")
    groups = materialize(named.select("lang", "source", number.cast("long").alias("g"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds")).withColumn("gg", F.floor((F.col("g") - 1) / tile_groups).cast("int")))

    # Every pair of group blocks of a language, once; a group goes to all pairs that its block is in.
    last = groups.groupBy("lang").agg(F.max("gg").alias("last"))
    ends = lambda own: F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least(own, k).alias("ga"), F.greatest(own, k).alias("gb")))).alias("pair")
    placed = groups.join(last, "lang").where("kinds > 0").select("lang", "source", "g", "total", "kinds", "gg", ends(F.col("gg"))).select("*", "pair.ga", "pair.gb")
    side = ((F.col("gg") == F.col("ga")).cast("int") + 2 * (F.col("gg") == F.col("gb")).cast("int")).alias("side")
    pairs = placed.select("lang", "ga", "gb").distinct()
    of_lang = pairs.join(sizes, "lang").select("lang", "ga", "gb", F.lit(0).cast("long").alias("g"), F.lit(0).alias("side"), F.lit("").alias("source"), "total", "kinds")
    heads = materialize(placed.select("lang", "ga", "gb", "g", side, "source", "total", "kinds").unionByName(of_lang))
    blocks = kept.select("lang", "block").distinct()
    tile_heads = heads.join(blocks, "lang")
    of_groups = inside.join(placed.select("lang", "source", "g", "ga", "gb"), ["lang", "source"]).select("lang", "block", "ga", "gb", "g", "term", "n")
    of_langs = kept.join(pairs, "lang").select("lang", "block", "ga", "gb", F.lit(0).cast("long").alias("g"), "term", "n")
    tile = ["lang", "block", "ga", "gb"]

    def compare(_, rows: pa.Table, heads_: pa.Table) -> pa.Table:
        return _tile(rows, heads_, top)

    made = of_groups.unionByName(of_langs).groupBy(*tile).cogroup(tile_heads.groupBy(*tile)).applyInArrow(compare, "lang string, part string, source string, item string, value long")
    partial = materialize(made)
    a, b = groups.select("lang", "source", "g", "kinds"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))
    without = a.where("kinds = 0").join(b, "lang").where("g <> h").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(without)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = partial.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found = summed.withColumn("rank", F.row_number().over(order)).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
    release(counts, inside, kept, sizes, heads)
    return found.select("lang", "source", "part", "item", "value", "rank")
