"""SimHash near-duplicates: exact comparison of all fingerprints, tile by tile, with numpy XOR and bit counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .common import append_columns, col, connected_components, materialize, texts_of

SHINGLE_WORDS = 3
RADIUS = 2
#: Fingerprints of one tile; a larger population class is cut into several tiles, but at most so many: tiles grow with the table
#: then, and the copies of a fingerprint don't.
TILE, MOST_CUTS = 4096, 16


def _shingle_hashes(text: str | None, n: int):
    """The XXH64 hashes (seed 42) of the n-word shingles in order, in arrays of at most 65,536. Fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    # On bytes, lower() changes A-Z alone and split() cuts at 0x20 and 0x09-0x0D alone.
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-n] + 1)).tolist() if len(words) > n else [0]
    stops = ends[n - 1 :].tolist() if len(words) > n else [len(joined)]
    for at in range(0, len(starts), 1 << 16):
        yield np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], "<u8")


def _majority(parts: list[np.ndarray]) -> int:
    counts, total = np.zeros(64, np.int64), sum(map(len, parts))
    for hashes in parts:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > total))


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes (seed 42) of the n-word shingles, repeats included."""
    return _majority(list(_shingle_hashes(text, n)))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "simhash", n: int = SHINGLE_WORDS) -> DataFrame:
    """docs with the 64-bit fingerprint of the whole text as a long. Null or blank text: 0. A column ``out`` is replaced."""

    def make():
        return lambda batch: [pa.array(np.array([fingerprint(x, n) for x in texts_of(batch, text)], np.uint64).view(np.int64), pa.int64())]

    return append_columns(docs, [T.StructField(out, T.LongType())], make)


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` nodes the smallest node that the links a-b reach."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(old, label):
            break
    return label


def _links(home: np.ndarray, guests: np.ndarray, radius: int, inner: bool):
    """Links between home fingerprints and guests (and among the home ones, if ``inner``), as a spanning forest.

    Links are merged block by block, and only those between different trees are held, so a dense tile takes no more memory
    than one block's bits.
    """
    everyone = np.concatenate((home, guests))
    label = np.arange(len(everyone))
    for at in range(0, len(home), 256):
        block = home[at : at + 256, None]
        for other, offset in ((home, 0), (guests, len(home))) if inner else ((guests, len(home)),):
            for k in range(0, len(other), 4096):
                i, j = np.nonzero(np.bitwise_count(block ^ other[None, k : k + 4096]) <= radius)
                a, b = label[i + at], label[j + (k + offset)]
                apart = a != b
                if apart.any():
                    label = _forest(a[apart], b[apart], len(everyone))[label]
    moved = np.flatnonzero(label != np.arange(len(everyone)))
    return everyone[moved], everyone[label[moved]]


def _deltas(radius: int) -> list[tuple[int, int, int, int]]:
    """Steps between population vectors that fingerprints of ``radius`` differing bits can take, each pair one way."""
    span = range(-radius, radius + 1)
    return sorted(d for d in ((a, b, c, e) for a in span for b in span for c in span for e in span) if sum(map(abs, d)) <= radius and d > (0, 0, 0, 0))


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) over distinct fingerprints in column ``fp``: links whose components are those of all pairs within ``radius``.

    A fingerprint's population vector holds the bit counts of its four 16-bit words. Fingerprints within the radius have
    vectors within that many steps, so each tile (one vector; a large one is cut by hash) meets only the tiles near it and
    all other tile pairs are skipped. A row goes to its own tile and as a guest to the near tiles on one side. The tile sizes
    are counted first: at most 17**4 rows, so that table may be broadcast. Tasks stream guests against one tile of at most
    about ``tile`` fingerprints and return forests, never all pairs of a group.
    """
    word = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(65535))).cast("int")
    base = prints.select("fp", *[word(k).alias(f"p{k}") for k in range(4)])
    number = lambda *p: ((p[0] * 17 + p[1]) * 17 + p[2]) * 17 + p[3]
    tiled = base.withColumn("v", number(*[F.col(f"p{k}") for k in range(4)]))
    sizes = F.broadcast(tiled.groupBy("v").agg(F.least(F.ceil(F.count("*") / F.lit(tile)), F.lit(MOST_CUTS)).cast("int").alias("cuts")))
    cut = tiled.join(sizes, "v").withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    near = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in _deltas(radius)])
    inside = lambda x, k: (x[f"d{k}"] + F.col(f"p{k}")).between(0, 16)
    # Guests of other vectors: to every cut of a vector on the near side that exists.
    away = base.select("fp", F.explode(F.filter(F.transform(F.filter(near, lambda x: inside(x, 0) & inside(x, 1) & inside(x, 2) & inside(x, 3)), lambda x: number(*[x[f"d{k}"] + F.col(f"p{k}") for k in range(4)])), lambda v: v >= 0)).alias("v"))
    away = away.join(sizes, "v").select("v", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(1).alias("guest"), "fp")
    # Guests of the same vector: to the cuts before one's own.
    same = cut.where("cut > 0").select("v", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("cut"), F.lit(1).alias("guest"), "fp")
    rows = cut.select("v", "cut", F.lit(0).alias("guest"), "fp").unionAll(away).unionAll(same)

    def run(batches):
        here, home = None, []
        for batch in batches:
            v, c, g = (batch.column(i).to_numpy() for i in range(3))
            fp = batch.column(3).to_numpy().view(np.uint64)
            key = v.astype(np.int64) << 33 | c.astype(np.int64) << 1 | g
            edge = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            a, b = [], []
            for s, e in zip(edge, edge[1:], strict=False):
                if s == e:
                    continue
                if here != key[s] >> 1:
                    here, home = key[s] >> 1, []
                if not g[s]:
                    # Home rows may come in several batches: the new ones meet the former ones and each other.
                    found = _links(fp[s:e], np.concatenate(home) if home else fp[:0], radius, True)
                    home.append(fp[s:e])
                elif home:
                    found = _links(np.concatenate(home), fp[s:e], radius, False)
                else:
                    continue
                a.append(found[0])
                b.append(found[1])
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return rows.repartition("v", "cut").sortWithinPartitions("v", "cut", "guest").mapInArrow(run, "a long, b long")


def _similar_links(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) over fingerprints: those that rows of one set of shingles have, and those of linked sets (roots: set_key as node, root)."""
    first = materialize(prints.where("size > 0").groupBy("set_key").agg(F.min("simhash").alias("fp")))
    same = prints.join(first, "set_key").where("fp <> simhash").select(F.col("fp").alias("a"), F.col("simhash").alias("b")).distinct()
    one, other = (first.select(F.col("set_key").alias(x), F.col("fp").alias(f)) for x, f in (("node", "a"), ("root", "b")))
    return same.unionAll(roots.join(one, "node").join(other, "root").where("a <> b").select("a", "b"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, n: int = SHINGLE_WORDS, least: float | None = None) -> DataFrame:
    """(doc_id, simhash, component_id): each row's component is the smallest doc_id its fingerprint's links reach.

    Copies share a fingerprint and count once in the comparison, so a group of copies costs its rows and no pairs.
    Null or blank texts have fingerprint 0 and link like any other. Null ids are returned, but name no component unless all
    ids of it are null. Repeated rows come back repeated. An empty table gives none. Other columns aren't returned.
    With ``least``, which is 0.8 then, texts whose sets of shingles have a Jaccard similarity of that or more are linked too, all of
    them, by the search of ``jaccard``; no fingerprint decides on those.
    """
    base = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    if least is None:
        prints = materialize(with_fingerprint(base, n=n).select("doc_id", "simhash"))
    else:
        base = base.withColumn("row", F.xxhash64("doc_id", "text"))
        if least != 0.8:
            raise ValueError("the search for similar sets is that of 0.8")
        prints = materialize(with_fingerprint(jaccard.sketched(base, n), n=n).drop("text"))
    classes = materialize(prints.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("first_id")))
    links = fingerprint_links(classes.select("fp"), radius)
    if least is not None:
        links = links.unionAll(_similar_links(prints, jaccard.linked(base.select("row", "text"), prints, n)))
    links = connected_components(links)
    rooted = classes.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("simhash"), "component_id")
    # A fingerprint of very many copies makes one large join partition, which adaptive execution splits by its size.
    return prints.join(named, "simhash").select("doc_id", "simhash", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, n: int = SHINGLE_WORDS, least: float | None = None) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id; of rows of that id the one of the smallest text, then of
    the smallest other columns (of equal columns that have no order, any one).

    Rows whose id is null are kept: nothing tells them apart. An empty table gives an empty one.
    """
    kept = components(docs, doc_id, text, radius, n, least).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(kept.withColumnRenamed("doc_id", "__kept"), col(doc_id) == F.col("__kept"), "left_semi")
    doubled = first.groupBy(col(doc_id).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1")
    single = first.join(doubled, col(doc_id) == F.col("__id"), "left_anti")
    ordered = [text, *[f.name for f in docs.schema.fields if f.name != text and not isinstance(f.dataType, T.MapType | T.VariantType)]]
    least_row = F.min_by(F.struct(*[col(c).alias(c) for c in docs.columns]), F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(ordered)]))
    several = first.join(doubled, col(doc_id) == F.col("__id"), "left_semi").groupBy(col(doc_id).alias("__id")).agg(least_row.alias("__row")).select("__row.*")
    return single.unionByName(several).unionByName(docs.where(col(doc_id).isNull()))
