"""Documents whose sets of word shingles are similar: a T-occurrence search with merged short lists and probed long ones (DivideSkip)."""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, connected_components, materialize, release, texts_of

SHINGLE_WORDS = 5
#: Similarity 0.8 in whole numbers: sets of a and b shingles that share s are linked if 9 s >= 4 (a + b).
#: Documents and shingles of one search, at most, but for a single document's own.
CELL_ROWS, CELL_SHINGLES = 4096, 1 << 21
#: Rows of representatives that may be broadcast to the second scan; beyond it that join shuffles.
BROADCAST_ROWS = 1 << 20
#: Keys of sets that a task remembers to give the prefix of a set once.
SEEN = 1 << 18
#: Weight of the longest list's logarithm in the number of long lists.
MU = 0.01
_ODD = 0x9E3779B97F4A7C15


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of the n-word shingles, sorted, signed. Fewer words are one shingle, no words none.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A shingle's hash mixes its words' XXH64 in order.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    mixed = np.full(len(words) - k + 1, k, np.uint64)
    for at in range(k):
        mixed ^= hashes[at : at + len(mixed)]
        mixed *= np.uint64(_ODD)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def least_shared(size):
    """The fewest shingles that a set of so many shares with a linked one: four fifths, as a number or a column."""
    return (4 * size + 4) // 5 if isinstance(size, int) else F.expr(f"({size} * 4 + 4) div 5")


def _prefix_length(size: int) -> int:
    """Linked sets share at least ``lead`` of their first size - least + lead shingles in one order, lead being a tenth of the smaller set."""
    return size - least_shared(size) + max(1, size // 10) if size else 0


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def sketched(base: DataFrame, n: int) -> DataFrame:
    """base with size, set_key and prefix: the first shingles by hash, given once a task for each set."""

    def make():
        from xxhash import xxh64_intdigest

        seen: set[int] = set()

        def step(batch):
            sizes, keys, prefixes = [], [], []
            for text in texts_of(batch, "text"):
                own = shingles(text, n)
                key = xxh64_intdigest(own.tobytes(), 42)
                sizes.append(len(own))
                keys.append(key)
                prefixes.append(own[:0] if key in seen else own[: _prefix_length(len(own))].copy())
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
            return [pa.array(sizes, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64()), _lists(prefixes)]

        return step

    fields = [T.StructField("size", T.LongType()), T.StructField("set_key", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    return append_columns(base, fields, make)


def _with_sets(docs: DataFrame, n: int) -> DataFrame:
    def make():
        return lambda batch: [_lists([shingles(x, n) for x in texts_of(batch, "text")])]

    return append_columns(docs, [T.StructField("set", T.ArrayType(T.LongType()))], make)


class Index:
    """Inverted lists over the documents of one search, and links as one label a document, equal at first for equal roots.

    Documents stand by rising size, so a partner further on is no smaller and the bound on shared shingles is that of its size.
    """

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], roots: np.ndarray):
        order = np.lexsort((np.arange(len(sizes)), sizes))
        self.order, self.sizes = order, sizes[order].tolist()
        lengths = np.array([len(sets[k]) for k in order])
        owner = np.repeat(np.arange(len(order), dtype=np.int32), lengths)
        flat = np.concatenate([sets[k] for k in order]) if len(order) else np.zeros(0, np.int64)
        by = np.argsort(flat, kind="stable")
        flat, self.owner = flat[by], owner[by]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
        self.start = np.concatenate((first, [len(flat)]))
        # The lists of a document: numbers of those that others are in too.
        number = np.repeat(np.arange(len(first)), np.diff(self.start))
        shared = (np.diff(self.start) > 1)[number] if len(first) else np.zeros(0, bool)
        back = np.argsort(self.owner[shared], kind="stable")
        self.lists = np.split(number[shared][back], np.cumsum(np.bincount(self.owner[shared], minlength=len(order)))[:-1]) if len(order) else []
        self.label = np.unique(roots[order], return_inverse=True)[1]

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.label[a], self.label[b]))
        self.label[self.label == high] = low

    def search(self, q: int) -> list[int]:
        """Partners of document q further on that its links don't reach yet; each joins q's label, and with it all it is linked to."""
        least = -(-8 * self.sizes[q] // 9)
        numbers = self.lists[q]
        if len(numbers) < least or (self.label[q + 1 :] == self.label[q]).all():
            return []
        lengths = self.start[numbers + 1] - self.start[numbers]
        numbers = numbers[np.argsort(lengths, kind="stable")]
        n_long = min(least - 1, int(least / (MU * log2(max(2, int(lengths.max()))) + 1)))
        need = least - n_long
        short, long = numbers[: len(numbers) - n_long], numbers[len(numbers) - n_long :]
        # Short lists without documents that are linked to q already.
        slices = [self.owner[self.start[k] : self.start[k + 1]] for k in short.tolist()]
        ends, there = np.cumsum([len(x) for x in slices]), np.concatenate(slices)
        open_ = np.flatnonzero((there > q) & (self.label[there] != self.label[q]))
        if len(open_) < need:
            return []
        of_list = np.searchsorted(ends, open_, "right")
        cuts = np.flatnonzero(np.diff(of_list)) + 1
        return self._merge(q, [x.tolist() for x in np.split(there[open_], cuts)], need, long)

    def _merge(self, q: int, merged: list[list[int]], need: int, long: np.ndarray) -> list[int]:
        """Heap-merge of the short lists; what stands in ``need`` of them is probed for in the long ones. Lists skip ahead where too few can agree."""
        found, place = [], [0] * len(merged)
        heap = [(x[0], k) for k, x in enumerate(merged)]
        heapify(heap)
        while len(heap) >= need:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heappop(heap)[1])
            if len(popped) >= need:
                if self.label[top] != self.label[q] and self._probed(q, top, len(popped), long):
                    found.append(top)
                    self.join(q, top)
                ahead = top + 1
            else:
                for _ in range(min(need - 1 - len(popped), len(heap))):
                    popped.append(heappop(heap)[1])
                if not heap:
                    break
                ahead = heap[0][0]
            for k in popped:
                place[k] = bisect_left(merged[k], ahead, place[k])
                if place[k] < len(merged[k]):
                    heappush(heap, (merged[k][place[k]], k))
        return found

    def _probed(self, q: int, other: int, shared: int, long: np.ndarray) -> bool:
        """Whether the long lists that hold ``other``, found by binary search, bring the shared shingles to what both sizes ask."""
        wanted = -(-4 * (self.sizes[q] + self.sizes[other]) // 9)
        if shared < wanted <= shared + len(long):
            held = self.lists[other]
            at = np.minimum(np.searchsorted(held, long), len(held) - 1)
            shared += int(np.count_nonzero(held[at] == long))
        return shared >= wanted


def links_of(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], roots: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Linked pairs that, with what equal roots connect, have the components of all linked pairs of these documents."""
    index, a, b = Index(sizes, sets, nodes if roots is None else roots), [], []
    for q in range(len(nodes)):
        for other in index.search(q):
            a.append(int(nodes[index.order[q]]))
            b.append(int(nodes[index.order[other]]))
    return a, b


def _searched(rows: DataFrame, cell: list[str]) -> DataFrame:
    """(a, b) of (*cell, node, root, size, set): the links between different roots within each cell, cells one after another in a task."""

    def run(batches):
        here, held = None, ([], [], [], [])

        def done():
            a, b = links_of(np.array(held[0], np.int64), np.array(held[2], np.int64), held[3], np.array(held[1], np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(cell))], strict=True))
            nodes, roots, sizes, sets = (batch.column(len(cell) + k) for k in range(4))
            for k, key in enumerate(keys):
                if key != here:
                    if len(held[0]) > 1:
                        yield done()
                    here, held = key, ([], [], [], [])
                for column, value in zip(held, (nodes[k].as_py(), roots[k].as_py(), sizes[k].as_py(), sets[k].values.to_numpy()), strict=True):
                    column.append(value)
        if len(held[0]) > 1:
            yield done()

    return rows.select(*cell, "node", "root", "size", "set").repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long")


def _cut(rows: DataFrame, by: str) -> DataFrame:
    """rows (``by``, node, m, ...) with ``cuts``, the number of blocks that its key's documents make, and ``own``, the block of the node."""
    cuts = F.ceil(F.greatest(F.count("*") / (CELL_ROWS / 2), F.sum("m") / (CELL_SHINGLES / 2))).cast("int")
    return rows.join(rows.groupBy(by).agg(cuts.alias("cuts")), by).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))


def linked(base: DataFrame, sketches: DataFrame, n: int) -> DataFrame:
    """(node, root) of the keys of sets that are linked: root is the smallest key in the component of all pairs of similarity 0.8 or more.

    base: (row, text); sketches: (row, size, set_key, prefix) of its rows, written.
    """
    # Sets that could have a partner: enough of their first shingles stand in other sets' first ones.
    rows = sketches.where("size > 0").select(F.explode("prefix").alias("key"), F.col("set_key").alias("node"), "size")
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    counted = rows.join(shared, "key").groupBy("node").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    alive = materialize(counted.where(F.col("n") >= F.greatest(F.lit(1), F.expr("((size * 4 + 4) div 5) div 10"))).select(F.col("node").alias("set_key")))

    # Their whole sets, one row of each, then the shingles that any two of these share, rare ones first.
    some = materialize(sketches.join(alive, "set_key").groupBy("set_key").agg(F.min("row").alias("row"), F.max("size").alias("size")))
    one = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    sets = materialize(_with_sets(base.join(one, "row").dropDuplicates(["row"]).select("set_key", "size", "text"), n).select(F.col("set_key").alias("node"), "size", "set"))
    lists = sets.select("node", "size", F.explode("set").alias("key"))
    frequent = lists.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    reduced = lists.join(frequent, "key").groupBy("node").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    reduced = reduced.where(F.size("s") >= least_shared("size"))
    nodes = materialize(reduced.select("node", "size", F.col("s.key").alias("set")))
    release(alive, some, sets)

    # Linked sets share one of these keys. Two steps of the least neighbour put most documents that keys connect under one name.
    first = F.slice("set", F.lit(1), (F.size("set") - least_shared("size") + 1).cast("int"))
    keys = nodes.select(F.explode(first).alias("key"), "node", F.size("set").alias("m"))
    least = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "lo")
    keys = materialize(keys.join(least, "key"))
    name = keys.groupBy("node").agg(F.min("lo").alias("name"), F.max("m").alias("m"))
    again = keys.join(name.select("node", "name"), "node").groupBy("key").agg(F.min("name").alias("of_key"))
    name = keys.join(again, "key").groupBy("node").agg(F.min("of_key").alias("name"), F.max("m").alias("m"))
    sizes = name.groupBy("name").agg(F.count("*").alias("rows"), F.sum("m").alias("total"))
    fits = (F.col("rows") <= CELL_ROWS) & (F.col("total") <= CELL_SHINGLES)
    name = materialize(name.join(sizes, "name").select("node", "name", fits.alias("fits")))

    # Documents of one name are searched together if they are few enough; of others each goes to the search of its first key, where the
    # least document of the key is in every block.
    whole = name.where("fits").select(F.col("name").alias("cell"), F.lit(0).alias("i"), "node")
    wide = keys.join(name.where("not fits").select("node"), "node")
    one = wide.join(wide.groupBy("node").agg(F.min(F.xxhash64("key")).alias("h")), "node").where(F.xxhash64("key") == F.col("h")).drop("h")
    one = _cut(one, "key")
    hubs = one.select("key", "own", F.col("lo").alias("node"))
    placed = one.select("key", "own", "node").unionByName(hubs).distinct().select(F.col("key").alias("cell"), (F.col("own") + 1).alias("i"), "node")
    cells = whole.unionByName(placed).join(nodes, "node").withColumn("root", F.col("node"))
    found = materialize(_searched(cells, ["cell", "i"]).distinct())
    roots = materialize(connected_components(found))

    # Keys not searched whole whose documents are still apart: every pair of blocks of a key, without comparing what is linked already.
    placed = keys.join(name, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = [F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("name").alias("n0"), F.max("name").alias("n1"), F.min("fits").alias("all")]
    apart = placed.groupBy("key").agg(*ends).where("r0 < r1 and (n0 < n1 or not all)").select("key")
    still = materialize(placed.join(apart, "key").select("key", "node", "root", "m"))
    if still.isEmpty():
        release(keys, name, nodes, found, still)
        return roots
    parts = _cut(still, "key").select("key", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("k"))
    pairs = parts.select("key", "node", "root", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j")).join(nodes, "node")
    more = materialize(_searched(pairs, ["key", "i", "j"]).distinct())
    # New links join components, so only their roots need new ones.
    of = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
    between = more.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = connected_components(between.where("a <> b").distinct()).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = roots.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    named = materialize(every.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    release(keys, name, nodes, found, still, more, roots)
    return named


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id): the number of a row's distinct shingles and the smallest doc_id that links reach from it.

    Rows link if their sets of n-word shingles have a Jaccard similarity of 0.8 or more, decided in whole numbers. Equal sets count once,
    so copies cost their rows and no pairs. Sets without enough shared shingles among their first ones drop out exactly; the rest are
    indexed whole, rare shingles first, and searched in cells of bounded size by DivideSkip.

    Null or blank texts have no shingles and are linked with nothing. Null ids are returned, but name no component unless all ids
    of it are null. Repeated rows come back repeated. An empty table gives none. Other columns aren't returned.
    """
    base = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    sketches = materialize(sketched(base, n).drop("text"))
    roots = linked(base.select("row", "text"), sketches, n)
    classes = sketches.where("size > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    rooted = classes.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("set_key", "component_id")
    every = sketches.select("doc_id", "size", "set_key").join(named, "set_key", "left")
    return every.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
