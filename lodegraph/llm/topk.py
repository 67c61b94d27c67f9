"""Exact top-k inner-product search over a bit-sliced index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize

QUERY_BLOCK = 1 << 14
ROW_BLOCK = 1 << 16
#: Vectors of smaller quantised components go through the slices; larger ones, whose scores may not fit in 64 bits on the way, by
#: whole numbers of any size.
SLICED = 1 << 25
_MOST = (1 << 63) - 1


def _pack(bits: np.ndarray) -> np.ndarray:
    """A boolean row set as a bitmap of 64-bit words."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view(np.uint64)


def _unpack(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


class SlicedIndex:
    """Quantised vectors by bit slice: slices[d, j] is the bitmap of rows whose component d (less its least) has bit j."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, (self.n, self.dims) = vectors, vectors.shape
        self.low = vectors.min(0)
        offset = vectors - self.low
        self.width = [int(x).bit_length() for x in offset.max(0)]
        self.slices = [[_pack((offset[:, d] >> j) & 1 == 1) for j in range(w)] for d, w in enumerate(self.width)]
        self.full = _pack(np.ones(self.n, bool))
        self.flipped = [[x ^ self.full for x in s] for s in self.slices]

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices of score + constant over all rows, least significant first, added with bitmap arithmetic.

        A component of weight w adds its slice j into the columns j + i of every bit i of |w|; for w < 0 the complement is
        added, which differs by a constant. Full adders then take three bitmaps of a column to one there and one above.
        """
        columns: list[list[np.ndarray]] = []
        for d, w in enumerate(query.tolist()):
            parts = self.slices[d] if w > 0 else self.flipped[d]
            for i in range(abs(w).bit_length()):
                if abs(w) >> i & 1:
                    for j, bitmap in enumerate(parts):
                        while len(columns) <= i + j:
                            columns.append([])
                        columns[i + j].append(bitmap)
        out, k = [], 0
        while k < len(columns):
            column = columns[k]
            if k + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                carry = half & c
                carry |= a & b
                half ^= c
                column.insert(0, half)
                columns[k + 1].append(carry)
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                columns[k + 1].append(a & b)
            out.append(column[0] if column else np.zeros_like(self.full))
            k += 1
        return out

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k highest scores with all ties of the last, found from the most significant slice downward."""
        sure, open_, count = np.zeros_like(self.full), self.full, 0
        for bitmap in reversed(self.sums(query)):
            high = open_ & bitmap
            n = int(np.bitwise_count(high).sum())
            if count + n > k:
                open_ = high
            else:
                sure, count = sure | high, count + n
                open_ = open_ & ~bitmap
                if count == k:
                    open_ = np.zeros_like(self.full)
                    break
        return _unpack(sure | open_, self.n)


def _whole(matrix: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers."""
    return np.array([[int(x) for x in row] for row in matrix.tolist()], object).reshape(matrix.shape)


class Block:
    """The rows of one block: those of moderate components in a sliced index, the few others as they are."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        small = (np.abs(matrix) < SLICED).all(1)
        self.ids, self.index = ids[small], SlicedIndex(matrix[small].astype(np.int64)) if small.any() else None
        self.far_ids, self.far = ids[~small], matrix[~small]
        self.every, self.wide = (ids, matrix), None

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
        """Ids and scores of the k best rows but those of the query's own id; ties to the smaller id."""
        if (np.abs(query) < SLICED).all():
            found = self._sliced(query.astype(np.int64), own, k) + self._exact(query, own, self.far_ids, _whole(self.far)) if len(self.far) else self._sliced(query.astype(np.int64), own, k)
        else:
            self.wide = _whole(self.every[1]) if self.wide is None else self.wide
            found = self._exact(query, own, self.every[0], self.wide)
        found.sort(key=lambda x: (-x[1], x[0]))
        return [x[0] for x in found[:k]], [x[1] for x in found[:k]]

    def _sliced(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        if self.index is None:
            return []
        # Rows of the query's own id may be among the best: so many more are asked for.
        rows = self.index.candidates(query, min(self.index.n, k + int((self.ids == own).sum())))
        rows = rows[self.ids[rows] != own]
        scores = self.index.vectors[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return list(zip(self.ids[rows[best]].tolist(), scores[best].tolist(), strict=True))

    def _exact(self, query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        q = [int(x) for x in query.tolist()]
        score = lambda row: max(-_MOST - 1, min(_MOST, sum(a * b for a, b in zip(row, q, strict=True))))
        return [(int(i), score(row)) for i, row in zip(ids.tolist(), rows.tolist(), strict=True) if i != own]


def quantise(embeddings: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, a whole double. Rows whose id or vector is null, or that hold a null or
    non-finite component, go."""
    # The scale is a power of two, so scaling doesn't round; floor() is a long, and a double of 2^53 or more is whole itself.
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    v = F.transform(col(vector), lambda x: F.when(F.abs(scaled(x)) < float(1 << 53), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    fine = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.where(col(vec_id).isNotNull() & col(vector).isNotNull()).where(fine).select(col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def top_k(embeddings: DataFrame, queries, k: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products with all rows but its own.

    ``queries`` is a condition on ``vec_id`` that states which rows are queries. Rows are dealt by hash into blocks of about
    ``row_block`` and queries into blocks of about ``query_block``; each pair of blocks is one task's work: it slices the
    rows once and answers its queries exactly, and the k best of each block are merged by rank. Ties go to the smaller id;
    a repeated id is a row of its own as a candidate, but never of its own query. A query id that is repeated with another
    vector is asked once, with its smallest vector. Vectors of different lengths don't meet, empty ones score 0. A score beyond
    64 bits counts as the largest (or smallest) of 64 bits. Fewer rows than k: all. An empty table gives none; other columns go.
    """
    base = materialize(quantise(embeddings, vec_id, vector, scale).withColumn("dims", F.size("v")))
    asked = base.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"), F.min(F.struct("v", "dims"))["dims"].alias("dims"))
    n_rows, n_asked = base.count(), base.where(queries).count()
    row_blocks, query_blocks = max(1, math.ceil(n_rows / row_block)), max(1, math.ceil(n_asked / query_block))
    # A few more pieces than one of each, so that small tables also use all cores; the work is the same.
    query_blocks = max(query_blocks, min(max(1, n_asked // 64), math.ceil(12 / row_blocks)))
    deal = lambda blocks, *by: F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    rows = base.select("dims", deal(row_blocks, "vec_id").alias("rb"), every(query_blocks, "qb"), F.lit(0).alias("asks"), "vec_id", "v")
    asks = asked.select("dims", every(row_blocks, "rb"), deal(query_blocks, "vec_id").alias("qb"), F.lit(1).alias("asks"), "vec_id", "v")
    met = rows.unionAll(asks).repartition(max(row_blocks * query_blocks, 1) if row_blocks * query_blocks < 4096 else 4096, "dims", "rb", "qb").sortWithinPartitions("dims", "rb", "qb", "asks")

    def run(batches):
        here, held_ids, held, index = None, [], [], None
        for batch in batches:
            dims, rb, qb, ask, ids = (batch.column(i).to_numpy() for i in range(5))
            vectors = batch.column(5)
            flat, offsets = vectors.flatten().to_numpy(), np.asarray(vectors.offsets) - vectors.offsets[0].as_py()
            changes = np.flatnonzero((np.diff(dims) != 0) | (np.diff(rb) != 0) | (np.diff(qb) != 0) | (np.diff(ask) != 0)) + 1
            edge = [0, *changes.tolist(), batch.num_rows]
            out = [[], [], []]
            for s, e in zip(edge, edge[1:], strict=False):
                if s == e:
                    continue
                key = (dims[s], rb[s], qb[s])
                if key != here:
                    here, held_ids, held, index = key, [], [], None
                matrix = flat[offsets[s] : offsets[e]].reshape(e - s, dims[s])
                if not ask[s]:
                    held_ids.append(ids[s:e])
                    held.append(matrix)
                    continue
                if not held:
                    continue
                if index is None:
                    index, held = Block(np.concatenate(held_ids), np.concatenate(held)), [None]
                for q, query in zip(ids[s:e].tolist(), matrix, strict=True):
                    found, scores = index.top(query, q, k)
                    for to, x in zip(out, (np.full(len(found), q), found, scores), strict=True):
                        to.append(np.array(x, np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
