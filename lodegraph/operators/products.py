"""Products of two tables over a shared key, summed by pair, in cells of bounded size.

What a join on the key and an aggregate by (g, d) give, but no product and no pair is shuffled: the ids g are cut into blocks, the ids d into others,
and a cell is a block of each. A block of the left table goes to its cells once, packed, and so does one of the right table. A cell
makes the products of a slice of its g's at a time and hands the pairs on at once. Where there are several blocks of d's, blocks are ranges of
ids and only cells whose blocks share keys get any rows, so what is sent doesn't grow with the square of a table of separate groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Rows of the left and of the right table in a cell, about; left rows unpacked at once, about; products made at once.
LEFT, RIGHT, SLICE, CHUNK = 1 << 23, 1 << 22, 1 << 18, 1 << 20
#: Ranges of keys, of equal width, by which blocks are asked whether they share any.
KEYS = 1024

#: Stands for a null id inside; a null key meets nothing.
_NULL = -(1 << 63)
_TYPES = {"g": pa.int64(), "d": pa.int64(), "n": pa.int64(), "rows": pa.int64()}


def _bounds(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Where ``n`` ranges of about as many rows each end, but the last."""
    if n == 1:
        return np.empty(0, np.int64)
    return np.array(rows.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 100 * n)).first()[0] or [], np.int64)


def _shared(left: DataFrame, right: DataFrame, gs: np.ndarray, ds: np.ndarray) -> DataFrame:
    """(gb, db): the blocks of g's and of d's that rows of the same range of keys stand in."""
    low, high = right.agg(F.min("k"), F.max("k")).first()
    low, width = low or 0, max(1, ((high or 0) - (low or 0)) // KEYS + 1)

    def ranges(rows, column, bounds, name):
        def found(batches):
            for batch in batches:
                pairs = np.unique(np.stack([np.searchsorted(bounds, batch.column(0).to_numpy()), batch.column(1).to_numpy() // width]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=[name, "kb"])

        return rows.where(F.col("k").between(low, high)).select(column, F.col("k") - low).mapInArrow(found, f"{name} long, kb long").distinct()

    return written(ranges(left, "g", gs, "gb").join(ranges(right, "d", ds, "db"), "kb").select("gb", "db").distinct())


def _packed(rows: DataFrame, kind: str, buckets: list[Column], gs: np.ndarray | None = None, ds: np.ndarray | None = None) -> DataFrame:
    """(sub, db, kind, n, payload) of rows of 8-byte columns: as many as an Arrow task has at hand are packed by bucket and compressed.

    gs and ds: bounds of the blocks of the first and of the second column; the first's then count within sub.
    """
    most = SLICE * 4

    def flush(held):
        table = pa.Table.from_batches(held)
        sub, db, *columns = [table.column(i).to_numpy() for i in range(table.num_columns)]
        if gs is not None:
            sub = sub * (len(gs) + 1) + np.searchsorted(gs, columns[0])
        if ds is not None:
            db = np.searchsorted(ds, columns[1])
        order = np.lexsort((columns[0], db, sub))
        sub, db, columns = sub[order], db[order], [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate(([True], (sub[1:] != sub[:-1]) | (db[1:] != db[:-1]))))
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(sub)], strict=True))
        payloads = [pa.compress(b"".join(c[a:b].tobytes() for c in columns), "zstd", asbytes=True) for a, b in cuts]
        sizes = pa.array([b - a for a, b in cuts], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(sub[first]), pa.array(db[first]), pa.array([kind] * len(cuts)), sizes, pa.array(payloads, pa.binary())], names=["sub", "db", "kind", "n", "payload"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return rows.select(*[b.cast("long").alias(c) for b, c in zip(buckets, ("in_g", "in_d"), strict=True)], *rows.columns).mapInArrow(pack, "sub long, db long, kind string, n long, payload binary")


def _unpacked(payloads: list[tuple[int, bytes]], types: list) -> list[np.ndarray]:
    """The columns of packed rows."""
    parts = [np.frombuffer(pa.decompress(p, 8 * n * len(types), "zstd", asbytes=True), np.int64).reshape(len(types), n) for n, p in payloads]
    return [np.concatenate([p[i] for p in parts]).view(t) if parts else np.empty(0, t) for i, t in enumerate(types)]


class _Right:
    """The right rows of a cell by key, with the d's numbered in their order."""

    def __init__(self, payloads, weights: int, attribute: bool):
        k, d, *values = _unpacked(payloads, [np.int64, np.int64] + [np.float64] * (weights + attribute))
        self.ids, code = np.unique(d, return_inverse=True)
        if attribute:
            self.attribute = np.zeros(len(self.ids))
            self.attribute[code] = values.pop()
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
        self.keys, self.at = k[first], np.append(first, len(k))
        self.code, self.weights = code[order].astype(np.int32), [v[order] for v in values]


def _summed(key: np.ndarray, weights: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys below ``span`` in their order, how often each stands there, and the sums of its weights."""
    if span <= 8 * len(key):
        n = np.bincount(key, minlength=span)
        at = np.flatnonzero(n)
        return at, n[at], [np.bincount(key, w, span)[at] for w in weights]
    order = np.argsort(key) if weights else None
    key = np.sort(key) if order is None else key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.diff(np.append(first, len(key))), [np.add.reduceat(w[order], first) for w in weights]


def _pairs(left: list[np.ndarray], own: list[np.ndarray], right: _Right, chunk: int, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The pairs of a slice of g's with all rows that it has, some at a time."""
    g, k, a = left
    order = np.argsort(g, kind="stable")
    g, k, a, many = g[order], k[order], a[order], len(right.ids)
    ids, first, code, rows = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
    total = np.add.reduceat(a, first)
    place = np.minimum(np.searchsorted(right.keys, k), len(right.keys) - 1)
    met = right.keys[place] == k
    code, place, a = code[met], place[met], a[met]
    if own:
        og, od, ov = own
        x, y = np.minimum(np.searchsorted(ids, og), len(ids) - 1), np.minimum(np.searchsorted(right.ids, od), many - 1)
        here = (ids[x] == og) & (right.ids[y] == od)
        at = x[here] * many + y[here]
        by = np.argsort(at)
        own_at, own_value = at[by], ov[here][by]
    count = right.at[place + 1] - right.at[place]
    upto = np.concatenate(([0], np.cumsum(count)))
    starts = np.append(np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))), len(code)) if len(code) else np.zeros(1, np.int64)

    def products(lo, hi):
        n = count[lo:hi]
        at = np.repeat(right.at[place[lo:hi]] - (upto[lo:hi] - upto[lo]), n) + np.arange(upto[hi] - upto[lo])
        key = np.repeat((code[lo:hi] - code[lo]) * many, n) + right.code[at]
        return key, [np.repeat(a[lo:hi], n) * w[at] for w in right.weights]

    def out(base, at, n, sums):
        x, y = base + at // many, at % many
        found = {"g": ids[x], "d": right.ids[y], "n": n, "rows": rows[x], "total": total[x]} | {f"s{i}": s for i, s in enumerate(sums)}
        if "attribute" in names:
            found["attribute"] = right.attribute[y]
        if own:
            key = base * many + at
            p = np.minimum(np.searchsorted(own_at, key), max(len(own_at) - 1, 0))
            found["own"] = np.where(own_at[p] == key, own_value[p], np.nan) if len(own_at) else np.full(len(at), np.nan)
        elif "own" in names:
            found["own"] = np.full(len(at), np.nan)
        return found

    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(upto[starts], upto[starts[i]] + chunk, "right")) - 1)
        lo, hi, base = starts[i], starts[j], code[starts[i]]
        if upto[hi] - upto[lo] <= chunk:
            yield out(base, *_summed(*products(lo, hi), (code[hi - 1] - base + 1) * many))
        else:
            # One g alone: its rows by turns, into sums that hold every d.
            n, sums = np.zeros(many, np.int64), [np.zeros(many) for _ in right.weights]
            while lo < hi:
                end = max(lo + 1, int(np.searchsorted(upto, upto[lo] + chunk, "right")) - 1)
                key, weights = products(lo, min(end, hi))
                n += np.bincount(key, minlength=many)
                for s, w in zip(sums, weights, strict=True):
                    s += np.bincount(key, w, many)
                lo = end
            at = np.flatnonzero(n)
            yield out(base, at, n[at], [s[at] for s in sums])
        i = j


def products(left: DataFrame, right: DataFrame, columns: list[str], own: DataFrame | None = None, attribute: bool = False, each: Callable | None = None) -> DataFrame:
    """(g, d, *columns) of every pair that a key joins; ids come out as long.

    left: (g, k) or (g, k, a); right: (k, d, weights ..., and an attribute of d if ``attribute``); own: (g, d, value), one row a pair at most.
    Columns: n, the number of joined rows; s0, s1, ..., sums of a times each weight; own, the pair's value, null if it has none; rows and
    total, the number of left rows of g and the sum of their a, joined or not; attribute. ``each`` takes the arrays of some pairs, all
    of a g's in one block of d's, and gives the arrays that leave instead.
    """
    spark = left.sparkSession
    gk, kd = left.columns, right.columns
    id_of = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NULL))
    had = [hasattr(df, "_written_to") for df in (left, right)]
    left = left.where(F.col(gk[1]).isNotNull()).select(id_of(gk[0]).alias("g"), F.col(gk[1]).cast("long").alias("k"), (F.col(gk[2]).cast("double") if len(gk) > 2 else F.lit(1.0)).alias("a"))
    right = right.where(F.col(kd[0]).isNotNull()).select(F.col(kd[0]).cast("long").alias("k"), id_of(kd[1]).alias("d"), *[F.col(c).cast("double").alias(f"w{i}") for i, c in enumerate(kd[2:])])
    left, right = (df if before else written(df) for df, before in zip((left, right), had, strict=True))
    many, weights = left.count(), len(kd) - 2 - attribute
    across = max(1, ceil(right.count() / RIGHT))
    down = max(1, ceil(many / LEFT), ceil(4 * spark.sparkContext.defaultParallelism / across))
    subs = max(down, ceil(many / SLICE))
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none, rest = F.lit(0), ["sub", "kind", "n", "payload"]
    cell = (F.col("gb") * across + F.col("db")).alias("cell")
    gs = ds = met = None
    if across > 1:
        gs, ds = _bounds(left, "g", down), _bounds(right, "d", across)
        down, met = len(gs) + 1, _shared(left, right, gs, ds)
    in_g, in_d = (bucket("g", subs), bucket("d", across)) if met is None else (bucket("g", ceil(subs / down)), none)
    of_left, of_right = _packed(left, "left", [in_g, none], gs).drop("db").withColumn("gb", F.col("sub") % down), _packed(right, "right", [none, in_d], None, ds)
    parts = [of_left.withColumn("db", every(across)), of_right.withColumn("gb", every(down))] if met is None else [of_left.join(met, "gb"), of_right.join(met, "db")]
    if own is not None:
        og, od, ov = own.columns
        given = own.where(F.col(og).isNotNull() & F.col(od).isNotNull()).select(F.col(og).cast("long").alias("g"), F.col(od).cast("long").alias("d"), F.col(ov).cast("double").alias("v"))
        of_own = _packed(given, "own", [in_g, in_d], gs, ds).withColumn("gb", F.col("sub") % down)
        parts.append(of_own if met is None else of_own.join(met, ["gb", "db"]))
    cells = parts[0].select(cell, *rest)
    for part in parts[1:]:
        cells = cells.unionAll(part.select(cell, *rest))
    names = ["g", "d", *columns]
    types = [_TYPES.get(c, pa.float64()) for c in names]
    chunk, has_own, layout = CHUNK, own is not None, [np.int64, np.int64, np.float64]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {"left": {}, "right": {}, "own": {}}
        for batch in batches:
            for sub, kind, n, payload in zip(*[batch.column(c).to_pylist() for c in rest], strict=True):
                held[kind].setdefault(sub, []).append((n, payload))
        if not held["left"] or not held["right"]:
            return
        side = _Right([p for ps in held.pop("right").values() for p in ps], weights, attribute)
        for sub, payloads in held["left"].items():
            mine = _unpacked(held["own"].get(sub, []), layout) if has_own else []
            for found in _pairs(_unpacked(payloads, layout), mine, side, chunk, names):
                found = each(found) if each else found
                arrays = [pa.array(found[c], t, from_pandas=c == "own") for c, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = ", ".join(f"{c} {'long' if c in _TYPES else 'double'}" for c in names)
    found = cells.repartition(down * across if met is None else max(1, met.count()), "cell").groupBy("cell").applyInArrow(run, schema)
    real = lambda c: F.when(F.col(c) != _NULL, F.col(c)).alias(c)
    return found.select(real("g"), real("d"), *columns)
