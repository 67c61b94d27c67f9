"""What the operators of this package share: Arrow passes; written intermediates and components come from the library."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import connected_components, release, shared_dir  # noqa: F401
from ..operators.store import written as materialize  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of an Arrow batch of texts between Spark and Python.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable, rows: int = 256) -> DataFrame:
    """df with columns that ``make()(record_batch)`` computes, in one Arrow pass without a shuffle.

    ``make`` runs once per task. Batches are cut to ``rows`` rows, so memory follows the longest texts of so many rows; Spark's own
    batches, which both sides hold whole, are kept to BATCH_ROWS rows by the session's setting, if that is larger.
    A column of df whose name a new field takes (whatever its case) is replaced.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    taken = {f.name.lower() for f in fields}
    base = df.select(*[col(c) for c in df.columns if c.lower() not in taken])
    names = [*base.columns, *[f.name for f in fields]]

    def run(batches):
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *step(part)], names=names)
        # Workers live on from task to task: what the last one took is given back.
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields]))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


#: Pairs of rows in open keys for each row, at most, that are compared without splitting the keys.
CROWDED = 64


def _ends(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each row with the least and the greatest node of its key: linear in the rows of a key, however many."""
    ends = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    both = F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b"))))
    return rows.join(ends, "key").select(both.alias("p")).select("p.a", "p.b").where("a < b").distinct()


def _open(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows (key, node, root) of keys whose nodes the edges leave in several components."""
    roots = connected_components(edges)
    labelled = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    return labelled.join(mixed, "key")


def linked_groups(rows: DataFrame, attributes: DataFrame, alike: Column, verify: Callable, split: Callable | None = None) -> DataFrame:
    """(a, b): verified edges whose components are those of all pairs of nodes that share a key, are ``alike`` and pass ``verify``.

    rows: (key, node); attributes: node and other columns, one row a node. ``alike`` is a cheap condition on the columns of both
    nodes, named x_a and x_b for x; ``verify`` takes pairs (a, b) to those that pass. First each node meets
    one other, the least node of its keys. Keys that these edges leave in several components are stars then: their nodes meet
    the least and the greatest one. Of what is still apart, all pairs of different components meet, and only those that are
    alike leave that join. So a dense group of alike
    nodes costs a few times its rows, and no pair that could join two components is left out. ``split`` takes crowded keys'
    rows to finer keys that every alike pair still shares.
    """
    columns = [c for c in attributes.columns if c != "node"]
    side = lambda s, df, *more: df.select(*more, F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a", attributes), "a").join(side("b", attributes), "b").where(alike).select("a", "b")

    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "lo")
    kept = materialize(rows.join(shared, "key").distinct())
    tested = materialize(near(kept.groupBy(F.col("node").alias("b")).agg(F.min("lo").alias("a")).where("a < b").select("a", "b")))
    edges = verify(tested)

    mixed = materialize(_open(kept.select("key", "node"), edges).select("key", "node"))
    release(kept)
    sizes = mixed.groupBy("key").count().agg(F.sum("count").alias("rows"), F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).first()
    crowded = split is not None and (sizes["pairs"] or 0) > CROWDED * (sizes["rows"] or 0)
    parts = materialize(split(mixed)) if crowded else mixed
    again = materialize(near(_ends(_open(parts, edges).select("key", "node") if crowded else parts).join(tested, ["a", "b"], "left_anti")))
    more = verify(again)
    edges2, tested2 = materialize(edges.unionAll(more)), materialize(tested.unionAll(again))
    release(tested, again, edges, more)

    rest = materialize(_open(parts, edges2).select("key", "node", "root").join(attributes, "node"))
    one, other = (side(x, rest, "key", F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = one.join(other, "key").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & alike).select("a", "b").distinct()
    last = materialize(apart.join(tested2, ["a", "b"], "left_anti"))
    final = verify(last)
    every = materialize(edges2.unionAll(final))
    release(mixed, *([parts] if crowded else []), edges2, tested2, rest, last, final)
    return every
