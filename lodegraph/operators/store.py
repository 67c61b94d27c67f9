"""Intermediate tables in the folder that driver and executors share, and the connected components that are built on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodegraph-scratch"


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def scratch_path(spark: SparkSession, kind: str = "part") -> str:
    """A fresh path in the shared folder. Where the cluster names none, it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if "lodegraph-scratch" in path:
        at, fs = _at(spark, path)
        fs.mkdirs(at.getParent())
        fs.deleteOnExit(at.getParent())
    return path


#: Spark's own switch to delete the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df from a Parquet copy in the shared folder: cuts the lineage of a loop, and no executor's loss undoes it. A path given is that of a copy to add to.

    The shuffle files of the query that wrote it go at once, as nothing reads them any more.
    """
    spark = df.sparkSession
    path, before = path or scratch_path(spark), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._written_to = path
    return copy


def release(*copies: DataFrame) -> None:
    """Delete the Parquet copies that ``written`` made of these; nothing may read them afterwards."""
    for copy in copies:
        path, fs = _at(copy.sparkSession, copy._written_to)
        fs.delete(path, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge between two nodes, root being the smallest node reachable.

    Alternating large-star and small-star steps; each is two aggregates by key (combined before the shuffle) and a join
    that adaptive execution can split, so a hub costs no more than its edges. Rounds grow with the logarithm of the
    longest chain. Every round is written to the shared folder and the one before deleted. No edge set is ever collected.
    """

    def oriented(x, y):
        return [F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")]

    def state(df):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    e = written(edges.select(*oriented(F.col(a), F.col(b))).where("hi <> lo").distinct())
    before = state(e)
    if before[0] == 0:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(*oriented(F.col("v"), F.col("m"))).where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        moved = small.select(*oriented(F.col("lo"), F.col("m"))).unionAll(down.select("hi", F.col("m").alias("lo")))
        new = written(moved.where("hi <> lo").distinct())
        now = state(new)
        release(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
