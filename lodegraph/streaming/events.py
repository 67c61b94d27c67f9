"""Structured Streaming over events: windowed counts with a watermark, the newest event a key kept as state with compacted snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, with the folder's schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): state of a window is kept until the watermark passes it. Works on batches too."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = source.withWatermark("ts", late) if events.isStreaming else source
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """What all files present now give, through a memory sink named ``name``."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def newest_by_key(events: DataFrame, key: list[str], at: str, event_key: str) -> DataFrame:
    """The newest event of each key, ties going to the greatest event key (S16); on a stream, one row of state a key.

    An event that comes late is older than what the state holds and changes nothing, one that comes twice is what it holds: the
    result doesn't depend on the order or the number of times in which events arrive.
    """
    rest = [c for c in events.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(at), F.col(event_key)))
    return events.groupBy(*key).agg(newest.alias("e")).select(*key, *[F.col(f"e.{c}").alias(c) for c in rest])


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Whole snapshots in a folder, by number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(done(f"{folder}/{n}/_SUCCESS")))


def snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest compacted snapshot, if there is one."""
    found = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/v{found[-1]}") if found else None


def keep_snapshot(newest: DataFrame, key: list[str], folder: str, checkpoint: str) -> DataFrame | None:
    """Run a stream of newest events over all that is there now, and return the compacted table of one row a key.

    Each batch writes the last snapshot with its changed keys replaced as a table of its own, under the batch's number: a batch that is
    run again writes the same table. The one before stays for whoever reads it, older ones go.
    """
    spark = newest.sparkSession

    def merge(changed: DataFrame, batch: int) -> None:
        session = changed.sparkSession
        before = [v for v in _versions(session, folder) if v < batch]
        if before:
            old = session.read.parquet(f"{folder}/v{before[-1]}")
            changed = changed.unionByName(old.join(changed.select(*key), key, "left_anti"))
        changed.write.mode("overwrite").parquet(f"{folder}/v{batch}")
        for v in before[:-1]:
            gone = session._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{v}")
            gone.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(gone, True)

    newest.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return snapshot(spark, folder)
