"""Sources and sinks (S1-S19). Every reader takes an explicit schema: ids stay text, whatever they look like."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, condition=None, sample: float | None = None, seed: int = 0) -> DataFrame:
    """A Parquet table, its columns, rows and sample; columns and conditions reach the scan."""
    df = spark.read.parquet(path)
    if condition is not None:
        df = df.where(condition)
    if sample is not None:
        df = df.sample(sample, seed)
    return df.select(*columns) if columns else df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, header: bool = False, comment: str | None = None, null: str | None = None, sep: str = "\t") -> DataFrame:
    """Delimited text, gzip or not, with comment lines and a token for nulls."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", "").option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    if null is not None:
        reader = reader.option("nullValue", null)
    return reader.csv(path)


def read_named(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """A file with a header, by names; raises if one is missing."""
    head = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in columns if c not in head.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return head.select(*columns)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, rows: int) -> DataFrame:
    """A CSV that must have so many rows."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    found = df.count()
    if found != rows:
        raise ValueError(f"{path} has {found} rows, not {rows}")
    return df


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, is_obsolete, parents, xrefs) of an OBO file's terms (S9). Parents that no stanza defines come as terms without a name."""
    lines = spark.read.option("lineSep", "\n[").text(path)
    return obo_terms(lines, "value")


def obo_terms(stanzas: DataFrame, column: str) -> DataFrame:
    body = stanzas.where(F.col(column).rlike(r"^\[?Term\]"))
    one = lambda tag: F.nullif(F.regexp_extract(F.col(column), rf"(?m)^{tag}: *([^\n]*?) *$", 1), F.lit(""))
    every = lambda tag: F.regexp_extract_all(F.col(column), F.lit(rf"(?m)^{tag}: *([^ \n]+)"), F.lit(1))
    terms = body.select(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"), every("is_a").alias("parents"), every("xref").alias("xrefs"))
    loose = terms.select(F.explode("parents").alias("id")).distinct().join(terms, "id", "left_anti")
    return terms.unionByName(loose, allowMissingColumns=True)


def obo_edges(terms: DataFrame) -> DataFrame:
    return terms.select(F.explode("parents").alias("parent"), F.col("id").alias("child")).distinct()


def slim(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column starts with a prefix, without it."""
    return df.where(F.col(column).startswith(prefix)).withColumn(column, F.regexp_replace(column, f"^{prefix}", ""))


def inside_both(links: DataFrame, members: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Links whose ends both are members."""
    return links.join(members.select(F.col(key).alias(x)).distinct(), x, "left_semi").join(members.select(F.col(key).alias(y)).distinct(), y, "left_semi")


def commit_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text, whole or not at all; False if it is there already, whoever wrote it.

    The text is written beside it and renamed without overwriting, which a shared file system does in one step.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop = jvm.org.apache.hadoop.fs
    to, own = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = to.getFileSystem(conf)
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(own), fs.makeQualified(to), options)
        return True
    except Py4JJavaError as e:
        fs.delete(own, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise


def pin(spark: SparkSession, source: str, folder: str, version: str) -> dict:
    """Copy a file once to a folder on shared storage and note its size, hash and version; a pinned file is never overwritten, a changed one raises.

    A task reads the file and hashes it; only the hash comes to the driver. The copy is named by its hash, so writers of equal contents
    agree, and the note is created only if there is none: of two writers the second gets the first one's note. ``source`` is one file of
    at most 2 GB.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop = jvm.org.apache.hadoop.fs
    content = spark.read.format("binaryFile").load(source).select("path", "length", F.sha2("content", 256).alias("sha256"))
    path, size, digest = content.collect()[0]
    name = path.rsplit("/", 1)[-1]
    copy, note = f"{folder.rstrip('/')}/{digest}/{name}", f"{folder.rstrip('/')}/{name}.json"
    at, to = hadoop.Path(path), hadoop.Path(copy)
    fs = to.getFileSystem(conf)
    if not fs.exists(to):
        part = hadoop.Path(f"{copy}.{uuid.uuid4().hex}")
        hadoop.FileUtil.copy(at.getFileSystem(conf), at, fs, part, False, conf)
        # Another writer of the same content may have been first.
        if not fs.rename(part, to):
            fs.delete(part, False)
    found = {"file": name, "bytes": size, "sha256": digest, "version": version}
    if commit_once(spark, note, json.dumps(found)):
        return found
    pinned = json.loads(spark.read.text(note, wholetext=True).first()[0])
    if pinned["sha256"] != digest:
        raise ValueError(f"{name} was pinned with another content")
    return pinned


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A table with its schema, replaced as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_outputs(plan: DataFrame, outputs: dict[str, DataFrame]) -> None:
    """Several tables from one plan that is computed once."""
    plan.persist()
    try:
        for path, df in outputs.items():
            write_table(df, path)
    finally:
        plan.unpersist()


def merge_copies(copies: dict[str, DataFrame], key: str, version: str) -> DataFrame:
    """One table of several copies: of each key the row of the newest version, with the name of its copy in ``copy``.

    Equal versions: the copy whose name comes first.
    """
    named = [df.withColumn("copy", F.lit(name)) for name, df in copies.items()]
    every = named[0]
    for df in named[1:]:
        every = every.unionByName(df)
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), "copy")
    return every.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def append_event(spark: SparkSession, folder: str, event: dict) -> None:
    """One event as a JSON file of its own; none is ever changed."""
    body = json.dumps(event | {"event_key": event.get("event_key", uuid.uuid4().hex)}, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("append").text(folder)


class TableCache:
    """DataFrames persisted by path and version, the least recently used going first.

    A path whose version can't be read is read anew once a ``bucket`` of seconds, by ``clock``.
    """

    def __init__(self, spark: SparkSession, size: int = 32, bucket: int = 300, clock: Callable[[], float] = time.time):
        self.spark, self.size, self.bucket, self.clock, self.held = spark, size, bucket, clock, {}

    def stamp(self, path: str) -> str:
        """The newest change and the total size of the files at a path, through the store's own file system."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        found = [(s.getModificationTime(), s.getLen()) for s in fs.listStatus(at)]
        return f"{max((t for t, _ in found), default=0)}-{sum(n for _, n in found)}"

    def version(self, path: str) -> str:
        try:
            return self.stamp(path)
        except Py4JError:
            return f"unread:{int(self.clock() // self.bucket)}"

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def get(self, path: str) -> DataFrame:
        version = self.version(path)
        if path in self.held and self.held[path][0] == version:
            self.held[path] = self.held.pop(path)
            return self.held[path][1]
        if path in self.held:
            self.held.pop(path)[1].unpersist()
        df = self.read(path).persist()
        self.held[path] = version, df
        while len(self.held) > self.size:
            self.held.pop(next(iter(self.held)))[1].unpersist()
        return df
