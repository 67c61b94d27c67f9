"""The read layer: one function per endpoint, each returning a DataFrame that is small by its filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalar import top_by_magnitude
from .operators.evaluate import gap_profile
from .operators.ranking import strict_percentile
from .sources.readers import append_event
from .streaming.events import keep_snapshot, newest_by_key


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, status, n): for each table that is served its rows, "ok" or "empty"."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.when(F.col("n") > 0, "ok").otherwise("empty").alias("status"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def candidate_diseases(candidates: DataFrame) -> DataFrame:
    """Diseases with candidates and how many they have."""
    return candidates.groupBy("disease_index").agg(F.count("*").alias("n_candidates"))


def candidates(ranked: DataFrame, disease: int, novel: bool = False, max_rank: int | None = None, where=None, page: int = 0, size: int | None = None) -> DataFrame:
    """A disease's list in serve order (rank, gene_index), filtered, a page of it if ``size`` is given."""
    df = ranked.where(F.col("disease_index") == disease)
    if novel:
        df = df.where("is_target = 0")
    if max_rank is not None:
        df = df.where(F.col("rank") <= max_rank)
    if where is not None:
        df = df.where(where)
    df = df.orderBy("rank", "gene_index")
    return df.offset(page * size).limit(size) if size else df


def funnel(ranked: DataFrame, steps: dict) -> DataFrame:
    """How many rows are left after each step, in one pass."""
    through, parts = F.lit(True), [F.count("*").alias("all")]
    for name, condition in steps.items():
        through = through & F.coalesce(condition, F.lit(False))
        parts.append(F.count_if(through).alias(name))
    return ranked.agg(*parts)


def gene_profile(scored: DataFrame, disease: int, gene: int, features: list[str]) -> DataFrame:
    """(feature, value, percentile): each feature's share of strictly weaker genes in the disease's pool; null stays null."""
    pool = scored.where(F.col("disease_index") == disease).select("disease_index", "gene_index", *[F.col(f).cast("double").alias(f) for f in features])
    long = pool.unpivot(["disease_index", "gene_index"], features, "feature", "value")
    return strict_percentile(long, "feature", "value").where(F.col("gene_index") == gene).select("feature", "value", "percentile")


def identity(genes: DataFrame, gene: int) -> DataFrame:
    return genes.where(F.col("gene_index") == gene)


def drugs(records: DataFrame, disease: int, gene: int) -> DataFrame:
    """Drug records of a pair with actions joined, in the order of clinical stages."""
    from .operators.ranking import domain_order

    stage = domain_order("relation", ["Indication", "drug_investigated_for", "contraindication"])
    some = records.where((F.col("disease_index") == disease) & (F.col("gene_index") == gene)).withColumn("stage", stage)
    return some.groupBy("drug", "relation", "stage").agg(F.array_join(F.array_sort(F.collect_set("action")), "|").alias("actions")).orderBy("stage", "drug")


def drivers(explained: DataFrame, disease: int, gene: int, n: int = 5) -> DataFrame:
    """(name, value): the explanation's largest parts."""
    one = explained.where((F.col("disease_index") == disease) & (F.col("gene_index") == gene))
    return one.select(F.explode(top_by_magnitude(F.col("explanations"), n)).alias("d")).select("d.*")


def evidence(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def calibration(page: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """(section, name, value) of the calibration page (E30), or of some of its sections."""
    return page if sections is None else page.where(F.col("section").isin(sections))


def families(panel: DataFrame) -> DataFrame:
    return panel.groupBy("family_id").agg(F.count("*").alias("n_terms")).orderBy("family_id")


def family(overlap: DataFrame, family_id: int) -> DataFrame:
    return gap_profile(overlap.where(F.col("family_id") == family_id))


_REVIEW = T.StructType([T.StructField("event_key", T.StringType()), T.StructField("disease_index", T.LongType()), T.StructField("gene_index", T.LongType()), T.StructField("verdict", T.StringType()), T.StructField("note", T.StringType()), T.StructField("at", T.TimestampType())])


def post_review(spark: SparkSession, folder: str, review: dict) -> None:
    """One review as an event of its own; a verdict needs a note."""
    if not (review.get("note") or "").strip():
        raise ValueError("a review needs a note")
    append_event(spark, folder, review)


def reviews(spark: SparkSession, folder: str, state: str, files_per_trigger: int = 100) -> DataFrame:
    """The latest review of each pair: a stream over the folder's events, which goes on from where the last call stopped.

    ``state`` holds the stream's position and the compacted snapshot. An empty folder gives an empty table.
    """
    stream = spark.readStream.schema(_REVIEW).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    key = ["disease_index", "gene_index"]
    kept = keep_snapshot(newest_by_key(stream, key, "at", "event_key"), key, f"{state}/snapshots", f"{state}/stream")
    return kept if kept is not None else spark.createDataFrame([], _REVIEW)
