"""Extractors for nested records: targets, safety, associations, drugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import capped_list


def first_where(values: Column, test, field: str) -> Column:
    """A field of the first element that passes; null if none does."""
    return F.get(F.filter(values, test), F.lit(0))[field]


def target_facts(targets: DataFrame) -> DataFrame:
    """(id, class_l1, tractable kinds, location flags): null lists give nulls, empty ones give none.

    targets: id, targetClass array<struct<id,label,level>>, tractability array<struct<modality,id,value>>, subcellularLocations array<struct<location,...>>.
    """
    assessed = F.col("tractability").isNotNull()
    kind = lambda m: F.when(assessed, F.exists("tractability", lambda t: (t["modality"] == m) & t["value"]).cast("long"))
    buckets = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("tractability", lambda t: (t["modality"] == "SM") & t["value"]), lambda t: t["id"]))), "|")
    known = F.col("subcellularLocations").isNotNull()
    place = lambda w: F.when(known, F.exists("subcellularLocations", lambda x: F.lower(x["location"]).contains(w)).cast("long"))
    return targets.select("id", first_where(F.col("targetClass"), lambda c: c["level"] == "l1", "label").alias("class_l1"), kind("SM").alias("sm_tractable"), kind("AB").alias("ab_tractable"), buckets.alias("sm_buckets"), place("membrane").alias("is_membrane"), place("secreted").alias("is_secreted"))


def safety_facts(records: DataFrame, cap: int = 5) -> DataFrame:
    """(id, n_events, events, directions, loss-of-function score): never assessed stays null, assessed and clean is 0."""
    events = F.transform("safetyLiabilities", lambda s: s["event"])
    directions = F.flatten(F.transform("safetyLiabilities", lambda s: F.transform(F.coalesce(s["effects"], F.array().cast("array<struct<direction:string,dosing:string>>")), lambda e: e["direction"])))
    count = F.when(F.col("safetyLiabilities").isNotNull(), F.size(F.array_distinct(events)).cast("long"))
    score = first_where(F.col("constraint"), lambda c: c["constraintType"] == "lof", "oeUpper")
    return records.select("id", count.alias("n_events"), capped_list(events, cap).alias("events"), F.array_join(F.array_sort(F.array_distinct(directions)), "|").alias("directions"), score.alias("oe_upper"), F.when(score.isNotNull(), (score < 0.35).cast("long")).alias("lof_intolerant"))


def associations(rows: DataFrame, excluded: list[str], least: float = 0.3) -> DataFrame:
    """(targetId, diseaseId, datatypes): pairs of a score of ``least`` or more, their kinds of evidence joined."""
    kept = rows.where((F.col("associationScore") >= least) & ~F.col("aggregationValue").isin(excluded))
    return kept.groupBy("targetId", "diseaseId").agg(F.array_join(F.array_sort(F.collect_set("aggregationValue")), "+").alias("datatypes"))


def drug_targets(mechanisms: DataFrame) -> DataFrame:
    """(drug, target, action): two lists unfolded against each other (explode of both)."""
    return mechanisms.select(F.explode("chemblIds").alias("drug"), "targets", "actionType").select("drug", F.explode("targets").alias("target"), F.col("actionType").alias("action")).distinct()


def first_reference(drugs: DataFrame, source: str) -> DataFrame:
    """(id, reference): the first id of the first cross reference of a source."""
    return drugs.select("id", F.get(first_where(F.col("crossReferences"), lambda c: c["source"] == source, "ids"), F.lit(0)).alias("reference"))
