"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response, all in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a slice of the table in order of URL and time, on average; a window holds one URL's rows of one slice.
SLICE_ROWS = 50_000
#: Headers of a 304 answer that replace those of the stored response (the fields such an answer carries).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port, fragment, user part, leading "www." and final slash gone, query parameters sorted.

    http and https are one. Null or blank: "". What has no host keeps its form, without the fragment.
    """
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    rest = F.regexp_replace(plain, scheme, "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    full = F.concat(host, path, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))
    return F.when(plain.rlike(scheme), full).otherwise(plain)


def etag_opaque(etag: Column) -> Column:
    """An entity tag for weak comparison: without W/."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def as_of_response(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """records with ``prior``: (ts, record_id, etag, last_modified, status, headers) of the latest full response before each.

    A full response is of type "response" with status 200. Earlier: by (ts, record_id); equal ones aren't earlier than each
    other's rows but stand in some order. The table is range-partitioned by URL and time into slices and written, so a hot URL
    takes many slices; what a slice's first rows inherit comes from the URLs that span slices, at most two a slice. Records with
    no ts are earlier than all others.
    """
    spark = records.sparkSession
    order = [F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first()]
    parts = max(-(-records.count() // slice_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = materialize(records.repartitionByRange(parts, F.col("canonical"), *order).withColumn("slice", F.spark_partition_id()))
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    this = F.when(full, F.struct("ts", "record_id", "etag", "last_modified", "status", "headers"))
    inside = Window.partitionBy("canonical", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumn("near", F.last(this, ignorenulls=True).over(inside))
    spans = sliced.groupBy("canonical").agg(F.min("slice").alias("s0"), F.max("slice").alias("s1")).where("s0 < s1").select("canonical")
    spanning = sliced.join(spans, "canonical", "left_semi")
    # The latest of a slice, by an order that a null ts comes first in.
    latest = F.struct(F.col("ts").isNotNull().alias("dated"), "ts", F.col("record_id").isNotNull().alias("named"), "record_id", "etag", "last_modified", "status", F.to_json("headers").alias("headers"))
    ends = spanning.groupBy("canonical", "slice").agg(F.max(F.when(full, latest)).alias("last"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried IS NOT NULL")
    carried = carried.select("canonical", "slice", F.struct("carried.ts", "carried.record_id", "carried.etag", "carried.last_modified", "carried.status", F.from_json("carried.headers", "map<string,string>").alias("headers")).alias("carried"))
    return near.join(carried, ["canonical", "slice"], "left").withColumn("prior", F.coalesce("near", "carried")).drop("near", "carried", "slice")


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per revisit of the not-modified profile: what it resolves to, if its validators agree.

    records: record_id long, url string, ts long, warc_type string ("response" or "revisit"), status int, etag and
    last_modified string, headers map (names in lower case). Result: record_id, url, canonical, ts, outcome, response_id,
    response_ts, status (the response's), headers (the response's, with the permitted ones of the revisit in their place).

    outcome: "resolved"; "no_response" if no full response of that URL is earlier; "mismatch" if an entity tag that both
    give differs (weak comparison), or, where not both give one, a modification date that both give differs; "unverified" if
    they share no validator. Only "resolved" has response and headers. Repeated rows come back repeated; other columns go.
    """
    kept = records.select("record_id", "url", "ts", "warc_type", "status", "etag", "last_modified", "headers", canonical_url(F.col("url")).alias("canonical"))
    joined = as_of_response(kept, slice_rows).where((F.col("warc_type") == "revisit") & (F.col("status") == 304))
    tag, date = (etag_opaque(F.col("etag")) == etag_opaque(F.col("prior.etag"))), (F.col("last_modified") == F.col("prior.last_modified"))
    outcome = F.when(F.col("prior").isNull(), "no_response").when(F.coalesce(tag, date), "resolved").when(F.coalesce(tag, date).isNull(), "unverified").otherwise("mismatch")
    fresh = F.map_filter(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: k.isin(*PERMITTED))
    stored = F.coalesce("prior.headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    ok = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "canonical", "ts", "outcome",
        F.when(ok, F.col("prior.record_id")).alias("response_id"), F.when(ok, F.col("prior.ts")).alias("response_ts"),
        F.when(ok, F.col("prior.status")).alias("status"), F.when(ok, merged).alias("headers"),
    )


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """resolved revisits with the payload of their response: (record_id, payload) joined by response_id, never broadcast."""
    return resolved.join(payloads.select(F.col("record_id").alias("response_id"), "payload").hint("merge"), "response_id", "left")


def header_text(headers: Column) -> Column:
    """Headers as lines "name: value", sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records for pages, by rule: page_id is the time; three rows of each four are responses, the fourth a revisit.

    A page's site version changes with every 64 pages, which its entity tag and modification date tell; every 7th row gives
    no entity tag, every 11th no date, every 13th response is a 404.
    """
    site = F.concat(F.regexp_extract("url", "//([^/]*)", 1), F.lit("/"))
    version = F.floor(F.col("page_id") / 512).cast("long")
    revisit = F.col("page_id") % 4 == 3
    etag = F.when(F.col("page_id") % 7 != 0, F.concat(F.when(revisit, "W/").otherwise(""), F.lit('"'), version.cast("string"), F.lit('"')))
    date = F.when(F.col("page_id") % 11 != 0, F.concat(F.lit("day "), version.cast("string")))
    status = F.when(revisit, 304).when(F.col("page_id") % 13 == 0, 404).otherwise(200)
    return pages.select(
        F.col("page_id").alias("record_id"),
        F.concat(F.regexp_extract("url", "^([a-z]+:)", 1), F.lit("//"), site, F.concat(F.lit("?b=2&a="), (F.col("page_id") % 3).cast("string"), F.lit("#x"))).alias("url"),
        F.col("page_id").cast("long").alias("ts"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        status.cast("int").alias("status"), etag.alias("etag"), date.alias("last_modified"),
        F.map_filter(
            F.create_map(
                F.lit("etag"), etag, F.lit("last-modified"), date, F.lit("content-length"), F.when(~revisit, F.octet_length("html").cast("string")),
                F.lit("date"), F.concat(F.lit("t"), F.col("page_id").cast("string")), F.lit("content-type"), F.when(~revisit, F.lit("text/html")).otherwise("text/plain"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("headers"),
    )
