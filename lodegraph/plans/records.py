"""Registered queries for nested records, pinned files, caches, copies, dates and the calibration endpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import serving
from ..functions import scalar
from ..sources import nested, readers
from .registry import SQL, query
from .relational import _scratch

# Drugs of a mechanism: an order's customer and the one after; targets: two parts named by its key.


@query("n_drug_targets", "", """
SELECT DISTINCT drug, target, o_orderstatus AS action FROM (SELECT unnest([o_custkey, o_custkey + 1]) AS drug, o_orderkey, o_orderstatus FROM orders),
  (SELECT o_orderkey AS k, unnest([o_orderkey % 50, o_orderkey % 7 + 100]) AS target FROM orders) WHERE o_orderkey = k""")
def _(r):
    o = r.table("orders")
    lists = o.select(F.array("o_custkey", F.col("o_custkey") + 1).alias("chemblIds"), F.array(F.col("o_orderkey") % 50, F.col("o_orderkey") % 7 + 100).alias("targets"), F.col("o_orderstatus").alias("actionType"))
    return nested.drug_targets(lists)


@query("n_first_reference", "", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_brand ELSE p_type END AS reference FROM part")
def _(r):
    p, kind = r.table("part"), F.col("p_size") % 3
    one = lambda source, *ids: F.struct(F.lit(source).alias("source"), F.array(*ids).alias("ids"))
    found = F.when(kind == 0, F.array(one("other", F.col("p_name")))).when(kind == 1, F.array(one("other", F.col("p_name")), one("wanted", F.col("p_brand"), F.col("p_type")))).otherwise(F.array(one("wanted", F.col("p_type")), one("wanted", F.col("p_brand"))))
    return nested.first_reference(p.select(F.col("p_partkey").alias("id"), found.alias("crossReferences")), "wanted")


@query("n_safety_facts", "", """
SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 0 ELSE 3 END::BIGINT AS n_events, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN '' ELSE 'a; b +1 more' END AS events,
  CASE WHEN p_size % 4 IN (0, 1) THEN CASE WHEN p_size % 4 = 1 THEN '' END WHEN p_size % 4 = 2 THEN 'down|up' ELSE 'up' END AS directions,
  CASE WHEN p_size % 5 > 0 THEN p_size / 100.0 END AS oe_upper, CASE WHEN p_size % 5 > 0 THEN CAST(p_size / 100.0 < 0.35 AS BIGINT) END AS lof_intolerant FROM part""")
def _(r):
    size = F.col("p_size")
    effect = lambda *d: F.array(*[F.struct(F.lit(x).alias("direction"), F.lit("any").alias("dosing")) for x in d])
    event = lambda name, effects: F.struct(F.lit(name).alias("event"), effects.alias("effects"))
    none = F.array().cast("array<struct<event:string,effects:array<struct<direction:string,dosing:string>>>>")
    missing = F.lit(None).cast("array<struct<direction:string,dosing:string>>")
    rows = F.array(event("b", F.when(size % 4 == 2, effect("up", "down")).otherwise(effect("up"))), event("a", missing), event("c", effect("up")), event("a", effect("up")))
    liabilities = F.when(size % 4 == 0, None).when(size % 4 == 1, none).otherwise(rows)
    lof = F.struct(F.lit("lof").alias("constraintType"), (size / 100.0).alias("oeUpper"))
    constraint = F.when(size % 5 > 0, F.array(F.struct(F.lit("syn").alias("constraintType"), F.lit(9.0).alias("oeUpper")), lof)).otherwise(F.array(F.struct(F.lit("mis").alias("constraintType"), F.lit(9.0).alias("oeUpper"))))
    return nested.safety_facts(r.table("part").select(F.col("p_partkey").alias("id"), liabilities.alias("safetyLiabilities"), constraint.alias("constraint")), cap=2)


@query("s12_pinned_file", "", "SELECT 'nations.txt' AS file, CAST(octet_length(encode(b)) AS BIGINT) AS bytes, sha256(b) AS sha256, '1' AS version FROM (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS b FROM nation)")
def _(r):
    folder = _scratch(r, "pins")
    r.table("nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(f"{folder}/source")
    hadoop, conf = r.spark._jvm.org.apache.hadoop.fs, r.spark._jsparkSession.sessionState().newHadoopConf()
    fs = hadoop.Path(folder).getFileSystem(conf)
    fs.rename(fs.globStatus(hadoop.Path(f"{folder}/source/part-*"))[0].getPath(), hadoop.Path(f"{folder}/nations.txt"))
    pinned = readers.pin(r.spark, f"{folder}/nations.txt", f"{folder}/kept", "1")
    assert readers.pin(r.spark, f"{folder}/nations.txt", f"{folder}/kept", "2") == pinned
    return r.spark.createDataFrame([(pinned["file"], pinned["bytes"], pinned["sha256"], pinned["version"])], "file string, bytes long, sha256 string, version string")


@query("s18_table_cache", "", "SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS step, unnest([n, n, 2 * n]) AS rows FROM (SELECT count(*) AS n FROM region)")
def _(r):
    path = _scratch(r, "cached")
    r.table("region").write.parquet(path)
    cache, rows = readers.TableCache(r.spark, size=2), []
    for step in (1, 2, 3):
        if step == 3:
            r.table("region").write.mode("append").parquet(path)
        rows.append((step, cache.get(path).count()))
    return r.spark.createDataFrame(rows, "step long, rows long")


@query("s19_merged_copies", "", """
WITH c AS (SELECT 'a' AS copy, o_custkey AS id, o_orderkey AS version, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b', o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0)
SELECT id, version, v, copy FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, copy) AS r FROM c) WHERE r = 1""")
def _(r):
    o = r.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("v"))
    return readers.merge_copies({"a": o.where("version % 2 = 0"), "b": o.where("version % 3 = 0")}, "id", "version")


@query("f_month_path", "", "SELECT strftime(o_orderdate, '%Y/%m') AS path, count(*) AS n FROM orders GROUP BY 1")
def _(r):
    return r.table("orders").groupBy(scalar.month_path(F.col("o_orderdate")).alias("path")).agg(F.count("*").alias("n"))


@query("f_row_fingerprint", "scored", """
SELECT count(*) AS n, bit_xor(CAST('0x' || substr(sha256(concat_ws('|', disease_index, gene_index, is_target, n_rows, CAST(round(proba * 100) AS BIGINT), CAST(round(qty * 100) AS BIGINT), CAST(round(tax * 100) AS BIGINT))), 1, 15) AS BIGINT)) AS fingerprint FROM scored""")
def _(r):
    rounded = [F.round(F.col(c) * 100).cast("long").alias(c) for c in ("proba", "qty", "tax")]
    return scalar.row_fingerprint(r.scored().select("disease_index", "gene_index", "is_target", "n_rows", *rounded), ["disease_index", "gene_index", "is_target", "n_rows", "proba", "qty", "tax"])


@query("f_json_leaves", "", "SELECT p_partkey, concat_ws('|', p_name, p_brand, p_type, p_brand) AS leaves FROM part")
def _(r):
    inner = F.struct(F.col("p_brand").alias("c"), F.col("p_size").alias("n"), F.lit(True).alias("flag"))
    doc = F.to_json(F.struct(F.col("p_name").alias("a"), F.array("p_brand", "p_type").alias("b"), F.array(inner).alias("d")))
    return r.table("part").select("p_partkey", doc.alias("doc")).select("p_partkey", F.array_join(scalar.json_leaves("doc"), "|").alias("leaves"))


# Places of the word are sums of the lengths between; it is a mention if neither neighbour is a letter, digit or hyphen.
@query("f_mention_windows", "", """
WITH p AS (SELECT doc_id, length(text) AS n, text, string_split(text, 'the') AS w FROM documents WHERE contains(text, 'the')),
s AS (SELECT doc_id, n, text, unnest(w) AS piece, unnest(range(1, len(w) + 1)) AS k, len(w) AS pieces FROM p),
q AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) + 3 * (k - 1) AS pos, lead(piece) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM s),
m AS (SELECT doc_id, n, text, greatest(pos - 120, 0) AS a, least(pos + 123, n) AS b FROM q WHERE k < pieces
  AND CASE WHEN piece = '' THEN k = 1 ELSE NOT regexp_matches(right(piece, 1), '[A-Za-z0-9-]') END
  AND CASE WHEN after = '' THEN k + 1 = pieces ELSE NOT regexp_matches(left(after, 1), '[A-Za-z0-9-]') END),
i AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY doc_id ORDER BY a, b) THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b) AS place FROM i)
SELECT doc_id, CAST(place - 1 AS BIGINT) AS place, substr(any_value(text), CAST(min(a) + 1 AS BIGINT), CAST(max(b) - min(a) AS BIGINT)) AS window FROM g GROUP BY doc_id, place""")
def _(r):
    """The windows' whole text, in order."""
    found = r.table("documents").select("doc_id", F.posexplode(scalar.mention_windows("text", "the")).alias("place", "window"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), "window")


_SERVED = ["customer", "lineitem", "orders", "part", "supplier"]


@query("api_health", "", " UNION ALL ".join(f"SELECT '{t}' AS name, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) AS n FROM {t}" for t in _SERVED))
def _(r):
    return serving.health({t: r.table(t) for t in _SERVED})


# Events of a user about a number: the newest is the review of that pair.
@query("api_reviews", "", """
SELECT disease_index, gene_index, verdict, note FROM (SELECT user_id AS disease_index, CAST(json_extract_string(props, '$.k') AS BIGINT) AS gene_index, event_type AS verdict, props AS note,
  row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 20, '0') DESC) AS r FROM events) WHERE r = 1""")
def _(r):
    """All events as review files, out of order and a share of them twice, in several batches."""
    folder, e = _scratch(r, "reviews"), r.table("events")
    posted = e.select(
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_key"), F.col("user_id").cast("long").alias("disease_index"), F.get_json_object("props", "$.k").cast("long").alias("gene_index"),
        F.col("event_type").alias("verdict"), F.col("props").alias("note"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at"))
    posted.repartition(6, "event_key").write.json(f"{folder}/events")
    posted.where("event_key % 3 = 0").repartition(2, "event_key").write.mode("append").json(f"{folder}/events")
    return serving.reviews(r.spark, f"{folder}/events", f"{folder}/state", 3).select("disease_index", "gene_index", "verdict", "note")


@query("api_calibration")
def _(r):
    from .studies import calibration_page

    return serving.calibration(calibration_page(r), ["auc", "enrichment", "pool", "leakage"])


SQL["api_calibration"] = f"SELECT * FROM ({SQL['e30_calibration_page']}) WHERE section IN ('auc', 'enrichment', 'pool', 'leakage')"
