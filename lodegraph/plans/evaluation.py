"""Registered queries for ranking evaluation, the read layer and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import serving
from ..functions.scalar import top_by_magnitude
from ..operators import evaluate, joins, ranking
from .registry import query
from .relational import _TOP, _scratch, bin_sql, edges_sql, rounded

_ASC = "rank() OVER (PARTITION BY disease_index ORDER BY {0}) + (count(*) OVER (PARTITION BY disease_index, {0}) - 1) / 2.0"
_AUC = "(sum(CASE WHEN {1} = 1 THEN r END) - sum({1}) * (sum({1}) + 1) / 2.0) / nullif(CAST(sum({1}) AS DOUBLE) * sum(1 - {1}), 0)".replace("{1}", "{0}")


def auc_sql(score: str, label: str = "is_target", source: str = "scored") -> str:
    return f"SELECT disease_index, CAST(sum({label}) AS BIGINT) AS n_pos, CAST(sum(1 - {label}) AS BIGINT) AS n_neg, {_AUC.format(label)} AS auc FROM (SELECT *, {_ASC.format(score)} AS r FROM {source}) GROUP BY 1"


@query("e01_auc_by_group", "scored", f"SELECT disease_index, n_pos, n_neg, round(auc, 6) AS auc FROM ({auc_sql('qty')})")
def _(r):
    return rounded(evaluate.auc_by_group(r.scored(), score="qty"), "auc")


_E3 = """
WITH k AS (SELECT *, rank() OVER (PARTITION BY disease_index ORDER BY qty DESC) AS r, row_number() OVER (PARTITION BY disease_index ORDER BY qty DESC, gene_index) AS f FROM scored),
s AS (SELECT disease_index, CAST(sum(CASE WHEN is_target = 1 THEN r END) AS BIGINT) AS target_rank_sum, CAST(sum(is_target) AS BIGINT) AS n_pos, CAST(sum(1 - is_target) AS BIGINT) AS n_neg, CAST(sum(CASE WHEN f <= 10 THEN is_target ELSE 0 END) AS BIGINT) AS hits_at_10,
 CAST(sum(CASE WHEN f <= 20 THEN is_target ELSE 0 END) AS BIGINT) AS hits_at_20, CAST(sum(CASE WHEN f <= 50 THEN is_target ELSE 0 END) AS BIGINT) AS hits_at_50 FROM k GROUP BY 1),
a AS (SELECT *, 1 - (target_rank_sum - n_pos * (n_pos + 1) / 2.0) / nullif(CAST(n_pos AS DOUBLE) * n_neg, 0) AS auc FROM s),
e AS (SELECT *, CASE WHEN v > 0 THEN sqrt(v) END AS auc_se FROM (SELECT *, (auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (CAST(n_pos AS DOUBLE) * n_neg) AS v FROM a)),
c AS (SELECT *, auc - 1.96 * auc_se AS auc_lo95, auc + 1.96 * auc_se AS auc_hi95 FROM e)
SELECT disease_index, target_rank_sum, n_pos, n_neg, hits_at_10, hits_at_20, hits_at_50, round(auc, 6) AS auc, round(auc_se, 6) AS auc_se, round(auc_lo95, 6) AS auc_lo95, round(auc_hi95, 6) AS auc_hi95,
 CAST(coalesce(auc_hi95 <= 1 AND n_pos >= 30, false) AS BIGINT) AS trustworthy, round(hits_at_20 / CAST(n_pos AS DOUBLE), 6) AS recall_at_20, round(hits_at_50 / CAST(n_pos AS DOUBLE), 6) AS recall_at_50,
 round((hits_at_50 / 50.0) / (n_pos / CAST(n_pos + n_neg AS DOUBLE)), 6) AS enrichment_at_50 FROM c"""


@query("e03_auc_interval", "scored", _E3)
def auc_interval(r):
    return rounded(evaluate.auc_with_interval(r.scored(), score="qty"), "auc", "auc_se", "auc_lo95", "auc_hi95", "recall_at_20", "recall_at_50", "enrichment_at_50")


@query("e02_auc_descending", "scored", f"SELECT disease_index, auc FROM ({_E3})".replace("SELECT disease_index, auc FROM (\nWITH", "WITH").removesuffix(")"))
def _(r):
    return auc_interval(r)


@query("e04_pooled_auc", "scored", """
SELECT CAST(sum(is_target) AS BIGINT) AS n_pos, CAST(sum(1 - is_target) AS BIGINT) AS n_neg, round((sum(CASE WHEN is_target = 1 THEN r END) - sum(is_target) * (sum(is_target) + 1) / 2.0) / (CAST(sum(is_target) AS DOUBLE) * sum(1 - is_target)), 6) AS auc
FROM (SELECT *, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS r FROM scored)""")
def _(r):
    return rounded(evaluate.pooled_auc(r.scored(), "qty"), "auc")


@query("e04_macro_auc", "scored", f"""
SELECT count(*) AS n_groups, round(avg(auc), 6) AS macro, round(quantile_cont(auc, 0.5), 6) AS median, round(min(auc), 6) AS worst, round(max(auc), 6) AS best, count(*) FILTER (auc < 0.5) AS below_chance FROM ({auc_sql('qty')}) WHERE auc IS NOT NULL""")
def _(r):
    return rounded(evaluate.macro_summary(evaluate.auc_by_group(r.scored(), score="qty")), "macro", "median", "worst", "best")


_KNOWN = "k AS (SELECT s.*, CAST(CASE WHEN t.gene_index IS NULL THEN 0 ELSE 1 END AS BIGINT) AS is_known FROM scored s LEFT JOIN truth t ON s.disease_index = t.disease_index AND s.gene_index = t.gene_index)"


@query("e05_target_benchmark", "scored truth", f"""
WITH {_KNOWN}, f AS (SELECT *, row_number() OVER (PARTITION BY disease_index ORDER BY proba DESC, gene_index) AS rank, count(*) OVER (PARTITION BY disease_index) AS pool, {_ASC.format("proba")} AS a FROM k WHERE disease_index IN (SELECT disease_index FROM truth))
SELECT disease_index, max(pool) AS pool, CAST(sum(is_known) AS BIGINT) AS n_known, round(quantile_cont(CASE WHEN is_known = 1 THEN CAST(100.0 * rank / pool AS DOUBLE) END, 0.5), 6) AS median_pct, min(CASE WHEN is_known = 1 THEN rank END) AS best_rank,
 CAST(sum(CASE WHEN rank <= 50 THEN is_known ELSE 0 END) AS BIGINT) AS hits_at_50, CAST(sum(CASE WHEN rank * 100 <= pool THEN is_known ELSE 0 END) AS BIGINT) AS hits_top_1pct, CAST(sum(CASE WHEN rank * 10 <= pool THEN is_known ELSE 0 END) AS BIGINT) AS hits_top_10pct,
 CAST(sum(is_target) AS BIGINT) AS n_assoc, round((sum(CASE WHEN is_known = 1 THEN a END) - sum(is_known) * (sum(is_known) + 1) / 2.0) / nullif(CAST(sum(is_known) AS DOUBLE) * sum(1 - is_known), 0), 6) AS auc_known,
 round((sum(CASE WHEN is_target = 1 THEN a END) - sum(is_target) * (sum(is_target) + 1) / 2.0) / nullif(CAST(sum(is_target) AS DOUBLE) * sum(1 - is_target), 0), 6) AS auc_assoc FROM f GROUP BY 1 HAVING sum(is_known) > 0""")
def _(r):
    return rounded(evaluate.target_benchmark(r.scored(), r.truth()), "median_pct", "auc_known", "auc_assoc")


_LADDER = f"""
WITH {_KNOWN}, st AS (SELECT *, unnest(range(1 + CASE WHEN is_target = 0 THEN CASE WHEN qty >= 20 THEN CASE WHEN n_rows = 1 THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END)) AS stage FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY stage, disease_index ORDER BY proba DESC, gene_index) AS rank FROM st),
s AS (SELECT stage, count(*) AS n_rows, CAST(sum(is_known) AS BIGINT) AS n_known, CAST(sum(CASE WHEN rank <= 50 THEN is_known ELSE 0 END) AS BIGINT) AS hits, count(*) FILTER (rank <= 50) AS picked FROM f GROUP BY 1), b AS (SELECT n_known AS bk, n_rows AS bn FROM s WHERE stage = 0)
SELECT stage, ['all', 'novel', 'large', 'single'][stage + 1] AS name, n_rows, n_known, hits, round(n_known / CAST(bk AS DOUBLE), 6) AS recall, round(n_rows / CAST(bn AS DOUBLE), 6) AS kept, round((hits / CAST(picked AS DOUBLE)) / (bk / CAST(bn AS DOUBLE)), 6) AS lift FROM s, b"""


def _ladder(r, k=50):
    stages = [("novel", F.col("is_target") == 0), ("large", F.col("qty") >= 20), ("single", F.col("n_rows") == 1)]
    return rounded(evaluate.filter_ladder(r.scored(), stages, r.truth(), k=k), "recall", "kept", "lift")


@query("e06_filter_ladder", "scored truth", _LADDER)
def _(r):
    return _ladder(r)


@query("e07_novel_discovery", "scored truth drug_evidence", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY disease_index ORDER BY proba DESC, gene_index) AS rank FROM scored WHERE is_target = 0),
l AS (SELECT 'truth' AS truth, n.disease_index, rank, CASE WHEN t.gene_index IS NULL THEN 0 ELSE 1 END AS linked FROM n LEFT JOIN truth t ON n.disease_index = t.disease_index AND n.gene_index = t.gene_index
 UNION ALL SELECT 'approved', n.disease_index, rank, CASE WHEN t.gene_index IS NULL THEN 0 ELSE 1 END FROM n LEFT JOIN drug_evidence t ON n.disease_index = t.disease_index AND n.gene_index = t.gene_index AND in_approved = 1
 UNION ALL SELECT 'investigated', n.disease_index, rank, CASE WHEN t.gene_index IS NULL THEN 0 ELSE 1 END FROM n LEFT JOIN drug_evidence t ON n.disease_index = t.disease_index AND n.gene_index = t.gene_index AND in_investigated = 1),
p AS (SELECT truth, disease_index, count(*) AS n, sum(linked) AS m, sum(CASE WHEN rank <= 10 THEN linked ELSE 0 END) AS h10, sum(CASE WHEN rank <= 50 THEN linked ELSE 0 END) AS h50 FROM l GROUP BY 1, 2 HAVING count(*) >= 200 AND sum(linked) >= 1),
x AS (SELECT truth, n, m, 10 AS k, h10 AS h FROM p UNION ALL SELECT truth, n, m, 50, h50 FROM p)
SELECT truth, CAST(k AS BIGINT) AS k, count(*) AS n_diseases, CAST(sum(h) AS BIGINT) AS hits, round(sum(least(k, n) * m / CAST(n AS DOUBLE)), 6) AS expected, round(sum(h) / sum(least(k, n) * m / CAST(n AS DOUBLE)), 6) AS lift FROM x GROUP BY 1, 2""")
def _(r):
    # Only the novel pairs are asked for their drugs.
    novel = r.scored().where("is_target = 0").select(*joins.PAIR)
    linked = lambda relation: joins.drug_linked(novel, r.drug_disease(), r.drug_protein(), relation)
    truths = {"truth": r.truth(), "approved": linked("indication"), "investigated": linked("drug_investigated_for")}
    return rounded(evaluate.novel_discovery(r.scored(), truths), "expected", "lift")


@query("e08_filter_outcomes", "scored truth", _LADDER.replace("rank <= 50", "rank <= 20"))
def _(r):
    return _ladder(r, 20)


@query("e09_model_comparison", "scored", f"""
WITH p AS (SELECT 'price' AS model, * FROM ({auc_sql('proba')}) UNION ALL SELECT 'qty', * FROM ({auc_sql('qty')}) UNION ALL SELECT 'tax', * FROM ({auc_sql('tax')})), b AS (SELECT disease_index, auc AS base FROM p WHERE model = 'price' AND auc IS NOT NULL)
SELECT model, round(avg(auc), 6) AS macro_auc, count(*) AS n_diseases, round(avg(auc - base), 6) AS mean_delta, count(*) FILTER (auc - base > 0) AS n_better FROM p JOIN b USING (disease_index) WHERE auc IS NOT NULL GROUP BY 1""")
def _(r):
    out = rounded(evaluate.compare_models(r.scored(), {"price": "proba", "qty": "qty", "tax": "tax"}, "price"), "macro_auc", "mean_delta")
    return out.withColumn("mean_delta", F.col("mean_delta") + 0.0)


@query("e10_attribute_lift", "scored truth genes", f"""
WITH {_KNOWN}, j AS (SELECT k.*, brand, type FROM k JOIN genes g ON k.gene_index = g.gene_index), b AS (SELECT avg(is_target) AS ba, avg(is_known) AS bk FROM j),
l AS (SELECT 'brand' AS attribute, coalesce(brand, '(null)') AS value, is_target, is_known FROM j UNION ALL SELECT 'type', coalesce(type, '(null)'), is_target, is_known FROM j),
g AS (SELECT attribute, value, count(*) AS n, avg(is_target) AS ra, avg(is_known) AS rk FROM l GROUP BY 1, 2 HAVING count(*) >= 200)
SELECT attribute, value, n, round(ra, 6) AS is_target_rate, round(rk, 6) AS is_known_rate, round(ra / ba, 6) AS is_target_lift, round(rk / bk, 6) AS is_known_lift FROM g, b""")
def _(r):
    d = joins.flag_members(r.scored(), r.truth(), joins.PAIR, "is_known").join(r.genes(), "gene_index")
    return rounded(evaluate.attribute_lift(d, ["brand", "type"], ["is_target", "is_known"], 200), "is_target_rate", "is_known_rate", "is_target_lift", "is_known_lift")


_POS = "p AS (SELECT * FROM scored WHERE is_target = 1)"


@query("e11_hub_bias", "scored", f"""
WITH {_POS}, e AS ({edges_sql('qty', 5, 'p')}) SELECT {bin_sql('qty')} AS quintile, count(*) AS n_rows, count(DISTINCT gene_index) AS n_genes, quantile_cont(qty, 0.5) AS median_degree, round(avg(proba), 6) AS mean_score,
 round(100.0 * avg(CASE WHEN proba >= 40000 THEN 1.0 ELSE 0.0 END), 6) AS pct_predicted FROM p, e GROUP BY 1""")
def _(r):
    return rounded(evaluate.hub_bias(r.scored().where("is_target = 1"), "qty", "proba", 40000.0), "mean_score", "pct_predicted")


@query("e12_degree_matched", "scored", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY disease_index ORDER BY tax, gene_index) AS b, count(*) OVER (PARTITION BY disease_index) AS n, row_number() OVER (PARTITION BY disease_index ORDER BY proba DESC, gene_index) AS rank FROM scored),
q AS (SELECT *, 1 + len(list_filter([CAST(0.25 AS DOUBLE), 0.5, 0.75], lambda x: b > 1 + (n - 1) * x)) AS bin FROM t),
g AS (SELECT disease_index, bin, avg(is_target) AS rate, count(*) FILTER (rank <= 50) AS picked, sum(CASE WHEN rank <= 50 THEN is_target ELSE 0 END) AS h FROM q GROUP BY 1, 2)
SELECT disease_index, CAST(sum(h) AS BIGINT) AS hits, round(sum(picked * rate), 6) AS expected, round(sum(h) / sum(picked * rate), 6) AS lift FROM g GROUP BY 1""")
def _(r):
    return rounded(evaluate.degree_matched(r.scored(), "tax", bins=4), "expected", "lift")


@query("e13_ceiling", "truth routes genes diseases", """
WITH c AS (SELECT t.disease_index, CASE WHEN EXISTS (SELECT 1 FROM routes r WHERE r.disease_index = t.disease_index AND r.gene_index = t.gene_index AND dwpc_ggd IS NOT NULL) THEN 'reachable' WHEN t.gene_index NOT IN (SELECT gene_index FROM genes WHERE size > 5) THEN 'gene_absent'
 WHEN t.disease_index NOT IN (SELECT disease_index FROM diseases WHERE family_id > 2) THEN 'disease_absent' ELSE 'no_path' END AS cause FROM truth t)
SELECT cause, count(*) AS n, count(DISTINCT disease_index) AS n_diseases, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM c GROUP BY 1""")
def _(r):
    return rounded(evaluate.reachability_ceiling(r.truth(), r.routes().where("dwpc_ggd is not null"), r.genes().where("size > 5"), r.diseases().where("family_id > 2")), "share")


@query("e13_coverage", "truth routes", """
SELECT t.disease_index, count(*) AS n_known, count(r.gene_index) AS n_reachable, round(count(r.gene_index) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM truth t LEFT JOIN (SELECT DISTINCT disease_index, gene_index FROM routes WHERE dwpc_ggd IS NOT NULL) r ON t.disease_index = r.disease_index AND t.gene_index = r.gene_index GROUP BY 1""")
def _(r):
    return rounded(evaluate.coverage(r.truth(), r.routes().where("dwpc_ggd is not null")), "coverage")


@query("e14_reachability", "scored truth routes", f"""
WITH {_KNOWN}, g AS (SELECT k.disease_index, CASE WHEN is_target = 1 AND is_known = 1 THEN 'both' WHEN is_known = 1 THEN 'drug_only' WHEN is_target = 1 THEN 'assoc_only' ELSE 'neither' END AS grp, qty, dwpc_ggd FROM k JOIN routes r ON k.disease_index = r.disease_index AND k.gene_index = r.gene_index WHERE k.disease_index IN (SELECT disease_index FROM truth)),
l AS (SELECT disease_index, grp, 'qty' AS feature, qty AS value FROM g UNION ALL SELECT disease_index, grp, 'dwpc_ggd', dwpc_ggd FROM g),
p AS (SELECT *, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY disease_index, feature ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY disease_index, feature, value) - 1) / 2.0) / count(value) OVER (PARTITION BY disease_index, feature) END AS pct FROM l)
SELECT grp AS "group", feature, round(avg(pct), 6) AS mean_pct, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM p GROUP BY 1, 2""")
def _(r):
    return rounded(evaluate.reachability_by_group(r.scored().join(r.routes(), joins.PAIR), r.truth(), ["qty", "dwpc_ggd"]), "mean_pct", "null_rate")


@query("e15_supported_auc", "scored routes", f"""
WITH s AS (SELECT * FROM scored WHERE is_target = 0 OR (disease_index, gene_index) NOT IN (SELECT disease_index, gene_index FROM routes WHERE dwpc_gcd IS NOT NULL AND dwpc_ggd IS NULL)) SELECT disease_index, n_pos, n_neg, round(auc, 6) AS auc FROM ({auc_sql('proba', source='s')})""")
def _(r):
    only = F.col("dwpc_gcd").isNotNull() & F.col("dwpc_ggd").isNull()
    return rounded(evaluate.supported_auc(r.scored(), r.routes(), only), "auc")


@query("e16_persona", "scored genes truth", """
SELECT s.disease_index, s.gene_index, CAST(is_target = 0 AS BIGINT) AS novel, CAST(qty >= 30 AS BIGINT) AS large, CAST(size BETWEEN 10 AND 40 AS BIGINT) AS sized, CAST(brand = 'Brand#13' AS BIGINT) AS branded, CAST(proba >= 30000 AS BIGINT) AS strong,
 CAST((is_target = 0)::INT + (qty >= 30)::INT + (size BETWEEN 10 AND 40)::INT + (brand = 'Brand#13')::INT + (proba >= 30000)::INT AS BIGINT) AS n_met FROM scored s JOIN genes g ON s.gene_index = g.gene_index""")
def _(r):
    c = {"novel": F.col("is_target") == 0, "large": F.col("qty") >= 30, "sized": F.col("size").between(10, 40), "branded": F.col("brand") == "Brand#13", "strong": F.col("proba") >= 30000}
    return evaluate.persona_funnel(r.scored().join(r.genes(), "gene_index"), c).select(*joins.PAIR, *c, "n_met")


@query("e17_upsert", "diseases", """
WITH a AS (SELECT disease_index, family_id, 'first' AS role, 'a' AS area FROM diseases WHERE disease_index % 2 = 0), b AS (SELECT disease_index, family_id, 'second' AS role, 'b' AS area FROM diseases WHERE disease_index % 3 = 0)
SELECT coalesce(a.disease_index, b.disease_index) AS disease_index, coalesce(a.family_id, b.family_id) AS family_id, coalesce(a.role, b.role) AS role, coalesce(b.area, a.area) AS area FROM a FULL JOIN b ON a.disease_index = b.disease_index""")
def _(r):
    d = r.diseases().select("disease_index", "family_id")
    first, second = d.where("disease_index % 2 = 0").withColumns({"role": F.lit("first"), "area": F.lit("a")}), d.where("disease_index % 3 = 0").withColumns({"role": F.lit("second"), "area": F.lit("b")})
    return evaluate.upsert_config(first, second, "disease_index", ["area"])


_OVERLAP = f"""top AS ({_TOP}), o AS (SELECT a.disease_index AS a, b.disease_index AS b, d.family_id, count(*) AS shared, count(*) / (100.0 - count(*)) AS jaccard, CAST(abs(a.disease_index % 4 - b.disease_index % 4) AS BIGINT) AS depth_gap
FROM top a JOIN top b ON a.gene_index = b.gene_index AND a.disease_index < b.disease_index JOIN diseases d ON a.disease_index = d.disease_index JOIN diseases e ON b.disease_index = e.disease_index AND d.family_id = e.family_id GROUP BY 1, 2, 3, 6)"""


def _overlap(r, near=0.05):
    depth = r.diseases().select("disease_index", "family_id", (F.col("disease_index") % 4).alias("depth"))
    return evaluate.panel_overlap(evaluate.top_lists(r.scored()), depth, near)


@query("e18_panel_overlap", "scored diseases", f"WITH {_OVERLAP} SELECT a, b, family_id, shared, round(jaccard, 6) AS jaccard, depth_gap, CAST(jaccard > 0.05 AS BIGINT) AS near_duplicate FROM o")
def _(r):
    return rounded(_overlap(r), "jaccard")


@query("e19_programme_scope", "scored diseases", f"""
WITH top AS ({_TOP}), n AS (SELECT DISTINCT family_id, t.disease_index, gene_index FROM top t JOIN diseases d ON t.disease_index = d.disease_index), s AS (SELECT family_id, count(DISTINCT disease_index) AS n_leaves FROM n GROUP BY 1), g AS (SELECT family_id, gene_index, count(*) AS n_in FROM n GROUP BY 1, 2)
SELECT g.family_id, gene_index, n_in, n_leaves, CASE WHEN n_in = n_leaves THEN 'common' WHEN n_in = 1 THEN 'specific' ELSE 'partial' END AS scope FROM g JOIN s ON g.family_id = s.family_id""")
def _(r):
    return evaluate.programme_scope(evaluate.top_lists(r.scored()), r.diseases()).select("family_id", "gene_index", "n_in", "n_leaves", "scope")


@query("e20_granularity", "scored diseases", f"WITH {_OVERLAP} SELECT family_id, count(*) AS pairs, round(avg(jaccard), 6) AS mean_jaccard FROM o GROUP BY 1")
def _(r):
    return rounded(_overlap(r).groupBy("family_id").agg(F.count("*").alias("pairs"), F.avg("jaccard").alias("mean_jaccard")), "mean_jaccard")


@query("e21_poisson_verdict", "scored", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY disease_index ORDER BY proba DESC, gene_index) AS rank FROM scored),
s AS (SELECT disease_index, count(*) AS pool, CAST(sum(is_target) AS BIGINT) AS n_known, CAST(sum(CASE WHEN rank <= 50 THEN is_target ELSE 0 END) AS BIGINT) AS hits FROM f GROUP BY 1), e AS (SELECT *, 50.0 * n_known / pool AS expected FROM s),
p AS (SELECT *, CASE WHEN hits <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - list_sum(list_transform(range(hits), lambda i: exp(-CAST(expected AS DOUBLE) + i * ln(CAST(expected AS DOUBLE)) - lgamma(i + 1)))))) END AS poisson_p FROM e)
SELECT disease_index, pool, n_known, hits, round(CAST(expected AS DOUBLE), 6) AS expected, round(poisson_p, 6) AS poisson_p, round(hits / CAST(expected AS DOUBLE), 6) AS enrichment, CASE WHEN poisson_p > 0.05 THEN 'not significant' WHEN hits < 3 THEN 'significant but fragile' ELSE 'significant' END AS verdict FROM p""")
def _(r):
    return rounded(evaluate.hits_with_verdict(r.scored()), "expected", "poisson_p", "enrichment")


@query("e22_score_buckets", "scored truth", f"""
WITH {_KNOWN} SELECT CAST((qty >= 10)::INT + (qty >= 25)::INT + (qty >= 40)::INT AS BIGINT) AS bucket, count(*) AS n, round(avg(is_known), 6) AS known_rate, min(qty) AS lowest FROM k GROUP BY 1""")
def _(r):
    return rounded(evaluate.score_buckets(joins.flag_members(r.scored(), r.truth(), joins.PAIR, "is_known"), "qty", [10.0, 25.0, 40.0]), "known_rate")


_UNIT = "u AS (SELECT *, proba / 105000.0 AS p FROM scored)"


@query("e23_calibration_error", "scored", f"""
WITH {_UNIT}, e AS ({edges_sql('p', 10, 'u')}), b AS (SELECT {bin_sql('p')} AS bin, count(*) AS n, avg(p) AS m, avg(is_target) AS y FROM u, e GROUP BY 1) SELECT round(sum(n * abs(m - y)) / sum(n), 6) AS ece FROM b""")
def _(r):
    return rounded(evaluate.expected_calibration_error(evaluate.calibration_bins(r.scored().withColumn("p", F.col("proba") / 105000.0), "p")), "ece")


@query("e24_threshold_scan", "scored", """
WITH t AS (SELECT CAST(unnest([5, 10, 15, 20, 25, 30, 35, 40, 45]) AS DOUBLE) AS threshold), a AS (SELECT sum(is_target) AS ap FROM scored)
SELECT threshold, round(sum(is_target) / CAST(count(*) AS DOUBLE), 6) AS precision, round(sum(is_target) / CAST(any_value(ap) AS DOUBLE), 6) AS recall, round(2 * sum(is_target) / CAST(count(*) + any_value(ap) AS DOUBLE), 6) AS f1 FROM t JOIN scored ON qty >= threshold, a GROUP BY 1""")
def _(r):
    return rounded(evaluate.threshold_scan(r.scored(), "qty", [float(x) for x in range(5, 50, 5)]), "precision", "recall", "f1")


@query("e25_feature_auc", "scored", f"""
SELECT 'qty' AS feature, round(avg(auc), 6) AS macro_auc, count(auc) AS n_diseases FROM ({auc_sql('qty')}) UNION ALL SELECT 'tax', round(avg(auc), 6), count(auc) FROM ({auc_sql('tax')}) UNION ALL SELECT 'n_rows', round(avg(auc), 6), count(auc) FROM ({auc_sql('n_rows')})""")
def _(r):
    return rounded(evaluate.feature_auc(r.scored(), ["qty", "tax", "n_rows"]), "macro_auc")


@query("e26_parent_child_auc", "scored tree", f"WITH a AS ({auc_sql('proba')}) SELECT parent, child, round(p.auc, 6) AS auc_parent, round(c.auc, 6) AS auc_child, round(c.auc - p.auc, 6) AS delta FROM tree JOIN a p ON parent = p.disease_index JOIN a c ON child = c.disease_index")
def _(r):
    return rounded(evaluate.parent_child(evaluate.auc_by_group(r.scored()), r.tree()), "auc_parent", "auc_child", "delta")


@query("e27_drug_evidence", "drug_evidence", "SELECT * FROM drug_evidence")
def _(r):
    return r.drug_evidence()


@query("e28_top_drivers", "scored", """
WITH d AS (SELECT disease_index, gene_index, 'qty' AS name, qty - 25 AS value FROM scored UNION ALL SELECT disease_index, gene_index, 'rows', -3.0 * n_rows FROM scored UNION ALL SELECT disease_index, gene_index, 'tax', 100 * tax FROM scored)
SELECT disease_index, gene_index, string_agg(name, ', ' ORDER BY abs(value) DESC, name) AS drivers FROM (SELECT *, row_number() OVER (PARTITION BY disease_index, gene_index ORDER BY abs(value) DESC, name) AS r FROM d) WHERE r <= 2 GROUP BY 1, 2""")
def _(r):
    j = F.to_json(F.create_map(F.lit("qty"), F.col("qty") - 25, F.lit("rows"), -3.0 * F.col("n_rows"), F.lit("tax"), 100 * F.col("tax")))
    return r.scored().select(*joins.PAIR, F.array_join(F.transform(top_by_magnitude(j, 2), lambda e: e["name"]), ", ").alias("drivers"))


@query("e29_gap_profile", "scored diseases", f"WITH {_OVERLAP} SELECT depth_gap, count(*) AS pairs, round(avg(jaccard), 6) AS mean_jaccard, round(max(jaccard), 6) AS max_jaccard, count(*) FILTER (jaccard > 0.05) AS near_duplicates FROM o GROUP BY 1")
def _(r):
    return rounded(evaluate.gap_profile(_overlap(r)), "mean_jaccard", "max_jaccard")


@query("e30_calibration_payload", "scored", f"""
SELECT CAST(least(greatest(floor(auc / CAST(0.05 AS DOUBLE)), 0), 19) AS BIGINT) AS bin, count(*) AS n FROM ({auc_sql('qty')}) WHERE auc IS NOT NULL GROUP BY 1""")
def _(r):
    from ..operators.aggregates import histogram

    return histogram(evaluate.auc_by_group(r.scored(), score="qty"), "auc", 0.0, 1.0, 20).where("n > 0")


@query("e31_expected_list", "scored truth", f"""
WITH f AS (SELECT disease_index, gene_index, row_number() OVER (PARTITION BY disease_index ORDER BY proba DESC, gene_index) AS rank FROM scored) SELECT t.disease_index, count(*) AS n_expected, count(*) FILTER (rank <= 20) AS in_top_20, min(rank) AS best_rank
FROM truth t LEFT JOIN f ON t.disease_index = f.disease_index AND t.gene_index = f.gene_index GROUP BY 1""")
def _(r):
    return evaluate.expected_check(r.truth(), ranking.rank_first(r.scored(), "disease_index", "proba", "gene_index"))


@query("e32_area_shape", "genes", """
WITH g AS (SELECT CASE WHEN regexp_matches(type, 'larg|promo', 'i') THEN 'hard' ELSE 'other' END AS area, brand, count(*) AS n, count(*) FILTER (size > 25) AS usable FROM genes GROUP BY 1, 2)
SELECT area, CAST(sum(n) AS BIGINT) AS n_terms, count(*) FILTER (n >= 2) AS two_terms, count(*) FILTER (usable >= 2) AS two_usable, count(*) FILTER (n >= 3) AS three_terms FROM g GROUP BY 1""")
def _(r):
    area = F.when(F.col("type").rlike("(?i)larg|promo"), "hard").otherwise("other")
    g = r.genes().groupBy(area.alias("area"), "brand").agg(F.count("*").alias("n"), F.count_if(F.col("size") > 25).alias("usable"))
    return g.groupBy("area").agg(F.sum("n").alias("n_terms"), F.count_if(F.col("n") >= 2).alias("two_terms"), F.count_if(F.col("usable") >= 2).alias("two_usable"), F.count_if(F.col("n") >= 3).alias("three_terms"))


@query("e33_over_representation", "scored", f"""
WITH e AS ({edges_sql('qty', 5)}), b AS (SELECT *, {bin_sql('qty')} AS bin, row_number() OVER (PARTITION BY disease_index ORDER BY proba DESC, gene_index) AS rank FROM scored, e), c AS (SELECT bin, count(*) AS n, count(*) FILTER (rank <= 50) AS top FROM b GROUP BY 1)
SELECT bin, n, top, round((top / CAST(sum(top) OVER () AS DOUBLE)) / (n / CAST(sum(n) OVER () AS DOUBLE)), 6) AS ratio FROM c""")
def _(r):
    return rounded(evaluate.over_representation(r.scored(), "qty"), "ratio")


@query("e34_curated_lift", "scored truth", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY disease_index ORDER BY proba DESC, gene_index) AS rank FROM scored WHERE is_target = 0), l AS (SELECT n.disease_index, rank, CASE WHEN t.gene_index IS NULL THEN 0 ELSE 1 END AS linked FROM n LEFT JOIN truth t ON n.disease_index = t.disease_index AND n.gene_index = t.gene_index),
p AS (SELECT disease_index, count(*) AS n, sum(linked) AS m, sum(CASE WHEN rank <= 200 THEN linked ELSE 0 END) AS h FROM l GROUP BY 1 HAVING count(*) >= 200 AND sum(linked) >= 1)
SELECT 'curated' AS truth, CAST(200 AS BIGINT) AS k, count(*) AS n_diseases, CAST(sum(h) AS BIGINT) AS hits, round(sum(least(200, n) * m / CAST(n AS DOUBLE)), 6) AS expected, round(sum(h) / sum(least(200, n) * m / CAST(n AS DOUBLE)), 6) AS lift FROM p HAVING count(*) > 0""")
def _(r):
    return rounded(evaluate.novel_discovery(r.scored(), {"curated": r.truth()}, ks=(200,)), "expected", "lift")


# The read layer.


@query("api_candidate_diseases", "scored", "SELECT disease_index, count(*) AS n_candidates FROM scored WHERE is_target = 0 GROUP BY 1")
def _(r):
    return serving.candidate_diseases(r.scored().where("is_target = 0"))


@query("api_candidates", "scored", "SELECT disease_index, gene_index, rank FROM (SELECT *, rank() OVER (PARTITION BY disease_index ORDER BY qty DESC) AS rank FROM scored) WHERE disease_index = 5 AND is_target = 0 AND rank <= 60")
def _(r):
    return serving.candidates(ranking.rank_competition(r.scored(), "disease_index", "qty"), 5, novel=True, max_rank=60).select(*joins.PAIR, "rank")


@query("api_gene", "scored", """
WITH p AS (SELECT gene_index, 'qty' AS feature, qty AS value FROM scored WHERE disease_index = 5 UNION ALL SELECT gene_index, 'proba', proba FROM scored WHERE disease_index = 5)
SELECT feature, value, percentile FROM (SELECT *, round(100.0 * (rank() OVER (PARTITION BY feature ORDER BY value) - 1) / count(value) OVER (PARTITION BY feature), 1) AS percentile FROM p) WHERE gene_index = (SELECT min(gene_index) FROM scored WHERE disease_index = 5)""")
def _(r):
    gene = r.scored().where("disease_index = 5").agg(F.min("gene_index")).first()[0]
    return serving.gene_profile(r.scored(), 5, gene, ["qty", "proba"])


@query("api_identity", "genes", "SELECT * FROM genes WHERE gene_index = 11")
def _(r):
    return serving.identity(r.genes(), 11)


@query("api_drugs", "drug_disease drug_protein", """
SELECT drug, relation, CAST(CASE relation WHEN 'Indication' THEN 1 WHEN 'drug_investigated_for' THEN 2 ELSE 3 END AS BIGINT) AS stage, string_agg(DISTINCT action, '|' ORDER BY action) AS actions FROM drug_disease JOIN drug_protein USING (drug)
WHERE disease_index = 5 AND gene_index = (SELECT min(gene_index) FROM drug_protein JOIN drug_disease USING (drug) WHERE disease_index = 5) GROUP BY 1, 2, 3""")
def _(r):
    records = r.drug_disease().join(r.drug_protein(), "drug")
    gene = records.where("disease_index = 5").agg(F.min("gene_index")).first()[0]
    return serving.drugs(records, 5, gene)


@query("api_drivers", "scored", "SELECT name, value FROM (SELECT 'qty' AS name, qty AS value FROM scored WHERE disease_index = 5 AND gene_index = (SELECT min(gene_index) FROM scored WHERE disease_index = 5) UNION ALL SELECT 'tax', tax FROM scored WHERE disease_index = 5 AND gene_index = (SELECT min(gene_index) FROM scored WHERE disease_index = 5))")
def _(r):
    gene = r.scored().where("disease_index = 5").agg(F.min("gene_index")).first()[0]
    explained = r.scored().withColumn("explanations", F.to_json(F.create_map(F.lit("qty"), F.col("qty"), F.lit("tax"), F.col("tax"))))
    return serving.drivers(explained, 5, gene)


@query("api_evidence", "", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(r):
    return serving.evidence(r.table("lineitem"), ["l_returnflag", "l_linestatus"])


@query("api_families", "diseases", "SELECT family_id, count(*) AS n_terms FROM diseases GROUP BY 1")
def _(r):
    return serving.families(r.diseases())


@query("api_family", "scored diseases", f"WITH {_OVERLAP} SELECT depth_gap, count(*) AS pairs, round(avg(jaccard), 6) AS mean_jaccard, round(max(jaccard), 6) AS max_jaccard, count(*) FILTER (jaccard > 0.05) AS near_duplicates FROM o WHERE family_id = 4 GROUP BY 1")
def _(r):
    return rounded(serving.family(_overlap(r), 4), "mean_jaccard", "max_jaccard")


@query("stream_windowed_counts", "", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(r):
    import uuid

    from ..streaming import events

    # Spark streams from folders: the table is copied into one if it is a single file.
    folder = _scratch(r, "events")
    r.table("events").repartition(4, "event_id").write.parquet(folder)
    stream = events.windowed_counts(events.event_stream(r.spark, folder), late="3650 days")
    return rounded(events.run_available(stream, f"counts_{uuid.uuid4().hex}", _scratch(r, "state")), "total")
