"""Registered queries for whole studies: staged filters, discovery, the panel, calibration, hierarchy and explanation routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, joins, ontology, studies
from .evaluation import _E3, _KNOWN, auc_sql
from .registry import query
from .relational import rounded

_FILTERS = {
    "F0 none": "true",
    "F1 accessible": "type IN ('LARGE', 'SMALL')",
    "F2 family": "brand LIKE 'Brand#1%'",
    "F3 F1 or F2": "type IN ('LARGE', 'SMALL') OR brand LIKE 'Brand#1%'",
    "F4 tractable": "size > 40 OR tax >= 0.07",
    "F5 approved": "n_rows > 6",
}
_STAGED = f"""
WITH {_KNOWN}, t AS (SELECT disease_index, sum(is_known) AS total FROM k GROUP BY 1 HAVING sum(is_known) > 0),
j AS (SELECT k.*, total, type, brand, size FROM k JOIN genes g ON k.gene_index = g.gene_index JOIN t ON k.disease_index = t.disease_index),
l AS ({" UNION ALL ".join(f"SELECT '{n}' AS filter, * FROM j WHERE {c}" for n, c in _FILTERS.items())}),
f AS (SELECT *, row_number() OVER (PARTITION BY filter, disease_index ORDER BY proba DESC, gene_index) AS rank,
  rank() OVER (PARTITION BY filter, disease_index ORDER BY proba) + (count(*) OVER (PARTITION BY filter, disease_index, proba) - 1) / 2.0 AS a FROM l),
p AS (SELECT filter, disease_index, count(*) AS pool, CAST(sum(is_known) AS BIGINT) AS kept, CAST(any_value(total) AS BIGINT) AS known,
  CAST(sum(CASE WHEN rank <= 50 THEN is_known ELSE 0 END) AS BIGINT) AS hits, quantile_cont(CASE WHEN is_known = 1 THEN CAST(rank AS DOUBLE) END, 0.5) / count(*) AS median_pct,
  (sum(CASE WHEN is_known = 1 THEN a END) - sum(is_known) * (sum(is_known) + 1) / 2.0) / nullif(CAST(sum(is_known) AS DOUBLE) * (count(*) - sum(is_known)), 0) AS auc FROM f GROUP BY 1, 2)"""


def _staged(r):
    scored = r.scored().join(r.genes(), "gene_index")
    return studies.staged_filters(scored, [(n, F.expr(c)) for n, c in _FILTERS.items()], r.truth())


@query("e06_staged_filters", "scored truth genes", f"""{_STAGED}
SELECT filter, disease_index, pool, kept AS n_known_kept, known AS n_known_total, hits AS hits_at_50, round(median_pct, 6) AS median_pct, round(auc, 6) AS auc,
  round(kept / CAST(known AS DOUBLE), 6) AS retention FROM p""")
def _(r):
    return rounded(_staged(r), "median_pct", "auc", "retention")


@query("e06_filter_summary", "scored truth genes", f"""{_STAGED}
SELECT filter, count(*) AS n_diseases, CAST(sum(pool) AS BIGINT) AS pool, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(known) AS BIGINT) AS known, round(sum(kept) / CAST(sum(known) AS DOUBLE), 6) AS retention,
  CAST(sum(hits) AS BIGINT) AS hits, round(avg(auc), 6) AS macro_auc, round(avg(median_pct), 6) AS mean_median_pct FROM p GROUP BY 1""")
def _(r):
    return rounded(studies.filter_summary(_staged(r)), "retention", "macro_auc", "mean_median_pct")


# The panel: diseases of one family; its first three terms are the umbrella. Drug evidence is asked pair by pair.
_PANEL_KEYS, _UMBRELLA = (3, 7, 12), (1, 5, 8)
_RANKED = f"""
panel AS (SELECT disease_index FROM diseases WHERE family_id IN {_PANEL_KEYS} OR disease_index IN {_UMBRELLA}),
q AS (SELECT s.*, row_number() OVER (PARTITION BY s.disease_index ORDER BY proba DESC, s.gene_index) AS rank,
  rank() OVER (PARTITION BY s.disease_index ORDER BY proba) + (count(*) OVER (PARTITION BY s.disease_index, proba) - 1) / 2.0 AS a,
  CASE WHEN is_target = 0 THEN row_number() OVER (PARTITION BY s.disease_index, is_target ORDER BY proba DESC, s.gene_index) END AS novel_rank
  FROM scored s WHERE s.disease_index IN (SELECT disease_index FROM panel))"""


def _panel(r):
    return r.diseases().where(F.col("family_id").isin(*_PANEL_KEYS) | F.col("disease_index").isin(*_UMBRELLA)).select("disease_index")


@query("e21_panel_report", "scored diseases genes truth drug_evidence", f"""
WITH {_RANKED}, w AS (SELECT q.*, gene_name, CASE WHEN size > 25 THEN 1 ELSE 0 END AS tr, CASE WHEN t.gene_index IS NULL THEN 0 ELSE 1 END AS lt, coalesce(in_approved, 0) AS la FROM q JOIN genes g ON q.gene_index = g.gene_index
  LEFT JOIN truth t ON t.disease_index = q.disease_index AND t.gene_index = q.gene_index LEFT JOIN drug_evidence e ON e.disease_index = q.disease_index AND e.gene_index = q.gene_index),
s AS (SELECT disease_index, count(*) AS pool, CAST(sum(is_target) AS BIGINT) AS n_known, CAST(sum(CASE WHEN rank <= 50 THEN is_target ELSE 0 END) AS BIGINT) AS hits, sum(CASE WHEN is_target = 1 THEN a END) AS rs,
  count(*) FILTER (is_target = 0) AS n_novel, CAST(coalesce(sum(tr) FILTER (novel_rank <= 50), 0) AS BIGINT) AS novel_tractable, count(*) FILTER (novel_rank <= 50) AS head,
  string_agg(gene_name, ', ' ORDER BY novel_rank) FILTER (novel_rank <= 10) AS top_novel,
  CAST(coalesce(sum(lt) FILTER (is_target = 0), 0) AS BIGINT) AS known_total, CAST(coalesce(sum(la) FILTER (is_target = 0), 0) AS BIGINT) AS approved_total,
  CAST(coalesce(sum(lt) FILTER (novel_rank <= 50), 0) AS BIGINT) AS known_hits, CAST(coalesce(sum(la) FILTER (novel_rank <= 50), 0) AS BIGINT) AS approved_hits FROM w GROUP BY 1),
u AS (SELECT *, (rs - n_known * (n_known + 1) / 2.0) / nullif(CAST(n_known AS DOUBLE) * (pool - n_known), 0) AS auc, CAST(50.0 * n_known / pool AS DOUBLE) AS expected FROM s),
v AS (SELECT *, (auc * (1 - auc) + (n_known - 1) * (auc / (2 - auc) - auc * auc) + (pool - n_known - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (CAST(n_known AS DOUBLE) * (pool - n_known)) AS var,
  CASE WHEN hits <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - list_sum(list_transform(range(hits), lambda i: exp(-expected + i * ln(expected) - lgamma(i + 1)))))) END AS p FROM u)
SELECT disease_index, pool, n_known, hits, n_novel, novel_tractable, top_novel, known_total, approved_total, known_hits, approved_hits, round(auc, 6) AS auc, round(sqrt(var), 6) AS auc_se,
  round(auc - 1.96 * sqrt(var), 6) AS auc_lo95, round(auc + 1.96 * sqrt(var), 6) AS auc_hi95, round(CAST(100.0 * n_known / pool AS DOUBLE), 6) AS base_rate_pct, round(expected, 6) AS expected, round(CAST(p AS DOUBLE), 6) AS poisson_p,
  round(hits / expected, 6) AS enrichment, CASE WHEN p > 0.05 THEN 'not significant' WHEN hits < 3 THEN 'significant but fragile' ELSE 'significant' END AS verdict, CAST(n_known >= 30 AS BIGINT) AS trustworthy,
  round(CAST(100.0 * novel_tractable / greatest(head, 1) AS DOUBLE), 6) AS novel_tractable_pct, round(50.0 * known_total / CAST(n_novel AS DOUBLE), 6) AS known_expected, round((known_hits / 50.0) / nullif(known_total / CAST(n_novel AS DOUBLE), 0), 6) AS known_lift,
  round(50.0 * approved_total / CAST(n_novel AS DOUBLE), 6) AS approved_expected, round((approved_hits / 50.0) / nullif(approved_total / CAST(n_novel AS DOUBLE), 0), 6) AS approved_lift FROM v""")
def _(r):
    scored = r.scored()
    mine = scored.join(_panel(r), "disease_index", "left_semi").select(*joins.PAIR)
    truths = {"known": r.truth(), "approved": joins.drug_linked(mine, r.drug_disease(), r.drug_protein(), "indication")}
    found = studies.panel_report(scored, _panel(r), r.genes().where("size > 25"), truths, r.genes())
    sums = ("auc", "auc_se", "auc_lo95", "auc_hi95", "base_rate_pct", "expected", "poisson_p", "enrichment", "novel_tractable_pct", "known_expected", "known_lift", "approved_expected", "approved_lift")
    return rounded(found, *sums)


_PAIRS = f"""{_RANKED}, top AS (SELECT disease_index, gene_index, true AS novel FROM q WHERE novel_rank <= 50 UNION ALL SELECT disease_index, gene_index, false FROM q WHERE rank <= 50),
sh AS (SELECT x.disease_index AS a, y.disease_index AS b, count(*) FILTER (x.novel) AS n, count(*) FILTER (NOT x.novel) AS l FROM top x JOIN top y ON x.gene_index = y.gene_index AND x.novel = y.novel AND x.disease_index < y.disease_index GROUP BY 1, 2),
pr AS (SELECT x.disease_index AS a, y.disease_index AS b, coalesce(n, 0) AS novel_overlap, coalesce(l, 0) AS all_overlap FROM (SELECT DISTINCT disease_index FROM q) x JOIN (SELECT DISTINCT disease_index FROM q) y ON x.disease_index < y.disease_index
  LEFT JOIN sh ON sh.a = x.disease_index AND sh.b = y.disease_index)"""


@query("e21_panel_pairs", "scored diseases", f"""
WITH {_PAIRS} SELECT a, b, novel_overlap, all_overlap, round(2.0 * novel_overlap, 6) AS novel_overlap_pct, round(2.0 * all_overlap, 6) AS all_overlap_pct, CAST(novel_overlap <= 12.5 AS BIGINT) AS distinct FROM pr""")
def _(r):
    return studies.panel_pairs(r.scored(), _panel(r))


@query("e21_umbrella_overlap", "scored diseases", f"""
WITH {_PAIRS}, o AS (SELECT a AS disease_index, b AS other, novel_overlap FROM pr UNION ALL SELECT b, a, novel_overlap FROM pr),
m AS (SELECT disease_index, coalesce(max(novel_overlap) FILTER (other IN {_UMBRELLA}), 0) AS best FROM o WHERE disease_index NOT IN {_UMBRELLA} GROUP BY 1)
SELECT disease_index, best, CASE WHEN best >= 25 THEN 'generic' WHEN best >= 12.5 THEN 'partly specific' ELSE 'subtype-specific' END AS tag FROM m""")
def _(r):
    return studies.umbrella_overlap(studies.panel_pairs(r.scored(), _panel(r)), list(_UMBRELLA))


@query("e30_calibration_page", "scored truth diseases split_tagged assoc routes", f"""
WITH {_KNOWN}, pd AS (SELECT disease_index, auc, enrichment_at_50 AS enrichment FROM ({_E3})), pg AS ({auc_sql('proba', 'is_known', 'k')}),
fa AS ({auc_sql('proba', source="(SELECT s.* REPLACE (CAST(family_id AS BIGINT) AS disease_index) FROM scored s JOIN diseases d ON s.disease_index = d.disease_index)")}),
md AS (SELECT disease_index, count(*) AS m FROM assoc GROUP BY 1), fit AS (SELECT count(*) AS n, coalesce(corr(pd.auc, pg.auc), 0.0) AS r, avg(pg.auc) AS y FROM pd JOIN pg USING (disease_index) WHERE pd.auc IS NOT NULL AND pg.auc IS NOT NULL),
rt AS (SELECT count(dwpc_ggd) AS a, count(dwpc_gpgd) AS b, count(dwpc_gcd) AS c FROM routes), un AS (SELECT count(*) AS n, avg(is_target) AS y, avg(CASE WHEN split = 'validation' THEN is_target END) AS v FROM split_tagged),
sp AS (SELECT split, count(*) AS rows, sum(is_target) AS positives, 100.0 * avg(is_target) AS rate, count(DISTINCT disease_index) AS nd, count(DISTINCT split_key) AS nk FROM split_tagged GROUP BY 1),
hr AS (SELECT rank() OVER (ORDER BY n_rows) + (count(*) OVER (PARTITION BY n_rows) - 1) / 2.0 AS x, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2.0 AS y FROM scored),
hi AS (SELECT b AS name, count(auc) AS n FROM range(20) t(b) LEFT JOIN pd ON least(greatest(floor(auc / CAST(0.05 AS DOUBLE)), 0), 19) = b GROUP BY 1)
SELECT section, name, round(CAST(value AS DOUBLE), 4) AS value FROM (
SELECT 'splits' AS section, split || ' ' || u.m AS name, CASE u.m WHEN 'rows' THEN rows WHEN 'positives' THEN positives WHEN 'pos_rate_pct' THEN rate WHEN 'n_diseases' THEN nd ELSE nk END AS value FROM sp, (SELECT unnest(['rows', 'positives', 'pos_rate_pct', 'n_diseases', 'n_split_keys']) AS m) u
UNION ALL SELECT 'histogram', CAST(name AS VARCHAR), n FROM hi
UNION ALL SELECT 'auc', unnest(['n_diseases', 'macro', 'median', 'below_chance']), unnest([CAST(count(auc) AS DOUBLE), avg(auc), quantile_cont(auc, 0.5), CAST(count(*) FILTER (auc < 0.5) AS DOUBLE)]) FROM pd
UNION ALL SELECT 'enrichment', unnest(['median', 'q1', 'q3', 'max', 'n']), unnest([quantile_cont(enrichment, 0.5), quantile_cont(enrichment, 0.25), quantile_cont(enrichment, 0.75), max(enrichment), CAST(count(*) AS DOUBLE)]) FROM pd WHERE auc IS NOT NULL AND enrichment IS NOT NULL
UNION ALL SELECT 'orthogonality', unnest(['n', 'pearson_r', 'drug_macro_auc', 'r2']), unnest([CAST(n AS DOUBLE), r, y, r * r]) FROM fit
UNION ALL SELECT 'eligibility', unnest(['total', 'eligible', 'excluded', 'pct_excluded']), unnest([CAST(count(*) AS DOUBLE), count(*) FILTER (m >= 20), count(*) FILTER (m < 20), round(100.0 * count(*) FILTER (m < 20) / greatest(count(*), 1), 1)]) FROM md
UNION ALL SELECT 'families', unnest(['n', 'macro_auc']), unnest([CAST(count(auc) AS DOUBLE), avg(auc)]) FROM fa
UNION ALL SELECT 'leakage', 'straddling_split_key', count(*) FILTER (c > 1) FROM (SELECT split_key, count(DISTINCT split) AS c FROM split_tagged GROUP BY 1)
UNION ALL SELECT 'leakage', 'straddling_disease_index', count(*) FILTER (c > 1) FROM (SELECT disease_index, count(DISTINCT split) AS c FROM split_tagged GROUP BY 1)
UNION ALL SELECT 'routes', unnest(['dwpc_ggd', 'dwpc_gpgd', 'dwpc_gcd']), unnest([a, b, c]) FROM rt
UNION ALL SELECT 'pool', unnest(['union_rows', 'pos_rate_pct', 'base_rate', 'route_admissions', 'duplicates_removed', 'pairs_per_disease']),
  unnest([CAST(n AS DOUBLE), 100.0 * y, v, a + b + c, a + b + c - n, round(n / CAST((SELECT nullif(count(*) FILTER (m >= 20), 0) FROM md) AS DOUBLE))]) FROM un, rt
UNION ALL SELECT 'hub', 'rho', corr(x, y) FROM hr)""")
def calibration_page(r):
    scored = r.scored()
    per_disease = evaluate.auc_with_interval(scored, score="qty").select("disease_index", "auc", F.col("enrichment_at_50").alias("enrichment"))
    per_drug = evaluate.auc_by_group(joins.flag_members(scored, r.truth(), joins.PAIR, "is_known"), label="is_known")
    per_family = evaluate.auc_by_group(scored.join(r.diseases(), "disease_index"), "family_id")
    modules = r.assoc().groupBy("disease_index").agg(F.count("*").alias("module_size"))
    degrees = scored.select(F.col("n_rows").alias("degree"), F.col("proba").alias("score"))
    return studies.calibration_page(per_disease, per_drug, r.split_tagged(), modules, per_family, r.routes().drop(*joins.PAIR), degrees)


# The hierarchy is the tree of parts: names are theirs, every ninth node is an anchor, a module counts a part's diseases.
_HIERARCHY = """
WITH RECURSIVE up AS (SELECT child AS d, parent AS a, 1 AS h FROM tree UNION ALL SELECT u.d, t.parent, h + 1 FROM up u JOIN tree t ON u.a = t.child),
n AS (SELECT DISTINCT unnest([parent, child]) AS node FROM tree), x AS (SELECT node, 'MONDO:' || node AS node_id, p_name AS name, p_type AS node_source, p_brand AS brand, CASE WHEN node % 9 = 4 THEN 1 ELSE 0 END AS anc FROM n JOIN part ON p_partkey = node),
m AS (SELECT gene_index AS node, count(*) AS module_size FROM assoc GROUP BY 1), y AS (SELECT x.*, module_size, CASE WHEN module_size >= 8 THEN 1 ELSE 0 END AS el FROM x LEFT JOIN m ON x.node = m.node),
c AS (SELECT d AS node, a, h FROM up WHERE a % 9 = 4 AND h <= 15 UNION ALL SELECT node, node, 0 FROM n WHERE node % 9 = 4), b AS (SELECT node, a, h, row_number() OVER (PARTITION BY node ORDER BY h, a) AS r FROM c),
f AS (SELECT n.node, coalesce(b.a, n.node) AS family_id, CAST(b.h AS BIGINT) AS depth FROM n LEFT JOIN b ON n.node = b.node AND r = 1),
ch AS (SELECT parent AS node, count(*) AS k, CAST(sum(el) AS BIGINT) AS e, CAST(sum(anc) AS BIGINT) AS an, string_agg(CASE WHEN anc = 1 THEN brand END, ' | ' ORDER BY brand) AS labels FROM tree JOIN y ON y.node = child GROUP BY 1),
de AS (SELECT a AS node, count(*) AS k, CAST(sum(el) AS BIGINT) AS e, CAST(sum(anc) AS BIGINT) AS an FROM up JOIN y ON y.node = d GROUP BY 1),
pa AS (SELECT child AS node, count(*) AS k, string_agg(name, ' | ' ORDER BY name) AS names FROM tree JOIN y ON y.node = parent GROUP BY 1), ab AS (SELECT d AS node, count(*) AS k FROM up WHERE a % 9 = 4 GROUP BY 1)
SELECT y.node, y.node_id, y.name, y.node_source, y.module_size, CAST(y.el AS BIGINT) AS is_eligible, CAST(y.anc AS BIGINT) AS is_anchor, CASE WHEN y.anc = 1 THEN 'DOID:' || y.node END AS anchor_doid, CASE WHEN y.anc = 1 THEN y.brand END AS anchor_label,
 family_id, t.name AS family_name, CASE WHEN t.anc = 1 THEN t.brand END AS anchor_name, depth AS hop_depth, coalesce(pa.k, 0) AS n_parents, coalesce(ch.k, 0) AS n_children, coalesce(ch.e, 0) AS n_eligible_children, coalesce(ch.an, 0) AS n_anchor_children,
 CAST(coalesce(ch.e, 0) >= 1 AS BIGINT) AS is_parent_term, substring(coalesce(names, ''), 1, 400) AS parent_names, substring(coalesce(labels, ''), 1, 300) AS anchor_children_names, coalesce(ab.k, 0) AS n_anchor_ancestors, coalesce(de.an, 0) AS n_anchor_descendants,
 CAST(coalesce(de.an, 0) > 0 AS BIGINT) AS is_ancestor_of_anchor, CAST(coalesce(ab.k, 0) > 0 AS BIGINT) AS is_descendant_of_anchor, CAST(coalesce(de.an, 0) = 0 AND coalesce(ab.k, 0) = 0 AS BIGINT) AS antichain_ok_as_anchor,
 coalesce(de.k, 0) AS n_descendants, coalesce(de.e, 0) AS n_eligible_descendants
FROM y JOIN f ON f.node = y.node LEFT JOIN y t ON t.node = family_id LEFT JOIN pa ON pa.node = y.node LEFT JOIN ch ON ch.node = y.node LEFT JOIN de ON de.node = y.node LEFT JOIN ab ON ab.node = y.node"""


@query("g05_hierarchy_annotation", "tree assoc", _HIERARCHY)
def _(r):
    ids = r.tree().select(F.col("parent").alias("node")).unionAll(r.tree().select("child")).distinct()
    nodes = ids.join(r.table("part"), F.col("node") == F.col("p_partkey")).select("node", F.concat(F.lit("MONDO:"), F.col("node").cast("string")).alias("node_id"), F.col("p_name").alias("name"), F.col("p_type").alias("node_source"), "p_brand")
    anchors = nodes.where("node % 9 = 4").select(F.col("node").alias("anchor"), F.concat(F.lit("DOID:"), F.col("node").cast("string")).alias("doid"), F.col("p_brand").alias("label"))
    family = ontology.nearest_anchor(ids, r.tree(), anchors.select("anchor"))
    modules = r.assoc().groupBy(F.col("gene_index").alias("node")).agg(F.count("*").alias("module_size"))
    return studies.annotated_hierarchy(nodes.drop("p_brand"), r.tree(), anchors, modules, family, gate=8)


_ROUTES = """
WITH pr AS (SELECT DISTINCT gene_index AS middle FROM assoc WHERE disease_index = {d} AND gene_index <> {g}), tm AS (SELECT DISTINCT l_linenumber AS line, l_partkey AS gene_index, l_suppkey AS term_index FROM lineitem WHERE l_linenumber <= 3),
dg AS (SELECT line, term_index, count(*) AS k FROM tm GROUP BY 1, 2),
a AS (SELECT 'ppi' AS route, CAST(NULL AS BIGINT) AS term_index, middle, CAST(NULL AS VARCHAR) AS relation FROM pr JOIN ppi ON x_index = {g} AND y_index = middle
 UNION ALL SELECT CASE x.line WHEN 1 THEN 'pathway' WHEN 2 THEN 'molecular_function' ELSE 'biological_process' END, x.term_index, middle, NULL FROM tm x JOIN tm y ON x.line = y.line AND x.term_index = y.term_index AND x.gene_index = {g} JOIN pr ON middle = y.gene_index
 JOIN dg ON dg.line = x.line AND dg.term_index = x.term_index AND (x.line = 1 OR (x.line = 2 AND k <= 86) OR (x.line = 3 AND k <= 200))
 UNION ALL SELECT DISTINCT 'drug', p.drug, NULL, relation FROM drug_protein p JOIN drug_disease q ON p.drug = q.drug WHERE gene_index = {g} AND disease_index = {d} AND lower(relation) IN ('indication', 'drug_investigated_for')),
o AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY term_index, middle, relation) AS place FROM a)
SELECT route, place, term_index, middle, relation FROM o WHERE place <= CASE route WHEN 'molecular_function' THEN 60 WHEN 'drug' THEN 40 ELSE 100 END"""


@query("f18_explanation_routes", "ppi assoc drug_protein drug_disease", _ROUTES.format(g=17, d=4))
def _(r):
    terms = {n: r.table("lineitem").where(F.col("l_linenumber") == i + 1).select(F.col("l_partkey").alias("gene_index"), F.col("l_suppkey").alias("term_index")) for i, n in enumerate(studies.TERM_ROUTES)}
    return studies.explanation_routes(17, 4, r.assoc(), r.ppi(), terms, r.drug_protein(), r.drug_disease(), {"molecular_function": 86})
