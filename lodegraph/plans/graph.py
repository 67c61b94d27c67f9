"""Registered queries for hierarchies, graphs and pair features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, ontology
from .registry import query
from .relational import rounded

_REACH = "WITH RECURSIVE up AS (SELECT child AS d, parent AS a, 1 AS h FROM tree UNION ALL SELECT u.d, t.parent, h + 1 FROM up u JOIN tree t ON u.a = t.child)"


# Every node takes the least label of its neighbours until none changes; a node keeps one row.
_LABELS = """
WITH RECURSIVE n AS (SELECT DISTINCT unnest([x_index, y_index]) AS n FROM ppi), c(n, root) USING KEY (n) AS (SELECT n, n FROM n
  UNION (SELECT e.y_index, min(c.root) AS root FROM c JOIN ppi e ON c.n = e.x_index JOIN recurring.c AS old ON old.n = e.y_index WHERE c.root < old.root GROUP BY 1))"""


@query("g01_largest_component", "ppi", f"""{_LABELS},
b AS (SELECT root FROM c GROUP BY 1 ORDER BY count(*) DESC, root LIMIT 1) SELECT x_index, y_index FROM ppi WHERE x_index IN (SELECT n FROM c JOIN b USING (root))""")
def _(r):
    return ontology.largest_component(r.ppi()).select("x_index", "y_index")


@query("g02_components", "ppi", f"{_LABELS} SELECT n AS node, root AS component FROM c")
def _(r):
    return ontology.components(r.ppi())


@query("g03_two_hop", "ppi", """
WITH s AS (SELECT DISTINCT x_index AS s FROM ppi), one AS (SELECT s, y_index AS n, 1 AS h FROM s JOIN ppi ON s = x_index),
two AS (SELECT DISTINCT s, y_index AS n, 2 AS h FROM one JOIN ppi ON n = x_index)
SELECT s AS source, n AS node, CAST(min(h) AS BIGINT) AS hops FROM (SELECT s, s AS n, 0 AS h FROM s UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2""")
def _(r):
    return ontology.k_hop(r.ppi().select(F.col("x_index").alias("node")).distinct(), r.ppi(), 2)


@query("g03_greedy_groups")
def _(r):
    return ontology.greedy_groups(r.ppi())


@query("g04_descendants", "tree", f"{_REACH} SELECT DISTINCT d AS descendant FROM up WHERE a IN (3, 10)")
def _(r):
    return ontology.closure(r.tree()).where(F.col("ancestor").isin(3, 10)).select("descendant").distinct()


@query("g05_hierarchy", "tree", f"""
{_REACH}, u AS (SELECT DISTINCT d, a FROM up), n AS (SELECT DISTINCT unnest([parent, child]) AS node FROM tree)
SELECT node, (SELECT count(*) FROM tree WHERE child = node) AS n_parents, (SELECT count(*) FROM tree WHERE parent = node) AS n_children, (SELECT count(*) FROM u WHERE a = node) AS n_descendants,
 (SELECT count(*) FROM u WHERE d = node AND a % 9 = 4) AS n_anchor_ancestors, (SELECT count(*) FROM u WHERE a = node AND d % 9 = 4) AS n_anchor_descendants,
 CAST((SELECT count(*) FROM u WHERE (d = node AND a % 9 = 4) OR (a = node AND d % 9 = 4)) = 0 AS BIGINT) AS antichain_ok FROM n""")
def _(r):
    nodes = r.tree().select(F.col("parent").alias("node")).unionAll(r.tree().select("child")).distinct()
    return ontology.hierarchy_annotation(nodes, r.tree(), nodes.where("node % 9 = 4").withColumnRenamed("node", "anchor"))


@query("g06_nearest_anchor", "tree", f"""
{_REACH}, n AS (SELECT DISTINCT unnest([parent, child]) AS node FROM tree), c AS (SELECT d AS node, a, h FROM up WHERE a % 7 = 3 AND h <= 15 UNION ALL SELECT node, node, 0 FROM n WHERE node % 7 = 3),
b AS (SELECT node, a, h, row_number() OVER (PARTITION BY node ORDER BY h, a) AS r FROM c)
SELECT n.node, coalesce(b.a, n.node) AS anchor, CAST(b.h AS BIGINT) AS depth FROM n LEFT JOIN b ON n.node = b.node AND b.r = 1""")
def _(r):
    nodes = r.tree().select(F.col("parent").alias("node")).unionAll(r.tree().select("child")).distinct()
    return ontology.nearest_anchor(nodes, r.tree(), nodes.where("node % 7 = 3").withColumnRenamed("node", "anchor"))


_DAG = "SELECT DISTINCT l_suppkey + 1000000 AS parent, l_partkey AS child FROM lineitem"


def _dag(r):
    return r.table("lineitem").select((F.col("l_suppkey") + 1000000).alias("parent"), F.col("l_partkey").alias("child")).distinct()


@query("g07_elevate", "genes", f"""
WITH e AS ({_DAG}), f AS (SELECT parent, count(*) AS fan FROM e GROUP BY 1 HAVING count(*) <= 520),
p AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY fan, parent) AS r FROM e JOIN f USING (parent))
SELECT gene_index AS anchor, coalesce(parent, gene_index) AS key FROM genes LEFT JOIN p ON gene_index = child AND r = 1""")
def _(r):
    return ontology.elevate(r.genes().select(F.col("gene_index").alias("anchor")), _dag(r), cap=520)


@query("g08_nearest_key", "tree", f"""
{_REACH}, n AS (SELECT DISTINCT unnest([parent, child]) AS node FROM tree), b AS (SELECT d AS node, a, row_number() OVER (PARTITION BY d ORDER BY h, a) AS r FROM (SELECT d, a, h FROM up WHERE a IN (5, 6, 7) UNION ALL SELECT node, node, 0 FROM n WHERE node IN (5, 6, 7)))
SELECT n.node, coalesce(a, n.node) AS anchor FROM n LEFT JOIN b ON n.node = b.node AND r = 1""")
def _(r):
    nodes = r.tree().select(F.col("parent").alias("node")).unionAll(r.tree().select("child")).distinct()
    return ontology.nearest_anchor(nodes, r.tree(), nodes.where("node in (5, 6, 7)").withColumnRenamed("node", "anchor"), 60).select("node", "anchor")


@query("g09_fan_outs", "", f"SELECT parent, count(DISTINCT child) AS fanout FROM ({_DAG}) GROUP BY 1")
def _(r):
    return ontology.fan_outs(_dag(r))


@query("g10_mapped_anchors", "", """
SELECT DISTINCT l_suppkey AS anchor FROM (SELECT 'DOID:' || s_suppkey AS doid FROM supplier WHERE s_acctbal < 0) s JOIN (SELECT DISTINCT 'DOID:' || l_partkey AS ref, l_suppkey FROM lineitem) m ON doid = ref""")
def _(r):
    slim = r.table("supplier").where("s_acctbal < 0").select(F.concat(F.lit("DOID:"), F.col("s_suppkey").cast("string")).alias("doid"))
    refs = r.table("lineitem").select(F.concat(F.lit("DOID:"), F.col("l_partkey").cast("string")).alias("doid"), F.col("l_suppkey").alias("anchor"))
    return slim.join(refs, "doid").select("anchor").distinct()


@query("g11_split", "split_tagged", "SELECT split, count(*) AS n, count(DISTINCT split_key) AS n_keys FROM split_tagged GROUP BY 1")
def _(r):
    return r.split_tagged().groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("split_key").alias("n_keys"))


@query("g12_split_audit", "split_tagged", """
WITH s AS (SELECT split_key, count(DISTINCT split) AS c FROM split_tagged GROUP BY 1)
SELECT split, count(*) AS n_rows, CAST(sum(is_target) AS BIGINT) AS n_pos, round(avg(is_target), 6) AS rate, count(DISTINCT disease_index) AS n_diseases, count(DISTINCT t.split_key) AS n_keys,
 count(DISTINCT CASE WHEN c > 1 THEN t.split_key END) AS n_straddling FROM split_tagged t JOIN s ON t.split_key = s.split_key GROUP BY 1""")
def _(r):
    return rounded(ontology.split_audit(r.split_tagged()), "rate")


@query("g12_split_overlap", "", """
WITH t AS (SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'a' WHEN l_linenumber % 3 = 1 THEN 'b' ELSE 'c' END AS split, l_suppkey AS k FROM lineitem)
SELECT x.split AS a, y.split AS b, count(*) AS shared FROM t x JOIN t y ON x.k = y.k AND x.split < y.split GROUP BY 1, 2""")
def _(r):
    m = F.col("l_linenumber") % 3
    t = r.table("lineitem").select(F.when(m == 0, "a").when(m == 1, "b").otherwise("c").alias("split"), F.col("l_suppkey").alias("k"))
    return ontology.split_overlap(t, "k")


@query("g13_relabel", "", "SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS relation, count(*) AS n FROM lineitem GROUP BY 1")
def _(r):
    return ontology.relabel(r.table("lineitem").select(F.col("l_returnflag").alias("relation")), "relation", {"A": "accepted", "R": "returned"}).groupBy("relation").agg(F.count("*").alias("n"))


# Features. The graphs are those of the roles; gates are the reference default.


@query("f01_module_size", "assoc", "SELECT disease_index, count(*) AS module_size FROM assoc GROUP BY 1 HAVING count(*) >= 20")
def _(r):
    return features.module_size(r.assoc())


@query("f02_degree_controls", "genes ppi assoc pathway", """
SELECT g.gene_index, coalesce(d, 0) // 2 AS ppi_degree, coalesce(a, 0) AS n_diseases, coalesce(p, 0) AS n_pathways FROM genes g
LEFT JOIN (SELECT n, count(*) AS d FROM (SELECT x_index AS n FROM ppi UNION ALL SELECT y_index FROM ppi) GROUP BY 1) ON g.gene_index = n
LEFT JOIN (SELECT gene_index, count(*) AS a FROM assoc GROUP BY 1) x ON g.gene_index = x.gene_index LEFT JOIN (SELECT gene_index, count(*) AS p FROM pathway GROUP BY 1) y ON g.gene_index = y.gene_index""")
def _(r):
    return features.degree_controls(r.genes(), r.ppi(), r.assoc(), r.pathway())


_MODULE = "mod AS (SELECT disease_index, count(*) AS m FROM assoc GROUP BY 1 HAVING count(*) >= 20)"


@query("f03_dwpc_ggd", "ppi assoc", f"""
WITH {_MODULE}, deg AS (SELECT x_index AS g, count(*) AS d FROM ppi GROUP BY 1), ad AS (SELECT gene_index AS g, count(*) AS d FROM assoc GROUP BY 1)
SELECT e.x_index AS gene_index, a.disease_index, round(sum(power(dg.d * dm.d * ad.d * (m - CASE WHEN o.gene_index IS NULL THEN 0 ELSE 1 END), -0.4)), 6) AS dwpc
FROM ppi e JOIN assoc a ON e.y_index = a.gene_index JOIN mod ON a.disease_index = mod.disease_index JOIN deg dg ON dg.g = e.x_index JOIN deg dm ON dm.g = e.y_index JOIN ad ON ad.g = e.y_index
LEFT JOIN assoc o ON o.gene_index = e.x_index AND o.disease_index = a.disease_index GROUP BY 1, 2""")
def _(r):
    return rounded(features.dwpc_ggd(r.ppi(), r.assoc()), "dwpc")


_THROUGH = """
SELECT x.gene_index, a.disease_index, round(sum(power(dx.d * dt.d * dt.d * dm.d * ad.d * (m - CASE WHEN o.gene_index IS NULL THEN 0 ELSE 1 END), -0.4)), 6) AS dwpc
FROM ann x JOIN ann y ON x.term_index = y.term_index AND x.gene_index <> y.gene_index JOIN assoc a ON y.gene_index = a.gene_index JOIN mod ON a.disease_index = mod.disease_index
JOIN gd dx ON dx.g = x.gene_index JOIN gd dm ON dm.g = y.gene_index JOIN td dt ON dt.t = x.term_index JOIN ad ON ad.g = y.gene_index
LEFT JOIN assoc o ON o.gene_index = x.gene_index AND o.disease_index = a.disease_index GROUP BY 1, 2"""
_DEGREES = "gd AS (SELECT gene_index AS g, count(*) AS d FROM ann GROUP BY 1), td AS (SELECT term_index AS t, count(*) AS d FROM ann GROUP BY 1)"


@query("f04_dwpc_gpgd", "pathway assoc", f"WITH {_MODULE}, ann AS (SELECT * FROM pathway), {_DEGREES}, ad AS (SELECT gene_index AS g, count(*) AS d FROM assoc GROUP BY 1) {_THROUGH}")
def _(r):
    return rounded(features.dwpc_through(r.pathway(), r.assoc()), "dwpc")


@query("f05_dwpc_gcd", "drug_protein drug_disease", """
WITH gd AS (SELECT DISTINCT gene_index, drug FROM drug_protein), dd AS (SELECT DISTINCT drug, disease_index FROM drug_disease)
SELECT g.gene_index, d.disease_index, round(sum(power(a.n * b.n, -0.4) * power(c.n * e.n, -0.4)), 6) AS dwpc FROM gd g JOIN dd d ON g.drug = d.drug
JOIN (SELECT gene_index, count(*) AS n FROM gd GROUP BY 1) a ON g.gene_index = a.gene_index JOIN (SELECT drug, count(*) AS n FROM gd GROUP BY 1) b ON g.drug = b.drug
JOIN (SELECT drug, count(*) AS n FROM dd GROUP BY 1) c ON d.drug = c.drug JOIN (SELECT disease_index, count(*) AS n FROM dd GROUP BY 1) e ON d.disease_index = e.disease_index GROUP BY 1, 2""")
def _(r):
    return rounded(features.dwpc_via_drug(r.drug_protein(), r.drug_disease()), "dwpc")


@query("f06_dwpc_capped", "pathway assoc", f"""
WITH {_MODULE}, ann AS (SELECT * FROM pathway WHERE term_index IN (SELECT term_index FROM pathway GROUP BY 1 HAVING count(*) <= 86)), {_DEGREES},
ad AS (SELECT gene_index AS g, count(*) AS d FROM assoc WHERE disease_index IN (SELECT disease_index FROM mod) GROUP BY 1) {_THROUGH}""")
def _(r):
    return rounded(features.dwpc_through(r.pathway(), r.assoc(), max_fanout=86, eligible_only=True), "dwpc")


@query("f07_neighbourhood", "ppi assoc", f"""
WITH {_MODULE}, deg AS (SELECT x_index AS g, count(*) AS d FROM ppi GROUP BY 1)
SELECT e.x_index AS gene_index, a.disease_index, count(*) AS common, round(sum(CASE WHEN dm.d > 1 THEN 1 / ln(dm.d) ELSE 0.0 END), 6) AS adamic_adar,
 round(count(*) / (any_value(dg.d) + any_value(m) - count(DISTINCT o.gene_index) - count(*)), 6) AS jaccard
FROM ppi e JOIN assoc a ON e.y_index = a.gene_index JOIN mod ON a.disease_index = mod.disease_index JOIN deg dg ON dg.g = e.x_index JOIN deg dm ON dm.g = e.y_index
LEFT JOIN assoc o ON o.gene_index = e.x_index AND o.disease_index = a.disease_index GROUP BY 1, 2""")
def _(r):
    return rounded(features.neighbourhood(r.ppi(), r.assoc()), "adamic_adar", "jaccard")


@query("f08_shared_terms", "pathway assoc", f"""
WITH {_MODULE}, own AS (SELECT gene_index, count(*) AS n FROM pathway GROUP BY 1)
SELECT x.gene_index, a.disease_index, count(DISTINCT x.term_index) AS shared, round(count(DISTINCT x.term_index) / any_value(own.n), 6) AS fraction FROM pathway x JOIN pathway y ON x.term_index = y.term_index AND x.gene_index <> y.gene_index
JOIN assoc a ON y.gene_index = a.gene_index JOIN mod ON a.disease_index = mod.disease_index JOIN own ON own.gene_index = x.gene_index GROUP BY 1, 2""")
def _(r):
    return rounded(features.shared_terms(r.pathway(), r.assoc()), "fraction")


@query("f09_disease_context", "assoc", """
WITH e AS (SELECT DISTINCT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey)
SELECT gene_index, a AS disease_index, count(DISTINCT b) AS n_context FROM e JOIN assoc ON b = disease_index GROUP BY 1, 2""")
def _(r):
    group = F.concat_ws("|", "c_nationkey", "c_mktsegment")
    members = r.table("customer").select(F.col("c_custkey").alias("disease_index"), group.alias("group"))
    return features.disease_context_of_groups(r.assoc(), members)


@query("f10_keyword_flag", "pathway", "SELECT DISTINCT gene_index, CAST(1 AS BIGINT) AS flag FROM pathway JOIN supplier ON term_index = s_suppkey WHERE contains(s_name, '7') OR contains(s_name, '13')")
def _(r):
    terms = r.table("supplier").select(F.col("s_suppkey").alias("term_index"), F.col("s_name").alias("name"))
    return features.keyword_flag(r.pathway(), terms, ["7", "13"])


@query("f11_common_neighbour_z", "ppi assoc", """
WITH deg AS (SELECT x_index AS g, count(*) AS d FROM ppi GROUP BY 1), ins AS (SELECT a.* FROM assoc a WHERE gene_index IN (SELECT g FROM deg)), k AS (SELECT disease_index, count(*) AS k FROM ins GROUP BY 1), n AS (SELECT count(*) AS n FROM deg),
x AS (SELECT x_index AS gene_index, disease_index, count(*) AS x FROM ppi JOIN ins ON y_index = gene_index GROUP BY 1, 2),
j AS (SELECT x.*, d * k / n AS mu, (d * k / n) * ((n - k) / n) * ((n - d) / (n - 1)) AS v FROM x JOIN deg ON x.gene_index = g JOIN k ON x.disease_index = k.disease_index, n)
SELECT gene_index, disease_index, x, CASE WHEN v > 0 THEN round((x - mu) / sqrt(v), 6) END AS z FROM j""")
def _(r):
    return rounded(features.common_neighbour_z(r.ppi(), r.assoc()), "z")


# The third hop is asked only of what the second doesn't reach.
_HOPS = """s AS (SELECT DISTINCT gene_index AS s FROM ins JOIN fit USING (disease_index)), one AS (SELECT s, y_index AS n, 1 AS h FROM s JOIN ppi ON s = x_index),
two AS (SELECT DISTINCT s, y_index AS n, 2 AS h FROM one JOIN ppi ON n = x_index), far AS (SELECT s, x_index AS n FROM s, (SELECT DISTINCT x_index FROM ppi) EXCEPT SELECT s, n FROM two),
three AS (SELECT DISTINCT far.s, far.n, 3 AS h FROM far JOIN ppi e ON e.y_index = far.n JOIN two ON two.s = far.s AND two.n = e.x_index),
dist AS (SELECT s, n, min(h) AS h FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) WHERE s <> n GROUP BY 1, 2)"""


@query("f12_proximity", "ppi assoc", f"""
WITH {_MODULE}, ins AS (SELECT * FROM assoc WHERE gene_index IN (SELECT x_index FROM ppi)), fit AS (SELECT disease_index FROM ins GROUP BY 1 HAVING count(*) >= 5 INTERSECT SELECT disease_index FROM mod), {_HOPS}
SELECT n AS gene_index, disease_index, CAST(min(h) AS BIGINT) AS closest, round(avg(h), 6) AS mean_distance, round(sum(exp(-h)), 6) AS kernel, count(*) AS n_reach
FROM ins JOIN fit USING (disease_index) JOIN dist ON gene_index = s GROUP BY 1, 2""")
def _(r):
    return rounded(features.proximity(r.ppi(), r.assoc()), "mean_distance", "kernel")


@query("f13_random_walk")
def _(r):
    seeds = r.assoc().select(F.col("disease_index").alias("walk_id"), F.col("gene_index").alias("node"))
    return features.random_walk(r.ppi(), seeds)


@query("f13_held_out_walk")
def _(r):
    return features.held_out_walk(r.ppi(), r.assoc())


@query("f14_evidence_depth", "", """
WITH l AS (SELECT l_partkey AS x, l_suppkey AS y, CASE WHEN l_linenumber % 3 = 0 THEN 2 WHEN l_linenumber % 3 = 1 THEN 1 END AS n FROM lineitem), e AS (SELECT x AS g, n FROM l WHERE n IS NOT NULL UNION ALL SELECT y, n FROM l WHERE n IS NOT NULL)
SELECT g AS gene_index, round(avg(n), 6) AS depth, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS multi_fraction FROM e GROUP BY 1""")
def _(r):
    from .relational import _links

    return rounded(features.evidence_depth(_links(r)), "depth", "multi_fraction")


@query("f15_localisation", "tree pathway", f"""
{_REACH}, m AS (SELECT 3 AS t UNION SELECT d FROM up WHERE a = 3), s AS (SELECT 5 AS t UNION SELECT d FROM up WHERE a = 5),
f AS (SELECT gene_index, CAST(max(CASE WHEN term_index IN (SELECT t FROM m) THEN 1 ELSE 0 END) AS BIGINT) AS is_membrane, CAST(max(CASE WHEN term_index IN (SELECT t FROM s) THEN 1 ELSE 0 END) AS BIGINT) AS is_secreted FROM pathway GROUP BY 1)
SELECT *, CASE WHEN is_membrane = 1 AND is_secreted = 1 THEN 'both' WHEN is_membrane = 1 THEN 'membrane' WHEN is_secreted = 1 THEN 'secreted' ELSE 'intracellular_or_unannotated' END AS localisation FROM f""")
def _(r):
    return features.localisation(r.pathway(), r.tree(), [3], [5])


@query("f16_triangles", "ppi", """
WITH u AS (SELECT x_index AS a, y_index AS b FROM ppi WHERE x_index < y_index), t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
c AS (SELECT n, count(*) AS t FROM (SELECT unnest([i, j, k]) AS n FROM t) GROUP BY 1), d AS (SELECT x_index AS n, count(*) AS k FROM ppi GROUP BY 1)
SELECT d.n AS node, k AS degree, coalesce(t, 0) AS triangles, round(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0.0 END, 6) AS clustering FROM d LEFT JOIN c ON d.n = c.n""")
def _(r):
    return rounded(features.triangles(r.ppi()), "clustering")


@query("f16_pagerank", "ppi", """
WITH RECURSIVE d AS (SELECT x_index AS n, count(*) AS k FROM ppi GROUP BY 1), t AS (SELECT count(*) AS n FROM d), e AS (SELECT x_index, y_index, k FROM ppi JOIN d ON x_index = n),
s AS (SELECT 0 AS i, d.n AS node, CAST(1.0 AS DOUBLE) / t.n AS score FROM d, t UNION ALL SELECT i + 1, y_index, any_value(CAST(0.15 AS DOUBLE) / t.n) + CAST(0.85 AS DOUBLE) * sum(score / k) FROM s JOIN e ON node = x_index, t WHERE i < 20 GROUP BY i, y_index)
SELECT node, round(score, 6) AS score FROM s WHERE i = 20""")
def _(r):
    return rounded(features.pagerank(r.ppi()), "score")


@query("f16_eigenvector", "ppi", """
WITH RECURSIVE s AS (SELECT DISTINCT 0 AS i, x_index AS node, CAST(1.0 AS DOUBLE) AS score FROM ppi
 UNION ALL SELECT i, node, raw / max(raw) OVER () FROM (SELECT i + 1 AS i, y_index AS node, sum(score) AS raw FROM s JOIN ppi ON node = x_index WHERE i < 20 GROUP BY i, y_index))
SELECT node, round(score, 6) AS score FROM s WHERE i = 20""")
def _(r):
    return rounded(features.eigenvector(r.ppi()), "score")


@query("f17_merge_interactomes", "ppi", """
WITH s AS (SELECT x_index, y_index, 'a' AS source FROM ppi UNION ALL SELECT y_index, x_index, 'b' FROM ppi WHERE x_index % 2 = 0 UNION ALL SELECT x_index, y_index, 'c' FROM ppi WHERE y_index % 3 = 0)
SELECT least(x_index, y_index) AS a, greatest(x_index, y_index) AS b, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM s GROUP BY 1, 2""")
def _(r):
    s = r.ppi()
    return features.merge_interactomes({"a": s, "b": s.where("x_index % 2 = 0"), "c": s.where("y_index % 3 = 0")})


@query("f18_explain_paths", "ppi assoc", """
SELECT DISTINCT CAST(17 AS BIGINT) AS gene_index, y_index AS middle, disease_index FROM ppi JOIN assoc ON y_index = gene_index WHERE x_index = 17 AND disease_index = (SELECT min(disease_index) FROM assoc) AND y_index <> 17 ORDER BY middle LIMIT 40""")
def _(r):
    first = r.assoc().agg(F.min("disease_index")).first()[0]
    return features.explain_paths(r.ppi().select(F.col("x_index").alias("gene_index"), F.col("y_index").alias("middle")), r.assoc().select(F.col("gene_index").alias("middle"), "disease_index"), 17, first)


@query("f19_resolve_names", "indexed", "SELECT node_name, node_index FROM indexed WHERE node_name IN (SELECT s_name FROM supplier WHERE s_suppkey IN (1, 4))")
def _(r):
    names = [x[0] for x in r.table("supplier").where("s_suppkey in (1, 4)").select("s_name").collect()]
    return features.resolve_names(r.indexed(), names)


@query("f20_admission", "routes", "SELECT disease_index, gene_index FROM routes WHERE dwpc_ggd IS NOT NULL OR dwpc_gpgd IS NOT NULL OR dwpc_gcd IS NOT NULL")
def _(r):
    return features.admitted(r.routes()).select("disease_index", "gene_index")
