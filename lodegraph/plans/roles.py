"""The driver's tables in the roles of graph and ranking data: the same projections as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: role: (roles it rests on, SQL)
ROLE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "scored": ((), """SELECT l_suppkey AS disease_index, l_partkey AS gene_index, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS is_target,
  max(l_extendedprice * (1 - l_discount)) AS proba, max(l_quantity) AS qty, max(l_tax) AS tax, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY 1, 2"""),
    "diseases": ((), "SELECT s_suppkey AS disease_index, s_name AS disease, CAST(s_nationkey AS BIGINT) AS family_id FROM supplier"),
    "genes": ((), "SELECT p_partkey AS gene_index, p_name AS gene_name, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size FROM part"),
    "truth": ((), "SELECT DISTINCT l_suppkey AS disease_index, l_partkey AS gene_index FROM lineitem WHERE l_discount >= 0.09"),
    "assoc": ((), "SELECT DISTINCT l_partkey AS gene_index, o_custkey AS disease_index FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"),
    "ppi": ((), "SELECT DISTINCT a.l_partkey AS x_index, b.l_partkey AS y_index FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey"),
    "pathway": ((), "SELECT DISTINCT l_partkey AS gene_index, l_suppkey AS term_index FROM lineitem WHERE l_linenumber = 1"),
    "drug_disease": ((), """SELECT DISTINCT o_custkey % 200 AS drug, l_suppkey AS disease_index,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'Indication' WHEN o_orderpriority LIKE '2%' THEN 'contraindication' ELSE 'drug_investigated_for' END AS relation
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 2"""),
    "drug_protein": ((), "SELECT DISTINCT o_custkey % 200 AS drug, l_partkey AS gene_index, o_orderstatus AS action FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 45"),
    "nodes": ((), """SELECT CAST(p_partkey AS VARCHAR) AS node_id, 'gene/protein' AS node_type, p_name AS node_name, 'NCBI' AS node_source FROM part
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'disease', c_name, 'MONDO' FROM customer
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'pathway', s_name, 'REACTOME' FROM supplier"""),
    "indexed": (("nodes",), "SELECT node_id, node_type, node_name, node_source, CAST(row_number() OVER (ORDER BY node_type, node_source, node_id, node_name) AS BIGINT) AS node_index FROM nodes"),
    "tree": ((), "SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey >= 2"),
    "routes": ((), """SELECT l_suppkey AS disease_index, l_partkey AS gene_index, max(CASE WHEN l_linenumber = 1 THEN l_tax END) AS dwpc_ggd,
  max(CASE WHEN l_linenumber = 2 THEN l_discount END) AS dwpc_gpgd, max(CASE WHEN l_quantity < 5 THEN l_quantity END) AS dwpc_gcd FROM lineitem GROUP BY 1, 2"""),
    "split_tagged": (("scored", "diseases"), """SELECT CASE WHEN family_id IN (3, 7) OR (family_id % 10) < 5 THEN 'validation' WHEN family_id % 10 = 5 THEN 'test' ELSE 'train' END AS split,
  s.disease_index, family_id AS split_key, is_target FROM scored s JOIN diseases d ON s.disease_index = d.disease_index"""),
    "drug_evidence": (("drug_disease", "drug_protein"), """SELECT coalesce(a.disease_index, i.disease_index) AS disease_index, coalesce(a.gene_index, i.gene_index) AS gene_index,
  CAST(CASE WHEN a.gene_index IS NULL THEN 0 ELSE 1 END AS BIGINT) AS in_approved, CAST(CASE WHEN i.gene_index IS NULL THEN 0 ELSE 1 END AS BIGINT) AS in_investigated
  FROM (SELECT DISTINCT disease_index, gene_index FROM drug_disease JOIN drug_protein USING (drug) WHERE lower(relation) = 'indication') a
  FULL JOIN (SELECT DISTINCT disease_index, gene_index FROM drug_disease JOIN drug_protein USING (drug) WHERE lower(relation) = 'drug_investigated_for') i
  ON a.disease_index = i.disease_index AND a.gene_index = i.gene_index"""),
}


class Roles:
    """One DataFrame per role, built on the tables under ``sf_dir`` and planned lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scored(self) -> DataFrame:
        li = self.table("lineitem")
        return li.groupBy(F.col("l_suppkey").alias("disease_index"), F.col("l_partkey").alias("gene_index")).agg(
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long").alias("is_target"),
            F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("proba"),
            F.max("l_quantity").alias("qty"),
            F.max("l_tax").alias("tax"),
            F.count("*").alias("n_rows"),
        )

    def diseases(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("disease_index"), F.col("s_name").alias("disease"), F.col("s_nationkey").cast("long").alias("family_id"))

    def genes(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("gene_index"), F.col("p_name").alias("gene_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"))

    def truth(self) -> DataFrame:
        return self.table("lineitem").where("l_discount >= 0.09D").select(F.col("l_suppkey").alias("disease_index"), F.col("l_partkey").alias("gene_index")).distinct()

    def _order_lines(self) -> DataFrame:
        return self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    def assoc(self) -> DataFrame:
        return self._order_lines().where("l_returnflag = 'R'").select(F.col("l_partkey").alias("gene_index"), F.col("o_custkey").alias("disease_index")).distinct()

    def ppi(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_partkey")
        a, b = li.withColumnRenamed("l_partkey", "x_index"), li.withColumnRenamed("l_partkey", "y_index")
        # One way is shuffled; the other is its mirror.
        one = a.join(b, "l_orderkey").where("x_index < y_index").select("x_index", "y_index").distinct()
        return one.unionAll(one.select(F.col("y_index").alias("x_index"), F.col("x_index").alias("y_index")))

    def pathway(self) -> DataFrame:
        return self.table("lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("gene_index"), F.col("l_suppkey").alias("term_index")).distinct()

    def drug_disease(self) -> DataFrame:
        p = F.col("o_orderpriority")
        relation = F.when(p.startswith("1"), "Indication").when(p.startswith("2"), "contraindication").otherwise("drug_investigated_for")
        return self._order_lines().where("l_linenumber = 2").select((F.col("o_custkey") % 200).alias("drug"), F.col("l_suppkey").alias("disease_index"), relation.alias("relation")).distinct()

    def drug_protein(self) -> DataFrame:
        return self._order_lines().where("l_quantity >= 45").select((F.col("o_custkey") % 200).alias("drug"), F.col("l_partkey").alias("gene_index"), F.col("o_orderstatus").alias("action")).distinct()

    def nodes(self) -> DataFrame:
        def of(table, key, name, kind, source):
            return self.table(table).select(F.col(key).cast("string").alias("node_id"), F.lit(kind).alias("node_type"), F.col(name).alias("node_name"), F.lit(source).alias("node_source"))

        return of("part", "p_partkey", "p_name", "gene/protein", "NCBI").unionAll(of("customer", "c_custkey", "c_name", "disease", "MONDO")).unionAll(of("supplier", "s_suppkey", "s_name", "pathway", "REACTOME"))

    def indexed(self) -> DataFrame:
        from ..operators.sets import assign_node_index

        return assign_node_index(self.nodes())

    def tree(self) -> DataFrame:
        return self.table("part").where("p_partkey >= 2").select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("child"))

    def routes(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("disease_index"), F.col("l_partkey").alias("gene_index")).agg(
            F.max(F.when(F.col("l_linenumber") == 1, F.col("l_tax"))).alias("dwpc_ggd"),
            F.max(F.when(F.col("l_linenumber") == 2, F.col("l_discount"))).alias("dwpc_gpgd"),
            F.max(F.when(F.col("l_quantity") < 5, F.col("l_quantity"))).alias("dwpc_gcd"),
        )

    def split_tagged(self) -> DataFrame:
        from ..operators.ontology import split_of

        joined = self.scored().join(self.diseases(), "disease_index")
        return joined.select(split_of(F.col("family_id"), forced=(3, 7)).alias("split"), "disease_index", F.col("family_id").alias("split_key"), "is_target")

    def drug_evidence(self) -> DataFrame:
        from ..operators.joins import drug_evidence_pairs

        return drug_evidence_pairs(self.drug_disease(), self.drug_protein())
