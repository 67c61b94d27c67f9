"""Stacking, set algebra and graph assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

EDGE = ["x_id", "x_type", "x_source", "y_id", "y_type", "y_source", "relation", "display_relation"]
NODE_KEY = ["node_type", "node_source", "node_id", "node_name"]


def drop_self_loops(edges: DataFrame, parts: tuple[str, ...] = ("id", "type", "source")) -> DataFrame:
    """Edges whose ends differ in some part of the key; nulls equal nulls."""
    same = reduce(lambda a, b: a & b, [F.col(f"x_{p}").eqNullSafe(F.col(f"y_{p}")) for p in parts])
    return edges.where(~same)


def stack_union(tables: list[DataFrame], distinct: bool = True) -> DataFrame:
    """UNION by name, absent columns null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.distinct() if distinct else out


def reversed_edges(edges: DataFrame) -> DataFrame:
    other = {"x": "y", "y": "x"}
    return edges.select(*[F.col(f"{other[c[0]]}{c[1:]}" if c[:2] in ("x_", "y_") else c).alias(c) for c in edges.columns])


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges with their reverses, distinct."""
    return edges.unionByName(reversed_edges(edges)).distinct()


def emergent_nodes(edges: DataFrame) -> DataFrame:
    """The distinct ends of edges."""
    ends = [edges.select(F.col(f"{e}_id").alias("node_id"), F.col(f"{e}_type").alias("node_type"), F.col(f"{e}_source").alias("node_source")) for e in "xy"]
    return ends[0].unionAll(ends[1]).distinct()


def ground(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Edges with the names of both ends; an end without a name drops its edge (J2). vocabulary: node_type, node_id, node_name, priority.

    Of several names for an id the one of the highest priority counts (later lists win), then the smallest. A vocabulary may be
    large; Spark broadcasts it only if its measured size allows.
    """
    best = vocabulary.where(F.col("node_name").isNotNull()).groupBy("node_type", "node_id").agg(F.min(F.struct(-F.col("priority"), "node_name"))["node_name"].alias("name"))
    for end in "xy":
        names = best.select(F.col("node_type").alias(f"{end}_type"), F.col("node_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
        edges = edges.join(names, [f"{end}_type", f"{end}_id"])
    return edges


def rewrite_groups(edges: DataFrame, groups: DataFrame, source: str = "MONDO_grouped") -> DataFrame:
    """Ends that ``groups`` (node_id, group_id, group_name) maps take the group's id, name and source; then distinct, no self-loops."""
    for end in "xy":
        g = groups.select(F.col("node_id").alias(f"{end}_id"), F.col("group_id").alias("__id"), F.col("group_name").alias("__name"))
        edges = edges.join(g, f"{end}_id", "left").withColumns({f"{end}_id": F.coalesce("__id", f"{end}_id"), f"{end}_name": F.coalesce("__name", f"{end}_name"), f"{end}_source": F.when(F.col("__id").isNotNull(), source).otherwise(F.col(f"{end}_source"))}).drop("__id", "__name")
    return drop_self_loops(edges.distinct(), ("id", "type", "source", "name"))


def assign_node_index(nodes: DataFrame) -> DataFrame:
    """node_index from 1 in the order of NODE_KEY (W1), without gathering the table in one task.

    Rows are range-partitioned and sorted; a partition's rows are numbered within it, and the count of all partitions before
    (a table of one row per partition) is added.
    """
    keyed = nodes.select(*NODE_KEY).repartitionByRange(*NODE_KEY).withColumn("__p", F.spark_partition_id())
    keyed = written(keyed)
    # Equal rows stand in one partition, so a rank within it is exact whatever the order of equals.
    local = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*NODE_KEY)))
    sizes = local.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return local.join(F.broadcast(before), "__p").select("node_id", "node_type", "node_name", "node_source", (F.col("__n") + F.col("__before")).cast("long").alias("node_index"))


def attach_node_index(edges: DataFrame, nodes: DataFrame, check: bool = False) -> DataFrame:
    """Edges with x_index and y_index by the whole node key (J1). ``check``: raises if a key is repeated or an end has no node."""
    key = ["node_id", "node_type", "node_source", "node_name"]
    if check and nodes.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError("a node key is repeated")
    for end in "xy":
        edges = edges.join(nodes.select(*[F.col(c).alias(f"{end}_{c[5:]}") for c in key], F.col("node_index").alias(f"{end}_index")), [f"{end}_{c[5:]}" for c in key], "left")
    if check and edges.where("x_index is null or y_index is null").limit(1).count():
        raise ValueError("an end has no node")
    return edges


def pooled_sets(links: DataFrame, column: str, sep: str = "+") -> DataFrame:
    """(a, b, column): the union of the sets written in ``column`` over both directions of each link (A5)."""
    parts = links.where(F.col(column).isNotNull()).select(F.least("x_index", "y_index").alias("a"), F.greatest("x_index", "y_index").alias("b"), F.explode(F.split(column, f"\\{sep}")).alias("part"))
    return parts.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("part")), sep).alias(column))


def set_overlap(sets: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, shared, jaccard) of all groups that share a member (U6). Group pairs come from members, not from a cross join."""
    sets = sets.select(group, member).distinct()
    sizes = sets.groupBy(group).agg(F.count("*").alias("n"))
    left, right = sets.select(F.col(group).alias("a"), member), sets.select(F.col(group).alias("b"), member)
    shared = left.join(right, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def tag_and_concat(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Frames under one another, each named in ``tag``."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])
