"""Operators on hierarchies and graphs: components, closures, nearest anchors, key elevation, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import reach_counts
from .products import products
from .store import connected_components, release, written


def components(edges: DataFrame, x: str = "x_index", y: str = "y_index") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (G1, G2). A node of self-loops alone is its own."""
    found = connected_components(edges, x, y)
    nodes = edges.select(F.col(x).alias("node")).unionAll(edges.select(F.col(y))).where("node is not null").distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def largest_component(edges: DataFrame, x: str = "x_index", y: str = "y_index") -> DataFrame:
    """The edges of the largest component; of equally large ones, of that with the smallest node (G1)."""
    labels = components(edges, x, y)
    best = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = labels.join(F.broadcast(best), "component").select(F.col("node").alias(x))
    return edges.join(inside, x, "left_semi")


def closure(edges: DataFrame, parent: str = "parent", child: str = "child", max_depth: int = 60) -> DataFrame:
    """(ancestor, descendant, depth): least depth over a DAG of parent-child edges (G4, G5). Paths double in length each round.

    Raises if something lies deeper than ``max_depth``.
    """
    step = written(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"), F.lit(1).alias("depth")).distinct())
    known, reach = step, 1
    size = known.count()
    while reach < max_depth:
        far = known.select(F.col("ancestor").alias("middle"), F.col("descendant").alias("d2"), F.col("depth").alias("e2"))
        longer = known.join(far, F.col("descendant") == F.col("middle")).select("ancestor", F.col("d2").alias("descendant"), (F.col("depth") + F.col("e2")).alias("depth"))
        known = written(known.unionAll(longer).where(F.col("depth") <= max_depth).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
        now, reach = known.count(), reach * 2
        if now == size:
            break
        size = now
    ends = known.where(F.col("depth") == max_depth).select("ancestor", F.col("descendant").alias("middle"))
    deeper = ends.join(step.select(F.col("ancestor").alias("middle"), "descendant"), "middle").join(known, ["ancestor", "descendant"], "left_anti")
    if not deeper.isEmpty():
        raise ValueError(f"a descendant lies deeper than {max_depth}")
    return known.withColumn("depth", F.col("depth").cast("long"))


def nearest_anchor(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, max_depth: int = 15) -> DataFrame:
    """(node, anchor, depth): the nearest anchor at or above a node, ties to the smallest; the node itself, depth null, if none.

    nodes: node; anchors: anchor; edges: parent, child. Anchors go down level by level and a node keeps the first that reaches it: the
    smallest one at least depth comes through a parent that has it as its own. So each node is in the frontier once, and the
    search ends after ``max_depth`` rounds or when nothing new is reached.
    """
    steps = written(edges.select("parent", "child").distinct())
    seen = frontier = written(anchors.select(F.col("anchor").alias("node"), "anchor", F.lit(0).cast("long").alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("parent")).groupBy("child").agg(F.min("anchor").alias("anchor"))
        fresh = reached.select(F.col("child").alias("node"), "anchor", F.lit(depth).cast("long").alias("depth"))
        frontier = written(fresh.join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return nodes.join(seen, "node", "left").select("node", F.coalesce("anchor", "node").alias("anchor"), "depth")


def fan_outs(edges: DataFrame) -> DataFrame:
    """(parent, fanout): distinct children."""
    return edges.groupBy("parent").agg(F.countDistinct("child").alias("fanout"))


def elevate(anchors: DataFrame, edges: DataFrame, cap: int = 20) -> DataFrame:
    """(anchor, key): the parent of the smallest fan-out of at most ``cap``, ties to the smallest id; the anchor itself if none."""
    parents = edges.join(fan_outs(edges).where(F.col("fanout") <= cap), "parent").groupBy("child").agg(F.min(F.struct("fanout", "parent"))["parent"].alias("key"))
    return anchors.join(parents.withColumnRenamed("child", "anchor"), "anchor", "left").select("anchor", F.coalesce("key", "anchor").alias("key"))


def hierarchy_annotation(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per node: counts of parents, children, descendants, anchors above and below, and whether it could be an anchor."""
    count = lambda key, df, out: df.groupBy(F.col(key).alias("node")).agg(F.count("*").alias(out))
    distinct = edges.select("parent", "child").distinct()
    every = nodes.select("node").unionAll(distinct.select("parent")).unionAll(distinct.select("child")).distinct()
    reach = reach_counts(every, distinct, {"anchor": anchors.select(F.col("anchor").alias("node"))})
    names = ["n_parents", "n_children", "n_descendants", "n_anchor_ancestors", "n_anchor_descendants"]
    out = nodes
    for part in (count("child", distinct, "n_parents"), count("parent", distinct, "n_children"), reach):
        out = out.join(part, "node", "left")
    out = out.select("node", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return out.withColumn("antichain_ok", ((F.col("n_anchor_ancestors") == 0) & (F.col("n_anchor_descendants") == 0)).cast("long"))


def split_of(key: Column, forced: tuple[int, ...] = ()) -> Column:
    """validation for forced keys and key mod 10 below 5, test for 5, else train (G11): all of a key's rows go one way."""
    return F.when(key.isin(*forced) | (F.pmod(key, F.lit(10)) < 5), "validation").when(F.pmod(key, F.lit(10)) == 5, "test").otherwise("train")


def split_audit(tagged: DataFrame) -> DataFrame:
    """Per split: rows, positives, rate, diseases, keys, and keys that stand in other splits too."""
    spread = tagged.groupBy("split_key").agg(F.countDistinct("split").alias("in_splits"))
    return tagged.join(spread, "split_key").groupBy("split").agg(
        F.count("*").alias("n_rows"), F.sum("is_target").alias("n_pos"), F.avg("is_target").alias("rate"),
        F.countDistinct("disease_index").alias("n_diseases"), F.countDistinct("split_key").alias("n_keys"),
        F.countDistinct(F.when(F.col("in_splits") > 1, F.col("split_key"))).alias("n_straddling"),
    )


def split_overlap(tagged: DataFrame, key: str) -> DataFrame:
    """(a, b, shared): keys that two splits share."""
    keys = tagged.select("split", key).distinct()
    left, right = keys.select(F.col("split").alias("a"), key), keys.select(F.col("split").alias("b"), key)
    return left.join(right, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def k_hop(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(source, node, hops): nodes within k undirected steps, least hops."""
    # Each edge is shuffled once, and turned into both ways afterwards.
    x, y = F.col("x_index"), F.col("y_index")
    first = y.isNull() | (x <= y)
    one = edges.where(~x.eqNullSafe(y)).select(F.when(first, x).otherwise(y).alias("u"), F.when(first, y).otherwise(x).alias("v")).distinct()
    both = written(one.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v"))
    seen = nodes.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("hops"))
    edge = seen
    if k:
        # The first hop is the edges themselves.
        edge = both.join(nodes.select(F.col("node").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("source"), F.col("v").alias("node"), F.lit(1).cast("long").alias("hops"))
        edge = written(edge) if k > 1 else edge
        seen = seen.unionAll(edge)
    for hop in range(2, k + 1):
        # Pairs of the last hop go straight out; those before it are written for the next.
        found = products(edge.select("source", "node"), both, ["own"], seen.select("source", "node", F.lit(1).alias("met")))
        new = found.where("own IS NULL").select(F.col("g").alias("source"), F.col("d").alias("node"), F.lit(hop).cast("long").alias("hops"))
        edge = written(new) if hop < k else new
        seen = seen.unionAll(edge)
    return seen


def greedy_groups(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, group): a one-hop grouping in which no group's seeds are neighbours (G3, greedy, made independent of row order).

    Nodes have a random order, by a hash of their id. A node that comes before all its ungrouped neighbours seeds a group and takes those
    neighbours, each going to its first seed; rounds go on with the rest. Under a random order the rounds grow with the
    logarithm of the nodes, whatever the shape of the graph; more than ``max_rounds`` raise.
    """
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    both = edges.select(F.col("x_index").alias("u"), F.col("y_index").alias("v"))
    inner = written(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    left = written(inner.select(F.col("u").alias("node")).distinct())
    parts = []
    while not left.isEmpty():
        if len(parts) >= max_rounds:
            raise ValueError(f"groups did not settle in {max_rounds} rounds")
        first = inner.groupBy(F.col("u").alias("node")).agg(F.min(place("v")).alias("m"))
        seeds = left.join(first, "node", "left").where(F.col("m").isNull() | (place("node") < F.col("m"))).select(F.col("node").alias("seed"))
        taken = inner.join(seeds, inner["v"] == seeds["seed"]).groupBy(F.col("u").alias("node")).agg(F.min(place("seed"))["id"].alias("group"))
        part = written(seeds.select(F.col("seed").alias("node"), F.col("seed").alias("group")).unionAll(taken))
        parts.append(part)
        before = left, inner
        left = written(left.join(part, "node", "left_anti"))
        inner = written(inner.join(left.select(F.col("node").alias("u")), "u", "left_semi").join(left.select(F.col("node").alias("v")), "v", "left_semi"))
        release(*before)
    if not parts:
        return left.select("node", F.col("node").alias("group"))
    release(left, inner)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def relabel(edges: DataFrame, column: str, labels: dict[str, str], check: bool = False) -> DataFrame:
    """Labels replaced by a map, others kept (G13, P13). ``check``: raises if rows become alike."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    out = edges.withColumn(column, F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)))
    if check and out.distinct().count() != edges.distinct().count():
        raise ValueError("relabelling made rows alike")
    return out


def share_in_window(df: DataFrame, group: str, n: str = "n") -> DataFrame:
    """Each row's share of its group's total."""
    return df.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(group)))
