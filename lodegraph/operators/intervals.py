"""Counts of descendants and ancestors without their pairs: intervals of a spanning forest, and what non-tree edges add to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_totals
from .store import release, written

#: Deepest path of the forest, at most.
MAX_DEPTH = 60
_LAST = (1 << 63) - 1


def _paths(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, path): the ids from a node's root down to itself. Paths double in length each round; a cycle or too deep a path raises."""
    state = written(nodes.join(tree, F.col("node") == F.col("child"), "left").select("node", F.col("parent").alias("top"), F.array("node").alias("path")))
    reach = 1
    while not state.where("top is not null").isEmpty():
        if reach > MAX_DEPTH:
            raise ValueError(f"a path is longer than {MAX_DEPTH}, or the edges have a cycle")
        up = state.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("path").alias("above"))
        new = written(state.join(up, "top", "left").select("node", F.col("next").alias("top"), F.concat(F.coalesce("above", F.array().cast("array<long>")), "path").alias("path")))
        release(state)
        state, reach = new, reach * 2
    return state.select("node", "path")


def _kept(extras: DataFrame) -> DataFrame:
    """Without intervals that another of the same node holds: intervals of a forest are nested or apart."""
    before = Window.partitionBy("node").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    return extras.withColumn("__held", F.max("hi").over(before)).where("__held is null or hi > __held").drop("__held")


def reach_counts(nodes: DataFrame, edges: DataFrame, flags: dict[str, DataFrame]) -> DataFrame:
    """(node, n_descendants, and for each flag n_<flag>_descendants and n_<flag>_ancestors) of each node of a DAG.

    nodes: distinct node; edges: (parent, child) between nodes; flags: tables of a column node. Each child hangs below its smallest parent; the open
    and close places of nodes in the order of their paths are intervals that hold each other's descendants, so running totals over the
    places count them. A non-tree edge gives its parent, and all above that, the child's interval unless they have it: on a tree there
    is none of these rows, and no row is ever a pair of an ancestor and a descendant.
    """
    direct = written(edges.select(F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child")).distinct())
    tree = direct.groupBy("child").agg(F.min("parent").alias("parent"))
    marked = nodes.select(F.col("node").cast("long").alias("node"))
    for name, members in flags.items():
        marked = marked.join(members.select(F.col("node").cast("long").alias("node"), F.lit(1).cast("long").alias(name)).distinct(), "node", "left").fillna(0, [name])
    marked = written(marked)
    paths = _paths(marked.select("node"), tree).join(marked, "node")
    names, zero = list(flags), F.lit(0).cast("long")
    # Places in the order of paths: a node opens before all below it and closes after them.
    opens = paths.select("path", "node", F.lit(1).cast("long").alias("all"), *names, *[F.col(c).alias(f"in_{c}") for c in names])
    closes = paths.select(F.concat("path", F.array(F.lit(_LAST))).alias("path"), "node", zero.alias("all"), *[zero.alias(c) for c in names], *[(-F.col(c)).alias(f"in_{c}") for c in names])
    places = opens.withColumn("open", F.lit(True)).unionByName(closes.withColumn("open", F.lit(False)))
    totals = running_totals(places, "path", {c: f"to_{c}" for c in ("all", *names, *[f"in_{c}" for c in names])})
    at = lambda c, side: F.max(F.when(F.col("open") if side else ~F.col("open"), F.col(f"to_{c}")))
    spans = totals.groupBy("node").agg(at("all", True).alias("lo"), at("all", False).alias("hi"), *[x for c in names for x in (at(c, True).alias(f"lo_{c}"), at(c, False).alias(f"hi_{c}"), at(f"in_{c}", True).alias(f"above_{c}"))])
    # lo is a node's number, lo..hi its interval; k_ what the interval counts, the node itself among it.
    spans = written(spans.join(marked, "node").select("node", "lo", "hi", (F.col("hi") - F.col("lo") + 1).alias("k_all"), *[x for c in names for x in (c, (F.col(f"hi_{c}") - F.col(f"lo_{c}") + F.col(c)).alias(f"k_{c}"), (F.col(f"above_{c}") - F.col(c)).alias(f"above_{c}"))]))

    counts = ["k_all", *[f"k_{c}" for c in names]]
    own = spans.select(F.col("node").alias("parent"), F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    outside = lambda df: df.join(own, "parent").where("lo < plo or hi > phi").select(F.col("parent").alias("node"), "lo", "hi", *counts)
    loose = direct.join(tree, ["child", "parent"], "left_anti")
    extras = written(_kept(outside(loose.join(spans.select(F.col("node").alias("child"), "lo", "hi", *counts), "child")).distinct()))
    fresh = extras
    for _ in range(MAX_DEPTH):
        if fresh.isEmpty():
            break
        up = outside(direct.join(fresh.withColumnRenamed("node", "child"), "child")).distinct()
        every = written(_kept(extras.unionByName(up).distinct()))
        fresh = written(every.join(extras.select("node", "lo"), ["node", "lo"], "left_anti"))
        extras = every
    else:
        raise ValueError(f"non-tree edges reach up more than {MAX_DEPTH} steps")
    added = extras.groupBy("node").agg(*[F.sum(c).alias(f"more_{c}") for c in counts])
    out = spans.join(added, "node", "left").fillna(0, [f"more_{c}" for c in counts])
    if names and not extras.isEmpty():
        # What a flagged node's added intervals hold has one ancestor more: up at their first number, down after their last.
        ups = extras.join(marked, "node")
        deltas = ups.select(F.col("lo").alias("place"), *names).unionByName(ups.select((F.col("hi") + 1).alias("place"), *[(-F.col(c)).alias(c) for c in names]))
        steps = deltas.unionByName(spans.select(F.col("lo").alias("place"), *[zero.alias(c) for c in names])).groupBy("place").agg(*[F.sum(c).alias(c) for c in names])
        more = running_totals(steps, "place", {c: f"plus_{c}" for c in names}).select(F.col("place").alias("lo"), *[f"plus_{c}" for c in names])
        out = out.join(more, "lo")
    else:
        out = out.select("*", *[zero.alias(f"plus_{c}") for c in names])
    below = lambda k, own_: (F.col(k) + F.col(f"more_{k}") - own_).alias
    return out.select("node", below("k_all", F.lit(1))("n_descendants"), *[x for c in names for x in (below(f"k_{c}", F.col(c))(f"n_{c}_descendants"), (F.col(f"above_{c}") + F.col(f"plus_{c}")).alias(f"n_{c}_ancestors"))])
