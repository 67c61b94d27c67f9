"""Ranks and top-k within groups. Five kinds of rank coexist; each has its own function.

A window holds one group in one task. Groups here are ranked lists (a disease's pool); what ranks a whole table
works on counts per distinct value instead, range-partitioned and added up over partitions (``running_total``), so no task
gathers all rows or all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def _by(group) -> list:
    return [group] if isinstance(group, str) else list(group)


def rank_first(df: DataFrame, group, order: str, tie: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """1, 2, 3, ...: equal values by ``tie``."""
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*_by(group)).orderBy(key, tie)).cast("long"))


def rank_competition(df: DataFrame, group, order: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """1, 2, 2, 4."""
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    return df.withColumn(out, F.rank().over(Window.partitionBy(*_by(group)).orderBy(key)).cast("long"))


def average_rank(group, value: str) -> Column:
    """Ascending average rank, 1, 2.5, 2.5, 4 (W4); null for null."""
    w = Window.partitionBy(*_by(group)).orderBy(F.col(value).asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*_by(group), value))
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / F.lit(2.0))


def rank_average(df: DataFrame, group, value: str, out: str = "rank") -> DataFrame:
    return df.withColumn(out, average_rank(group, value))


def rank_pct(df: DataFrame, group, value: str, out: str = "pct") -> DataFrame:
    """Average rank over the number of values."""
    return df.withColumn(out, average_rank(group, value) / F.count(value).over(Window.partitionBy(*_by(group))))


def strict_percentile(df: DataFrame, group, value: str, out: str = "percentile", higher_is_stronger: bool = True) -> DataFrame:
    """Percent of the group's values that are strictly weaker, to one decimal; nulls have none and don't count."""
    key = F.col(value).asc_nulls_last() if higher_is_stronger else F.col(value).desc_nulls_last()
    w = Window.partitionBy(*_by(group)).orderBy(key)
    share = 100.0 * (F.rank().over(w) - 1) / F.count(value).over(Window.partitionBy(*_by(group)))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.round(share, 1)))


def group_size(df: DataFrame, group, out: str = "pool") -> DataFrame:
    """Rows of the group: an unordered window, so never a running count."""
    return df.withColumn(out, F.count("*").over(Window.partitionBy(*_by(group))))


def top_k(df: DataFrame, group, order: str, tie: str, k: int, descending: bool = True) -> DataFrame:
    """The first k of each group (W9). The filter on row_number lets Spark cut groups before the shuffle."""
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*_by(group)).orderBy(key, tie))).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def either_top(df: DataFrame, group, order: str, tie: str, subset: Column, k: int) -> DataFrame:
    """Rows in the top k of all, or of those that ``subset`` holds for, with both ranks."""
    ranked = rank_first(df, group, order, tie, "rank_all")
    w = Window.partitionBy(*_by(group), F.col("__in")).orderBy(F.col(order).desc_nulls_last(), tie)
    both = ranked.withColumn("__in", subset).withColumn("rank_subset", F.when(F.col("__in"), F.row_number().over(w)).cast("long")).drop("__in")
    return both.where((F.col("rank_all") <= k) | (F.col("rank_subset") <= k))


def running_totals(df: DataFrame, order: str, measures: dict[str, str], descending: bool = False) -> DataFrame:
    """df with the sum of each measure over all rows up to each in ``order`` (whose values are distinct), under the name given for it.

    Rows are range-partitioned and written, added up within partitions, and what the partitions before hold (a table of one row
    a partition) is added.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    placed = written(df.repartitionByRange(by).withColumn("__p", F.spark_partition_id()))
    inner = Window.partitionBy("__p").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__p").agg(*[F.sum(m).alias(f"__s_{m}") for m in measures]).select("__p", *[F.coalesce(F.sum(f"__s_{m}").over(before), F.lit(0)).alias(f"__before_{m}") for m in measures])
    within = placed.withColumns({f"__within_{m}": F.sum(m).over(inner) for m in measures}).join(F.broadcast(sums), "__p")
    return within.withColumns({out: F.col(f"__within_{m}") + F.col(f"__before_{m}") for m, out in measures.items()}).drop("__p", *[f"__{x}_{m}" for m in measures for x in ("within", "before")])


def running_total(df: DataFrame, order: str, measure: str, out: str, descending: bool = False) -> DataFrame:
    """The same for one measure."""
    return running_totals(df, order, {measure: out}, descending)


def value_counts_upto(df: DataFrame, value: str) -> DataFrame:
    """(value, n, upto): rows of each distinct value and of all values up to it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return running_total(counts, "value", "n", "upto")


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row, ``e``: the interpolated quantiles of the values that aren't null, picked by place out of counts of distinct values."""
    counts = value_counts_upto(df, value)
    total = F.broadcast(counts.agg(F.sum("n").alias("rows")))
    first = F.col("upto") - F.col("n")
    picked = []
    for i, p in enumerate(shares):
        at = F.lit(p) * (F.col("rows") - 1)
        holds = lambda k: F.max(F.when((first <= k) & (k < F.col("upto")), F.col("value").cast("double")))
        picked += [holds(F.floor(at)).alias(f"lo{i}"), holds(F.ceil(at)).alias(f"hi{i}")]
    edges = counts.crossJoin(total).groupBy("rows").agg(*picked)
    at = lambda p: F.lit(p) * (F.col("rows") - 1)
    between = lambda i, p: F.when(F.floor(at(p)) == F.ceil(at(p)), F.col(f"lo{i}")).otherwise((F.ceil(at(p)) - at(p)) * F.col(f"lo{i}") + (at(p) - F.floor(at(p))) * F.col(f"hi{i}"))
    return edges.select(F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("e"))


def percentile_bins(df: DataFrame, value: str, k: int, out: str = "bin") -> DataFrame:
    """Quantile bins of the raw value, equal edges merged, right-closed with the least value in the first."""
    edges = quantiles(df, value, [i / k for i in range(k + 1)]).select(F.array_sort(F.array_distinct("e")).alias("__edges"))
    inner = F.slice("__edges", F.lit(2), F.greatest(F.size("__edges") - 2, F.lit(0)))
    number = F.size(F.filter(inner, lambda e: e < F.col(value))).cast("long") + 1
    return df.join(F.broadcast(edges), how="left").withColumn(out, F.when(F.col(value).isNotNull(), number)).drop("__edges")


def rank_bins(df: DataFrame, group, value: str, tie: str, k: int, out: str = "bin") -> DataFrame:
    """k bins of equal size by first-rank (W12): cut points are quantiles of the ranks, so bins of n = 6, k = 4 have 2, 1, 1, 2."""
    ranked = rank_first(df, group, value, tie, "__r", descending=False)
    n = F.count("*").over(Window.partitionBy(*_by(group)))
    bins = F.lit(1).cast("long")
    for i in range(1, k):
        bins = bins + F.when(F.col("__r") > 1 + (n - 1) * F.lit(i / k), 1).otherwise(0)
    return ranked.withColumn(out, bins).drop("__r")


def domain_order(value: str, domain: list[str]) -> Column:
    """Place of the value in a listed order; what isn't listed comes last."""
    at = F.array_position(F.array(*[F.lit(x) for x in domain]), F.col(value))
    return F.when(at > 0, at).otherwise(len(domain) + 1).cast("long")
