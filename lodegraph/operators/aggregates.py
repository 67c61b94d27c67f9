"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_total
from .store import written


def joined_set(column: str, sep: str = "+") -> Column:
    """The distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def composition(df: DataFrame, by: list[str], keep: Column | None = None) -> DataFrame:
    """Rows per combination."""
    return (df if keep is None else df.where(keep)).groupBy(*by).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """(bin, n) of n equal bins, the ends clamped, empty bins included (A10)."""
    step = (high - low) / n
    b = F.least(F.greatest(F.floor((F.col(value) - low) / step), F.lit(0)), F.lit(n - 1))
    counts = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab_share(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Per row value, the share of each listed column value."""
    counts = df.groupBy(row).pivot(column, values).count()
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values), F.lit(0))
    return counts.select(row, *[(F.coalesce(F.col(f"`{v}`"), F.lit(0)) / total).alias(f"share_{v}") for v in values])


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) (A13). The total is a window over the few counts, not over rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__t")))).select(column, "n", (F.col("n") / F.col("__t")).alias("share"))


def concentration(df: DataFrame, value: str, shares: tuple[float, ...] = (0.01, 0.1)) -> DataFrame:
    """The share of the total that the highest 1 % and 10 % of rows hold (A14), from counts per distinct value."""
    counts = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = written(counts)
    ranked = running_total(counts.where("v IS NOT NULL"), "v", "n", "upto", descending=True).withColumn("before", F.col("upto") - F.col("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("rows"), F.sum(F.col("v") * F.col("n")).alias("mass")))
    both = ranked.crossJoin(total)

    def held(p):
        cut = F.ceil(F.col("rows") * F.lit(p))
        return (F.sum(F.col("v") * F.greatest(F.lit(0), F.least(F.col("n"), cut - F.col("before")))) / F.max("mass")).alias(f"top_{round(100 * p)}pct")

    return both.agg(*[held(p) for p in shares])


def null_rates(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Share of nulls by class."""
    return df.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in columns])


def varying_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of keys with several values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).agg(F.count("*").alias("n_keys"), F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("share_varying"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r, slope and its t."""
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"))
    return fit.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def eligibility(total: DataFrame, eligible: DataFrame) -> DataFrame:
    """Two rows: eligible or not, and how many."""
    counts = total.agg(F.count("*").alias("t")).crossJoin(eligible.agg(F.count("*").alias("e")))
    return counts.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("is_eligible"), (F.col("t") - F.col("e")).alias("n")), F.struct(F.lit(1).cast("long").alias("is_eligible"), F.col("e").alias("n")))).alias("x")).select("x.*")


def pair_products(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Per key: distinct a, distinct b and the pairs they make, without making them."""
    return left.groupBy(key).agg(F.countDistinct(a).alias("n_a")).join(right.groupBy(key).agg(F.countDistinct(b).alias("n_b")), key).withColumn("n_pairs", F.col("n_a") * F.col("n_b"))


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in ``order``."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def drop_ambiguous(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands once."""
    once = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n = 1").select(key)
    return df.join(once, key, "left_semi")
