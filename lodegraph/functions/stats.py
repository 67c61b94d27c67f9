"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def auc_from_ascending(rank_sum: Column, n_pos: Column, n_neg: Column) -> Column:
    """Mann-Whitney AUC from the positives' ascending average ranks; null without both classes."""
    return ratio(rank_sum - n_pos * (n_pos + 1) / F.lit(2.0), n_pos * n_neg)


def auc_from_descending(rank_sum: Column, n_pos: Column, n_neg: Column) -> Column:
    """The same from descending competition ranks, which differs on ties."""
    return 1 - ratio(rank_sum - n_pos * (n_pos + 1) / F.lit(2.0), n_pos * n_neg)


def hanley_mcneil_se(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    q1, q2 = ratio(auc, 2 - auc), ratio(2 * auc * auc, 1 + auc)
    v = ratio(auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc), n_pos * n_neg)
    return F.when(v > 0, F.sqrt(v))


def poisson_upper(k: Column, mean: Column) -> Column:
    """P(X >= k) for X ~ Poisson(mean), as one less the sum of the terms below k."""
    start = F.struct(F.exp(-mean).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc, i):
        return F.struct((acc["term"] * mean / (i + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    below = F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))), start, step, lambda acc: acc["sum"])
    return F.when(k <= 0, 1.0).when(mean <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - below)))


def hypergeometric_z(shared: Column, n: Column, degree: Column, module: Column) -> Column:
    """(shared - expected) / sd for ``degree`` draws from ``n`` of which ``module`` count."""
    expected = ratio(degree * module, n)
    variance = expected * ratio(n - module, n) * ratio(n - degree, n - 1)
    return F.when(variance > 0, (shared - expected) / F.sqrt(variance))


def inverse_power(x: Column, w: float = 0.4) -> Column:
    """x ** -w; 0 for 0."""
    return F.when(x > 0, F.pow(x.cast("double"), F.lit(-w))).otherwise(F.lit(0.0))


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up, the same whatever the sign's convention: floor(x * 10**d + 0.5) / 10**d."""
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))
