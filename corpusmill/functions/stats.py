"""Statistical expressions: paired effect size, Wilcoxon's signed-rank test, Cohen's kappa, confidence width."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Terms of the error function's series, and the argument from which it counts as 1.
ERF_TERMS, ERF_LIMIT = 100, 4.0


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by the Taylor series (error under 1e-11 up to ERF_LIMIT, beyond it 0)."""
    start = F.struct(x.alias("term"), x.alias("total"))
    step = lambda acc, n: F.struct((-acc["term"] * x * x / n).alias("term"), (acc["total"] - acc["term"] * x * x / n / (2 * n + 1)).alias("total"))
    series = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(ERF_TERMS)), lambda n: n.cast("double")), start, step, lambda acc: acc["total"])
    return F.when(x > ERF_LIMIT, F.lit(0.0)).otherwise(1 - 1.1283791670955126 * series)


def cohens_d(difference: Column) -> Column:
    """Aggregate: mean of paired differences over their sample deviation; 0.0 where that is 0 or undefined."""
    sd = F.stddev_samp(difference)
    return F.coalesce(F.when(sd != 0, F.avg(difference) / sd), F.lit(0.0))


def ci95(sd: Column, n: int = 120) -> Column:
    """Half width of a 95 % interval; a missing deviation counts as 0."""
    return 1.96 * F.coalesce(sd, F.lit(0.0)) / F.sqrt(F.lit(float(n)))
