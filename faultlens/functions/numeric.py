"""Columns that follow one rule on missing numbers: NULL, never NaN, infinity or zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Texts that a CSV's number column may hold for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def window_end(timestamp: Column, seconds: int) -> Column:
    """End of the right-open tumbling window of epoch seconds; a sample on a boundary is of the next window."""
    return ((F.floor(timestamp / F.lit(float(seconds))) + 1) * seconds).cast("long")


def divided(a: Column, b: Column) -> Column:
    """a / b where b > 0, else NULL."""
    return finite(F.when(b > 0, F.try_divide(a, b)))


def relative_gap(a: Column, b: Column) -> Column:
    return divided(F.abs(a - b), a)


def at_quantiles(c: Column, *q: float) -> Column:
    """Exact, linearly interpolated quantiles, as an array."""
    return F.percentile(c, F.array(*map(F.lit, q)))


def pearson(x: str, y: str, least: int) -> Column:
    """Aggregate: correlation of complete pairs, NULL for fewer than ``least`` or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    varied = (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.count(a) >= least) & varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def average_rank(value: Column, by: list) -> Column:
    """Rank of ``value`` within ``by``, ties sharing their mean rank."""
    from pyspark.sql import Window

    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)).cast("double") + (ties - 1) / F.lit(2.0)
