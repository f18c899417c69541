"""Exploratory profiles of features in long form: a row for each observation, feature and window.

Input columns: the key columns given, ``window_end`` and ``value`` (NULL where missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import at_quantiles, average_rank, finite, pearson
from .quantiles import beside, quantiles

QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
LEAST_PAIRS = 5


def distribution(rows: DataFrame, by: list[str], reference=None, large: bool = False) -> DataFrame:
    """Summary of each feature; fences are fitted on ``reference`` rows (all, if none is given) and applied to all.

    large: groups of raw samples or records, of any size, whose quantiles need more passes and no buffer. Without it a
    group is what a feature has in its windows, of which one aggregation holds the distinct values.
    """
    raw = F.col("value").cast("double")
    rows = rows.withColumn("v", finite(raw)).withColumn("inf", F.abs(raw) == float("inf"))
    base = F.col("v") if reference is None else F.when(reference, F.col("v"))
    v, n = F.col("v"), F.count("v")
    if large:
        found = quantiles(rows, by, {"q1": (base, 0.25), "q3": (base, 0.75), **{k: (v, q) for k, q in QUANTILES.items()}})
        later = [F.first(k).alias(k) for k in QUANTILES]
    else:
        found = rows.groupBy(*by).agg(at_quantiles(base, 0.25, 0.75).alias("f")).withColumn("q1", F.col("f")[0]).withColumn("q3", F.col("f")[1])
        later = [at_quantiles(v, *QUANTILES.values()).alias("q")]
    spread = F.col("q3") - F.col("q1")
    found = found.withColumn("iqr_lower", F.col("q1") - 1.5 * spread).withColumn("iqr_upper", F.col("q3") + 1.5 * spread)
    out = beside(rows, found, by, ["iqr_lower", "iqr_upper", *(QUANTILES if large else [])]).groupBy(*by).agg(
        n.alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v.isNull().cast("double")).alias("missing_ratio"), F.count_distinct(v).alias("unique_count"), F.count_if(v.isNull()).alias("missing_count"),
        F.try_divide(F.count_if(v == 0).cast("double"), n).alias("zero_ratio"), (F.min(v) == F.max(v)).alias("same"), (n == 0).alias("all_missing"),
        F.count_if("inf").alias("infinite_count"), F.first("iqr_lower").alias("iqr_lower"), F.first("iqr_upper").alias("iqr_upper"),
        F.count_if((v < F.col("iqr_lower")) | (v > F.col("iqr_upper"))).alias("iqr_outlier_count"), *later,
    )
    out = out.withColumn("constant", F.coalesce("same", F.lit(False))).drop("same")
    return out if large else out.withColumns({k: F.col("q")[i] for i, k in enumerate(QUANTILES)}).drop("q")


def contrast(rows: DataFrame, by: list[str], reference) -> DataFrame:
    """Reference against current: mean, difference, count, median, p95, missing ratio."""
    v = finite(F.col("value"))
    cells = []
    for name, mask in (("reference", reference), ("current", ~reference)):
        own = F.when(mask, v)
        cells += [
            F.avg(own).alias(f"{name}_mean"), F.count(own).alias(f"{name}_count"), F.percentile(own, F.lit(0.5)).alias(f"{name}_median"), F.percentile(own, F.lit(0.95)).alias(f"{name}_p95"),
            F.try_divide(F.count_if(mask & v.isNull()).cast("double"), F.count_if(mask)).alias(f"{name}_missing_ratio"),
        ]
    return rows.groupBy(*by).agg(*cells).withColumn("mean_difference", F.col("current_mean") - F.col("reference_mean"))


def first_features(rows: DataFrame, feature: str, limit: int) -> list[str]:
    """The first ``limit`` features by name: a bound on the pairs that follow."""
    return [r[0] for r in rows.select(feature).distinct().orderBy(feature).limit(limit).collect()]


def _pairs(rows: DataFrame, by: list[str], feature: str, at: str) -> DataFrame:
    v = rows.select(*by, at, F.col(feature).alias("left"), finite(F.col("value")).alias("x")).where("x IS NOT NULL")
    return v.join(v.select(*by, at, F.col("left").alias("right"), F.col("x").alias("y")), [*by, at])


def pair_counts(rows: DataFrame, by: list[str], feature: str = "feature_name", at: str = "window_end") -> DataFrame:
    """How often two features are observed together (each with itself, too)."""
    return _pairs(rows, by, feature, at).groupBy(*by, "left", "right").agg(F.count("*").alias("n"))


def correlation_matrix(rows: DataFrame, by: list[str], feature: str = "feature_name", at: str = "window_end", least: int = LEAST_PAIRS) -> DataFrame:
    """Pearson and Spearman of each pair left < right over their complete rows; ranks are taken within the pair."""
    key = [*by, "left", "right"]
    met = _pairs(rows, by, feature, at).where("left < right")
    met = met.withColumn("rx", average_rank(F.col("x"), key)).withColumn("ry", average_rank(F.col("y"), key))
    return met.groupBy(*key).agg(F.count("*").alias("n"), pearson("x", "y", least).alias("pearson"), pearson("rx", "ry", least).alias("spearman"))


def histogram(rows: DataFrame, by: list[str], bins: int = 30) -> DataFrame:
    """Plot data: counts of equal bins between the least and the largest value."""
    v = finite(F.col("value"))
    ends = rows.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(v - F.col("lo"), width)), F.lit(0))).cast("int")
    return rows.where(v.isNotNull()).join(ends, by).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.first(F.col("lo") + at * width).alias("bin_start"))


def text_lengths(records: DataFrame) -> DataFrame:
    """Log texts as rows for distribution()."""
    return records.select("system_id", F.lit("text_length").alias("feature_name"), F.col("timestamp").alias("window_end"), F.char_length("text").cast("double").alias("value"))
