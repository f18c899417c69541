"""Scores of current windows against a reference period, for all entities in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import at_quantiles
from ..schemas import ENTITY, FEATURE_KEY

PLAIN_METHODS = ("mad", "nsigma", "iqr")


def in_reference(reference_end) -> Column:
    return F.col("window_end") <= reference_end


def eligibility(grid: DataFrame, reference_end, min_points: int, min_coverage: float) -> DataFrame:
    """One row for each feature: what the reference holds, and whether that is enough."""
    ref = in_reference(reference_end)
    n, seen = F.count_if(ref), F.count(F.when(ref, F.col("value")))
    found = grid.groupBy(*FEATURE_KEY).agg(
        seen.alias("reference_count"), n.alias("reference_windows"), F.count_if(~ref).alias("current_windows"), F.count(F.when(~ref, F.col("value"))).alias("current_count"),
        F.percentile(F.when(ref, F.col("value")), F.lit(0.5)).alias("reference_median"), F.percentile(F.when(ref, F.col("value")), F.lit(0.95)).alias("reference_p95"),
    )
    enough = (F.col("reference_count") >= min_points) & (F.col("reference_count") >= min_coverage * F.col("reference_windows"))
    return found.withColumn("eligible", enough)


def coverage(eligible: DataFrame) -> DataFrame:
    """Per entity: features, eligible features, current windows."""
    return eligible.groupBy(*ENTITY).agg(F.count("*").alias("features"), F.count_if("eligible").alias("eligible"), F.max("current_windows").alias("current_windows"))


def imputed(grid: DataFrame, eligible: DataFrame) -> DataFrame:
    """The grid of eligible features; x is the value, or the reference median where it is missing."""
    use = eligible.where("eligible").select(*FEATURE_KEY, "reference_median")
    return grid.join(use, FEATURE_KEY).withColumn("x", F.coalesce("value", "reference_median"))


def fitted(filled: DataFrame, reference_end) -> DataFrame:
    """Centre and spreads of each feature, from reference windows only."""
    x, med = F.col("x"), F.col("reference_median")
    return filled.where(in_reference(reference_end)).groupBy(*FEATURE_KEY, "reference_median").agg(
        F.percentile(F.abs(x - med), F.lit(0.5)).alias("mad"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), at_quantiles(x, 0.25, 0.75).alias("q")
    ).withColumn("least", F.greatest(F.abs("reference_median") * 1e-6, F.lit(1e-9)))


def window_scores(filled: DataFrame, model: DataFrame, reference_end, methods=PLAIN_METHODS) -> DataFrame:
    """Observed current windows with a score for each method, in long form."""
    v, least = F.col("value"), F.col("least")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    score = {
        "mad": F.abs(v - F.col("reference_median")) / F.greatest(1.4826 * F.col("mad"), least),
        "nsigma": F.abs(v - F.col("mean")) / F.greatest(F.col("std"), least),
        "iqr": F.greatest(q1 - v, v - q3, F.lit(0.0)) / F.greatest(q3 - q1, least),
    }
    current = filled.where(~in_reference(reference_end) & v.isNotNull()).drop("reference_median").join(model, FEATURE_KEY)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), score[m].alias("score")) for m in methods if m in score]))
    return current.select(*FEATURE_KEY, "window_end", "value", each.alias("s")).select(*FEATURE_KEY, "window_end", "value", "s.method", "s.score")


def peaks(scores: DataFrame) -> DataFrame:
    """Highest score of a feature and method, with the first window that has it."""
    best = F.max_by(F.struct("window_end", "value"), F.struct("score", -F.col("window_end")))
    return scores.groupBy(*FEATURE_KEY, "method").agg(F.max("score").alias("score"), best.alias("p")).select(
        *FEATURE_KEY, "method", "score", F.col("p.window_end").alias("peak_window_end"), F.col("p.value").alias("peak_value")
    )


def evidence(grid: DataFrame, reference_end, min_points: int = 20, min_coverage: float = 0.8, methods=PLAIN_METHODS, more=None) -> DataFrame:
    """Evidence rows of all entities: score, peak, and what the reference looked like.

    more: evidence of further methods, as peaks() gives it.
    """
    eligible = eligibility(grid, reference_end, min_points, min_coverage)
    filled = imputed(grid, eligible)
    found = peaks(window_scores(filled, fitted(filled, reference_end), reference_end, methods))
    if more is not None:
        found = found.unionByName(more(filled))
    rows = found.join(eligible.select(*FEATURE_KEY, "reference_median", "reference_p95", "reference_count", "current_count"), FEATURE_KEY)
    return rows.withColumn("feature", F.concat_ws("|", "feature_name", "series_id", "dimensions")).withColumn("label_status", F.lit("unlabelled"))
