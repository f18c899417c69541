"""Windowed features of metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, relative_gap, window_end
from ..schemas import ENTITY, FEATURE_KEY, SERIES


def counter_rates(records: DataFrame) -> DataFrame:
    """Adds feature_name and observed: a counter's increase a second (missing at a reset or a long gap), else the value."""
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    v = finite(F.col("value"))
    dv, dt = v - F.lag(v).over(w), F.col("timestamp") - F.lag("timestamp").over(w)
    counter = F.col("kind") == "counter"
    usable = (dt > 0) & (dt <= 2 * F.col("cadence_seconds")) & (dv >= 0)
    rate = F.when(usable, F.try_divide(dv, dt))
    name = F.when(counter, F.concat("metric", F.lit("_rate"))).otherwise(F.col("metric"))
    return records.withColumn("feature_name", name).withColumn("observed", F.when(counter, rate).otherwise(v))


def window_means(records: DataFrame, window_seconds: int, min_coverage: float = 0.8) -> DataFrame:
    """Mean of ``observed`` by series and window; missing where too few samples of the cadence are there."""
    at = window_end(F.col("timestamp"), window_seconds)
    grouped = records.withColumn("window_end", at).groupBy(*FEATURE_KEY, "window_end").agg(
        F.avg("observed").alias("mean"), F.count("observed").alias("n"), F.first("cadence_seconds", ignorenulls=True).alias("cadence")
    )
    expected = F.greatest(F.lit(1.0), F.lit(float(window_seconds)) / F.col("cadence"))
    return grouped.select(*FEATURE_KEY, "window_end", F.when(F.col("n") / expected >= min_coverage, F.col("mean")).alias("value"))


def resample(records: DataFrame, window_seconds: int, min_coverage: float = 0.8) -> DataFrame:
    """Canonical metric records to canonical feature rows."""
    if not records.groupBy(*SERIES).agg(F.count_distinct("kind").alias("k")).where("k > 1").isEmpty():
        raise ValueError("kind changes within a series")
    return window_means(counter_rates(records), window_seconds, min_coverage)


def request_response(features: DataFrame, rules: list[dict]) -> DataFrame:
    """Relative gap of two features of one entity, dimensions and window, for each rule (name, request, response)."""
    keys = ["system_id", "entity_id", "dimensions", "window_end"]
    out = None
    for rule in rules:
        a, b = F.col("feature_name") == rule["request"], F.col("feature_name") == rule["response"]
        both = features.where(a | b).groupBy(*keys).agg(
            F.count_if(a).alias("na"), F.count_if(b).alias("nb"), F.max(F.when(a, F.col("value"))).alias("a"), F.max(F.when(b, F.col("value"))).alias("b")
        )
        if not both.where("na > 1 or nb > 1").isEmpty():
            raise ValueError(f"{rule['name']}: more than one series for an entity and window")
        rows = both.where("na = 1 and nb = 1").select(
            "system_id", "entity_id", F.lit(rule["name"]).alias("series_id"), F.lit(rule["name"]).alias("feature_name"), "dimensions", "window_end",
            relative_gap(F.col("a"), F.col("b")).alias("value"),
        )
        out = rows if out is None else out.unionByName(rows)
    return features if out is None else features.unionByName(out, allowMissingColumns=True)


def trimmed(features: DataFrame, start: float | None, end: float | None, window_seconds: int) -> DataFrame:
    """Windows that lie wholly within [start, end]; an end that is None is open."""
    if start is not None:
        features = features.where(F.col("window_end") - window_seconds >= start)
    return features if end is None else features.where(F.col("window_end") <= end)


def dense_grid(features: DataFrame, window_seconds: int, max_windows: int = 500_000, within: list[str] = ENTITY) -> DataFrame:
    """Every feature of an entity (or cohort, ``within``) at every window between its first and last; absent values are NULL."""
    bounds = features.groupBy(*within).agg(F.min("window_end").alias("lo"), F.max("window_end").alias("hi"))
    if not bounds.where((F.col("hi") - F.col("lo")) / window_seconds > max_windows).isEmpty():
        raise ValueError("time span beyond the window budget; divide the input")
    grid = features.select(*FEATURE_KEY).distinct().join(bounds, within)
    grid = grid.select(*FEATURE_KEY, F.explode(F.sequence("lo", "hi", F.lit(window_seconds).cast("long"))).alias("window_end"))
    return grid.join(features.select(*FEATURE_KEY, "window_end", "value"), [*FEATURE_KEY, "window_end"], "left")


def ambiguous(features: DataFrame) -> DataFrame:
    """Feature identities with more than one row in a window."""
    return features.groupBy(*FEATURE_KEY, "window_end").count().where("count > 1")
