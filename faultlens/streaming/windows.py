"""Window means and log counts over streams: the batch formulas under a watermark.

The reference flows are bounded; this is an extension for unbounded input. A window is
emitted once, when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..schemas import FEATURE_KEY


def _windowed(rows: DataFrame, window_seconds: int, delay: str) -> DataFrame:
    at = F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))
    return rows.withColumn("event_time", at).withWatermark("event_time", delay).withColumn("w", F.window("event_time", f"{window_seconds} seconds"))


def gauge_means(records: DataFrame, window_seconds: int, min_coverage: float = 0.8, delay: str = "10 minutes") -> DataFrame:
    """Canonical gauge or rate records (a stream) to feature rows; counters need the order of their samples and stay a batch matter."""
    rows = _windowed(records.withColumn("feature_name", F.col("metric")), window_seconds, delay)
    found = rows.groupBy("w", *FEATURE_KEY).agg(F.avg(finite(F.col("value"))).alias("mean"), F.count(finite(F.col("value"))).alias("n"), F.max("cadence_seconds").alias("cadence"))
    expected = F.greatest(F.lit(1.0), F.lit(float(window_seconds)) / F.col("cadence"))
    return found.select(*FEATURE_KEY, F.unix_seconds("w.end").alias("window_end"), F.when(F.col("n") / expected >= min_coverage, F.col("mean")).alias("value"))


def log_counts(records: DataFrame, window_seconds: int, error_pattern: str, delay: str = "10 minutes") -> DataFrame:
    """log_count and log_error_count of each system, entity and window."""
    hit = F.coalesce(F.col("text").rlike("(?i)" + error_pattern), F.lit(False))
    found = _windowed(records, window_seconds, delay).groupBy("w", "system_id", "entity_id").agg(F.count("*").alias("log_count"), F.count_if(hit).alias("log_error_count"))
    return found.select("system_id", "entity_id", F.unix_seconds("w.end").alias("window_end"), "log_count", "log_error_count")
