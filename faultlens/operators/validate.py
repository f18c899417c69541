"""Checks of canonical metric records: identity, metadata, clocks, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..schemas import METRIC_REQUIRED, SERIES, require

METADATA = ["entity_id", "metric", "kind", "unit", "cadence_seconds", "dimensions"]
KINDS = ["counter", "gauge", "rate"]
SAMPLE = ["system_id", "series_id", "timestamp"]


def blank(name: str):
    return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")


def within_budget(df: DataFrame, max_rows: int, what: str = "input") -> DataFrame:
    """``df`` if it has no more than ``max_rows`` rows; never a part of it."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; divide it")
    return df


def metadata_conflicts(records: DataFrame) -> DataFrame:
    """Series whose metadata vary; a missing value counts as one."""
    kinds = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"{c}_values")
    found = records.groupBy(*SERIES).agg(*map(kinds, METADATA))
    return found.where(" or ".join(f"{c}_values > 1" for c in METADATA))


def duplicates(records: DataFrame) -> DataFrame:
    """Samples given more than once: rows, and whether their values differ (missing is a value)."""
    v = finite(F.col("value"))
    differ = (F.min(v) != F.max(v)) | ((F.count(v) > 0) & (F.count(v) < F.count("*")))
    return records.groupBy(*SAMPLE).agg(F.count("*").alias("rows"), F.coalesce(differ, F.lit(False)).alias("conflict")).where("rows > 1")


def sample_quality(records: DataFrame) -> DataFrame:
    """Per series: samples, missing and non-finite values, counter resets, long gaps, duplicates."""
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    raw = F.col("value").cast("double")
    one = records.withColumn("bad", raw.isNull() | finite(raw).isNull()).withColumn("v", finite(raw)).dropDuplicates(SAMPLE)
    steps = one.withColumn("dv", F.col("v") - F.lag("v").over(w)).withColumn("dt", F.col("timestamp") - F.lag("timestamp").over(w))
    reset = (F.col("kind") == "counter") & (F.col("dv") < 0)
    return steps.groupBy(*SERIES).agg(
        F.count("*").alias("samples"),
        F.count_if("bad").alias("nonfinite"),
        F.count_if(reset).alias("resets"),
        F.count_if(F.col("dt") > 2 * F.col("cadence_seconds")).alias("long_gaps"),
    )


def validate(records: DataFrame) -> tuple[DataFrame, dict]:
    """Clean records (one row a sample, missing values NULL) and a quality summary; raises on a broken contract."""
    require(records, METRIC_REQUIRED)
    r = records.withColumn("timestamp", F.col("timestamp").cast("double")).withColumn("value", F.col("value").cast("double"))
    r = r.withColumn("cadence_seconds", F.col("cadence_seconds").cast("double"))
    bad_time = finite(F.col("timestamp")).isNull() | (F.coalesce(finite(F.col("cadence_seconds")), F.lit(0.0)) <= 0)
    identity = reduce(lambda a, b: a | b, [blank(c) for c in ("system_id", "entity_id", "series_id", "metric", "dimensions")])
    rows = r.agg(
        F.count("*").alias("rows"), F.count_if(identity).alias("identity"), F.count_if(bad_time).alias("time"),
        F.count_if(~F.coalesce(F.col("kind"), F.lit("")).isin(KINDS)).alias("kind"), F.count_if(finite(F.col("value")).isNull()).alias("nonfinite"),
    )
    twice = duplicates(r).agg(F.sum(F.col("rows") - 1).alias("extra"), F.count_if("conflict").alias("conflicts"))
    series = sample_quality(r).agg(F.sum("resets").alias("resets"), F.sum("long_gaps").alias("gaps"), F.count("*").alias("series"))
    # One action for all checks: each gives a row of counters.
    counted = [metadata_conflicts(r).agg(F.count("*").alias("changing")), rows, twice, series]
    named = [d.select(F.explode(F.create_map(*[x for c in d.columns for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0)).cast("long"))])).alias("what", "n")) for d in counted]
    found = {x["what"]: x["n"] for x in reduce(DataFrame.union, named).collect()}
    if not found["rows"]:
        raise ValueError("no metric rows")
    for what, why in (("identity", "blank identity"), ("time", "bad timestamp or cadence"), ("kind", f"kind must be one of {KINDS}")):
        if found[what]:
            raise ValueError(f"{why} in {found[what]} rows")
    if found["changing"]:
        raise ValueError("metadata change within a series")
    if found["conflicts"]:
        raise ValueError(f"{found['conflicts']} samples have differing values")
    clean = r.withColumn("value", finite(F.col("value"))).dropDuplicates(SAMPLE)
    return clean, {
        "rows": found["rows"], "series": found["series"], "exact_duplicates": found["extra"], "nonfinite": found["nonfinite"],
        "counter_resets": found["resets"], "long_gaps": found["gaps"],
    }
