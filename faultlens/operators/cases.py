"""Labelled fault-injection cases: wide frames, clocks, quarantine, leakage guard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, window_end

#: Epoch seconds beyond this are milliseconds or finer.
LATEST = 1e11


def merge_equal_clocks(df: DataFrame, clocks: list[str], out: str = "time", record: str | None = None) -> DataFrame:
    """One clock of several: each must agree with the time that the clocks before it give, and share a row with it.

    record: a column that numbers the rows, of which an error names the first five. NaN is a missing time.
    """
    raw = [F.col(c).cast("double") for c in clocks]
    ts = [F.when(~F.isnan(t), t) for t in raw]
    before = [F.coalesce(*ts[:k]) for k in range(1, len(ts))]
    either = lambda parts: reduce(lambda a, b: a | b, parts, F.lit(False))
    differ = either([F.coalesce(t != b, F.lit(False)) for t, b in zip(ts[1:], before, strict=True)])
    infinite = either([F.coalesce(F.abs(t) == float("inf"), F.lit(False)) for t in ts])
    shared = [F.count_if(t.isNotNull() & b.isNotNull()).alias(f"s{k}") for k, (t, b) in enumerate(zip(ts[1:], before, strict=True))]
    found = df.agg(F.count_if(differ).alias("conflicts"), F.count_if(infinite).alias("infinite"), *shared).first()
    if found["infinite"]:
        raise ValueError(f"{found['infinite']} rows with an infinite timestamp")
    if found["conflicts"]:
        rows = [r[0] for r in df.where(differ).select(record).orderBy(record).limit(5).collect()] if record else []
        raise ValueError(f"{found['conflicts']} rows whose clocks differ" + (f", first {rows}" if rows else ""))
    if alone := [clocks[k + 1] for k in range(len(shared)) if not found[f"s{k}"]]:
        raise ValueError(f"clocks never overlap: {alone[0]} with those before it")
    return df.withColumn(out, finite(F.coalesce(*ts))).drop(*[c for c in clocks if c != out])


def align_clock_blocks(df: DataFrame, blocks: list[tuple[str, list[str]]], record: str = "record", missing: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Joins blocks (clock, columns) by their own clocks: one row for each time of any block.

    The second result holds the values without a clock in their block, with their row, block
    and a reason; with ``missing`` "error" there may be none. A clock that is infinite, or
    repeats within a block, is an error, and so is a block without clocks.
    """
    parts, rejected = [], []
    for i, (clock, columns) in enumerate(blocks):
        t = F.col(clock).cast("double")
        own = df.select(record, F.when(~F.isnan(t), t).alias("time"), *columns)
        any_value = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
        unanchored = F.col("time").isNull() & any_value
        got = own.agg(F.count("time").alias("n"), F.count_distinct("time").alias("times"), F.count_if(F.abs("time") == float("inf")).alias("infinite"), F.count_if(unanchored).alias("lost")).first()
        if got["infinite"]:
            raise ValueError(f"infinite timestamps in clock block {i + 1}")
        if got["lost"] and missing == "error":
            raise ValueError(f"{got['lost']} rows with values but no own time in clock block {i + 1}; quarantine them")
        if got["times"] < got["n"] or not got["n"]:
            raise ValueError(f"no or duplicate timestamps in clock block {i + 1}")
        bad = own.where(unanchored)
        rejected.append(bad.select(F.col(record).alias("source_record_number"), F.lit(i + 1).alias("clock_occurrence"), F.lit("no own clock").alias("reason"), *columns))
        parts.append(own.where("time IS NOT NULL").drop(record))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rejected)
    return reduce(lambda a, b: a.join(b, "time", "full_outer"), parts), every


def quarantined(df: DataFrame, clock: str = "time") -> tuple[DataFrame, DataFrame]:
    """Rows with a finite clock, and the others, whole, with a reason."""
    t = finite(F.col(clock).try_cast("double"))
    return df.where(t.isNotNull()).withColumn(clock, t), df.where(t.isNull()).withColumn("reason", F.lit("missing time"))


def frame_quality(df: DataFrame, metrics: list[str], clock: str = "time") -> DataFrame:
    """One row of counters over a wide frame, in one pass."""
    raw = [F.col(c).try_cast("double") for c in metrics]
    total = lambda bad: reduce(lambda a, b: a + b, [F.count_if(bad(c)) for c in raw])
    return df.agg(
        F.count("*").alias("rows"), F.lit(len(metrics)).alias("fields"), F.min(clock).alias("start"), F.max(clock).alias("end"),
        (F.count(clock) - F.count_distinct(clock)).alias("duplicate_times"), total(lambda c: c.isNull() | F.isnan(c)).alias("missing_values"),
        total(lambda c: F.abs(c) == float("inf")).alias("infinite_values"),
    )


def check_frame(df: DataFrame, metrics: list[str], clock: str = "time") -> None:
    if not metrics:
        raise ValueError("no metric columns")
    q = frame_quality(df, metrics, clock).first()
    if q["duplicate_times"]:
        raise ValueError(f"{q['duplicate_times']} duplicate timestamps")
    if q["end"] is not None and q["end"] > LATEST:
        raise ValueError("timestamps must be seconds")


def long_case(wide: DataFrame, metrics: list[str], keys: list[str], clock: str = "time") -> DataFrame:
    """Wide case rows to (keys, time, metric, value, entity_id); the entity is what stands before the first underscore."""
    values = wide.select(*keys, clock, *[finite(F.col(c)).alias(c) for c in metrics])
    long = values.unpivot([*keys, clock], metrics, "metric", "value")
    return long.withColumn("entity_id", F.substring_index("metric", "_", 1))


def case_windows(long: DataFrame, keys: list[str], window_seconds: int, clock: str = "time") -> DataFrame:
    """Window means of a case's metrics."""
    at = window_end(F.col(clock), window_seconds).alias("window_end")
    return long.groupBy(*keys, "entity_id", "metric", at).agg(F.avg("value").alias("value"))


def without_leakage(windows: DataFrame, inject_time: Column, last_time: Column, window_seconds: int) -> DataFrame:
    """Drops the window that holds the injection and the unfinished last one; adds ``boundary``, the reference's end."""
    boundary = (F.floor(inject_time / float(window_seconds)) * window_seconds).cast("long")
    end = F.col("window_end")
    kept = windows.where(((end <= boundary) | (end > boundary + window_seconds)) & (end <= last_time))
    return kept.withColumn("boundary", boundary)


def missing_cases(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Cases of one side only, and repeated ones, with what is wrong."""
    a = expected.select(*keys).distinct().join(found, keys, "left_anti").withColumn("problem", F.lit("missing"))
    b = found.select(*keys).distinct().join(expected, keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    c = found.groupBy(*keys).count().where("count > 1").select(*keys).withColumn("problem", F.lit("duplicate"))
    return a.unionByName(b).unionByName(c)
