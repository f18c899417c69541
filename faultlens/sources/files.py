"""Metric and log files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparse import epoch_seconds
from ..operators.validate import within_budget
from ..schemas import METRIC, METRIC_REQUIRED
from . import records

UNQUOTED = "\u0001"
#: Bytes up to which a table is dealt anew; a larger one has work enough in its own splits.
SMALL = 1 << 30


def spread(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` dealt over all cores, before work that keeps a core busy for each row, if its files have fewer splits than there are cores and at most ``limit`` bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= limit and df.rdd.getNumPartitions() < cores else df


def header_of(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names of a CSV, repeated ones as they are."""
    rows = spark.read.options(header=False, sep=delimiter, encoding=encoding, multiLine=True, escape='"').csv(path).limit(1).collect()
    if not rows:
        raise ValueError(f"{path} is empty")
    return [(v or "").lstrip("﻿").strip() for v in rows[0]]


def metric_csv(spark: SparkSession, path: str, max_rows: int = 500_000) -> DataFrame:
    """Canonical metric records; numbers are cast strictly, so that a bad one raises."""
    names = header_of(spark, path)
    if missing := [c for c in METRIC_REQUIRED if c not in names]:
        raise ValueError(f"{path}: missing columns {missing}")
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = within_budget(spark.read.options(header=True, enforceSchema=True, multiLine=True, escape='"').schema(schema).csv(path), max_rows, path)
    types = dict(x.split() for x in METRIC.split(", "))
    return raw.select(*[F.when(F.trim(F.col(n)) != "", F.col(n)).cast(types[n]).alias(n) if types.get(n) == "double" else F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])


def log_csv(spark: SparkSession, root: str | Path, sources: list[dict], max_rows: int = 500_000) -> DataFrame:
    """Canonical log records of several files; every field is text and blanks stay blank."""
    if not sources:
        raise ValueError("no log sources")
    names = [Path(s["file"]).name for s in sources]
    if len(set(names)) != len(names):
        raise ValueError("log files need different names")
    root = Path(root).resolve()
    out = None
    for source in sources:
        path = (root / source["file"]).resolve()
        if not path.is_relative_to(root):
            raise ValueError(f"{source['file']} lies outside {root}")
        encoding = source.get("encoding", "utf-8-sig")
        encoding = "UTF-8" if encoding.lower() in ("utf-8-sig", "utf-8") else encoding
        sep = source.get("delimiter", ",")
        header = header_of(spark, str(path), sep, encoding)
        options = {"escape": '"', "emptyValue": "", "nullValue": UNQUOTED, "sep": sep}
        positional = [f"c{i}" for i in range(len(header))]
        # Records of several lines, of any number of splits; the first one is the header.
        found = records.csv_records(spark, str(path), encoding).where("number > 1")
        raw = found.select((F.col("number") - 1).alias("source_record"), F.from_csv("value", ", ".join(f"{c} string" for c in positional), options).alias("r")).select("source_record", "r.*")
        at = dict(zip(header, positional, strict=True))
        entity = source.get("entity_column")
        for needed in (source["timestamp_column"], source["text_column"], *([entity] if entity else [])):
            if needed not in at:
                raise ValueError(f"{source['file']}: no column {needed}")
        zone = source.get("timezone", "Asia/Ho_Chi_Minh")
        stamp = F.col(at[source["timestamp_column"]])
        rows = raw.select(
            epoch_seconds(stamp, source.get("time_unit", "iso"), zone).alias("timestamp"), F.coalesce(F.col(at[source["text_column"]]), F.lit("")).alias("text"),
            F.lit(source["system_id"]).alias("system_id"), (F.coalesce(F.col(at[entity]), F.lit("")) if entity else F.lit("system")).alias("entity_id"),
            F.lit(path.name).alias("source_file"), "source_record", F.lit(zone).alias("source_timezone"),
            F.lit(source.get("cdr_service_id", "")).alias("expected_cdr_service_id"),
        )
        out = rows if out is None else out.unionByName(rows)
    out = within_budget(out, max_rows, "logs")
    if not out.where("timestamp IS NULL").isEmpty():
        raise ValueError("a log row has a timestamp of another form")
    return out
