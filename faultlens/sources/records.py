"""Numbered records of text files that Spark reads in splits.

A record's number is its place in its file, whatever the splits: rows are counted for each
split, the counts of the splits before it are added up, and the place within the split comes from
the rows' order there. Records of several lines (a quoted field may hold line breaks) are told
by quotes: a line within an open quote belongs to the record before it, and whether a quote is
open at a split's first line follows from the number of quotes in the splits before. So one
long file is read by as many tasks as it has splits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of counted splits up to which the table of them is broadcast.
BROADCAST = 8 << 20
PLACE = ["__file", "__block", "__part"]


def placed(df: DataFrame) -> DataFrame:
    """Rows of a file source with their file, split and order; for numbered(), which counts them all: filter before."""
    meta = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    return df.select(*df.columns, *meta, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id"))


def numbered(rows: DataFrame, name: str, extra: dict[str, Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``rows`` of placed() with their number in the file, from 1; extra: sums over all rows of the splits before, by name."""
    extra = extra or {}
    splits = rows.groupBy(*PLACE).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{k}") for k, c in extra.items()])
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    splits = splits.select(*PLACE, "__first", sums("__n").alias("__before"), *[sums(f"__s_{k}").alias(k) for k in extra])
    # The splits are few (one for each task of the scan); both sides of the join read the same splits, or the join says so.
    met = rows.join(F.broadcast(splits) if _few(rows) else splits, PLACE, "left")
    number = F.when(F.col("__first").isNull(), F.raise_error(F.lit("a split was read in another cut than counted")).cast("long")).otherwise(F.col("__id") - F.col("__first") + F.col("__before") + 1)
    return met.withColumn(name, number).drop(*{"__first", "__before", "__block", "__part", "__id"} - set(keep or []))


def _few(rows: DataFrame) -> bool:
    return rows.rdd.getNumPartitions() * 256 <= BROADCAST


def csv_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """__file, value, number: the lines of CSV files without line breaks in fields; empty lines don't count."""
    return numbered(placed(spark.read.text(paths).where("value <> ''")), "number")


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """value, number: the records of a CSV whose quoted fields may hold line breaks; empty lines between records don't count."""
    lines = placed(spark.read.option("encoding", encoding).option("lineSep", "\n").text(path))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = numbered(lines.withColumn("__q", quotes), "number", {"__quotes": F.col("__q")}, keep=["__block"])
    split = Window.partitionBy("__file", "__block").orderBy("number")
    opened = (F.col("__quotes") + F.coalesce(F.sum("__q").over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 1
    begins = ~opened & (F.trim(F.replace("value", F.lit("\r"), F.lit(""))) != "")
    # Lines up to the first beginning of a split go on with the last record of the splits before.
    lines = lines.withColumn("opened", opened).where("opened OR trim(replace(value, '\r', '')) <> ''").withColumn("begins", begins.cast("long"))
    lines = lines.withColumn("within", F.sum("begins").over(split))
    splits = lines.groupBy("__file", "__block").agg(F.sum("begins").alias("n"))
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__file", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    each = lines.join(splits, ["__file", "__block"]).select((F.col("before") + F.col("within")).alias("record"), F.struct("number", "value").alias("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"]), "\n")
    return each.groupBy("record").agg(F.regexp_replace(whole, "\r$", "").alias("value")).withColumnRenamed("record", "number")


def cells(line: Column, delimiter: str = ",") -> Column:
    """The fields of a record without line breaks outside of quotes; quoted ones without their quotes."""
    mark = re.escape(delimiter)
    plain, apart = F.split(line, mark, -1), F.split(line, f'{mark}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    bare = lambda c: F.when(F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(F.contains(line, F.lit('"')), F.transform(apart, bare)).otherwise(plain)
