"""One scan for the metric files of all cases.

The lines of all files are read together, each with its file and record number. Headers are a
table by file, which tells where the clocks and metrics of a file stand; values go to the long
form by position, so that files of any layout share one plan. All checks of all files come
from one aggregation; a bad case is reported and the others go on. The number of Spark jobs
doesn't depend on the number of cases.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MISSING_TEXTS, finite
from ..operators.cases import LATEST
from . import records
from .corpus import Case, read_options

KEYS = ["dataset", "case"]


@dataclass
class Scan:
    """long: dataset, case, time, metric, value (of the good cases). rejected: rows or blocks without a clock. report: a row for each case. headers: dataset, case, metrics."""

    long: DataFrame
    rejected: DataFrame
    report: DataFrame
    headers: DataFrame
    kept: list[DataFrame]

    def release(self) -> None:
        """Gives up what is kept in memory, a row for each case; what is read from the scan later is computed anew."""
        for df in self.kept:
            df.unpersist()


def _path(c: Column) -> Column:
    return F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def case_table(spark: SparkSession, found: list[Case], config: dict) -> DataFrame:
    """A row for each case, with its options; as many rows as the inventory has."""
    rows = []
    for c in found:
        own = read_options(config, c.case)
        policy, missing = own.get("duplicate_time_policy", "strict"), own["missing_time_policy"]
        if policy not in ("strict", "align_blocks") or missing not in ("error", "quarantine"):
            raise ValueError(f"{c.case}: not a policy: {policy}, {missing}")
        rows.append((quote(str(Path(c.metric_file).resolve())), c.dataset, c.case, float(c.inject_time), policy == "align_blocks", missing == "quarantine", own.get("expected_time_columns")))
    return spark.createDataFrame(rows, "__path string, dataset string, `case` string, inject_time double, aligned boolean, quarantine boolean, expected array<int>")


def number(c: Column) -> Column:
    """A cell as struct<v, bad>: NULL for missing texts, and whether the text is no number."""
    t = F.trim(c)
    v = t.try_cast("double")
    missing = t.isin(*MISSING_TEXTS)
    # Java reads 1d and 1f as numbers, a CSV doesn't.
    bad = ~missing & (v.isNull() | t.rlike("[0-9.][dDfF]$"))
    return F.struct(F.when(~missing & ~bad & ~F.isnan(v), v).alias("v"), bad.alias("bad"))


def _layout(header: Column) -> dict[str, Column]:
    at = F.sequence(F.lit(0), F.size(header) - 1)
    name = lambda i: F.get(header, i)
    clocks = F.filter(at, lambda i: name(i) == "time")
    fields = F.filter(at, lambda i: (F.trim(name(i)) != "") & ~F.startswith(name(i), F.lit("Unnamed:")) & (name(i) != "time"))
    return {"clocks": clocks, "fields": fields}


def _errors() -> Column:
    """The first thing that is wrong with a case, or NULL."""
    at = F.concat(F.lit("["), F.array_join(F.transform("clocks", lambda i: i + 1), ", "), F.lit("]"))
    inside = lambda k: F.filter("fields", lambda i: (i > F.get("clocks", k)) & (i < F.coalesce(F.get("clocks", k + 1), F.size("header"))))
    empty_block = F.exists(F.sequence(F.lit(0), F.size("clocks") - 1), lambda k: F.size(inside(k)) == 0)
    several = F.size("clocks") > 1
    overlaps = F.expr("shiftleft(1L, size(clocks))") - F.lit(2)
    count = lambda c, text: (F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}")))
    checks = [
        (F.col("rows").isNull(), F.lit("no rows")),
        (F.size("clocks") == 0, F.lit("no time column")),
        (F.size(F.array_distinct("names")) < F.size("names"), F.lit("duplicate metric names")),
        (F.size("names") == 0, F.lit("no metric columns")),
        (F.col("expected").isNotNull() & ~F.transform("clocks", lambda i: i + 1).eqNullSafe(F.col("expected")), F.concat(F.lit("time columns at "), at)),
        (F.col("aligned") & ((F.get("clocks", F.lit(0)) != 0) | empty_block), F.lit("clock blocks begin in column 1, each with a metric behind its time")),
        (F.col("rows") > F.col("max_rows"), F.concat(F.lit("more than "), F.col("max_rows").cast("string"), F.lit(" rows"))),
        count("bad", "values that are no numbers"),
        count("infinite_times", "infinite timestamps"),
        (~F.col("aligned") & (F.col("conflicts") > 0), F.concat(F.col("conflicts").cast("string"), F.lit(" rows whose clocks differ"))),
        (~F.col("aligned") & several & (F.col("overlap") != overlaps), F.lit("clocks never overlap")),
        (F.col("aligned") & (F.col("blocks") < F.size("clocks")), F.lit("no or duplicate timestamps in a clock block")),
        (F.col("repeated") > 0, F.concat(F.col("repeated").cast("string"), F.lit(" duplicate timestamps"))),
        (~F.col("quarantine") & (F.col("lost") > 0), F.concat(F.col("lost").cast("string"), F.lit(" rows or blocks without a time"))),
        (F.col("end") > LATEST, F.lit("timestamps must be seconds")),
        (F.col("times") == 0, F.lit("no rows with a time")),
        (~((F.col("start") < F.col("inject_time")) & (F.col("inject_time") < F.col("end"))), F.lit("the injection lies outside the data")),
    ]
    out = F.lit(None).cast("string")
    for wrong, text in reversed(checks):
        out = F.when(wrong, text).otherwise(out)
    return out


def scan(spark: SparkSession, found: list[Case], config: dict | None = None, max_rows: int = 500_000) -> Scan:
    """The CSV files of the cases; the order of nothing is kept."""
    table = case_table(spark, found, config or {})
    lines = records.csv_lines(spark, sorted({c.metric_file for c in found})).withColumn("__path", _path(F.col("__file"))).drop("__file")
    header = records.cells(F.regexp_replace("value", "^\\x{feff}", ""))
    heads = lines.where("number = 1").select("__path", header.alias("header"))
    layout = _layout(F.col("header"))
    # A row for each case: positions of clocks and metrics, and the names. Kept, as three plans read it.
    cases = table.join(heads, "__path", "left").select("*", *[v.alias(k) for k, v in layout.items()]).withColumn("names", F.transform("fields", lambda i: F.get("header", i))).persist()
    few = F.broadcast if cases.agg(F.sum(F.octet_length(F.array_join("header", ",")) * 2 + 200)).first()[0] <= records.BROADCAST else (lambda df: df)
    body = lines.where("number > 1").join(few(cases.select("__path", *KEYS, "aligned", "clocks", "fields", "header")), "__path")
    body = body.select(*KEYS, "aligned", "clocks", "fields", F.size("header").alias("width"), (F.col("number") - 1).alias("record"), "value", F.transform(records.cells(F.col("value")), number).alias("x"))
    body = body.withColumn("v", F.transform("x", lambda x: x["v"])).withColumn("ts", F.transform("clocks", lambda i: F.get("v", i)))
    body = body.withColumn("bad", F.size(F.filter(F.concat("clocks", "fields"), lambda i: F.coalesce(F.get("x", i)["bad"], F.lit(False))))).drop("x")
    # Each clock is held against the first time that the clocks before it give.
    start = F.struct(F.lit(None).cast("double").alias("t"), F.lit(1).cast("long").alias("bit"), F.lit(0).cast("long").alias("overlap"), F.lit(False).alias("conflict"))
    step = lambda a, t: F.struct(
        F.coalesce(a["t"], t).alias("t"), (a["bit"] * 2).alias("bit"),
        F.when(a["t"].isNotNull() & t.isNotNull(), a["overlap"].bitwiseOR(a["bit"])).otherwise(a["overlap"]).alias("overlap"), (a["conflict"] | F.coalesce(a["t"] != t, F.lit(False))).alias("conflict"),
    )
    body = body.withColumn("clock", F.aggregate("ts", start, step))
    inside = lambda c, k: F.filter("fields", lambda i: (i > c) & (i < F.coalesce(F.get("clocks", k + 1), F.col("width"))))
    block = lambda n, t, at: F.struct(n.alias("n"), t.alias("time"), at.alias("at"))
    blocks = F.when(F.col("aligned"), F.transform("clocks", lambda c, k: block(k + 1, F.get("v", c), inside(c, k)))).otherwise(F.array(block(F.lit(1), F.col("clock.t"), F.col("fields"))))
    parts = body.select("*", F.explode(blocks).alias("b")).select(*KEYS, "aligned", "record", "value", "v", "bad", "ts", "clock", "b.*")
    filled = F.size(F.filter("at", lambda i: F.get("v", i).isNotNull()))
    infinite = F.size(F.filter("at", lambda i: F.coalesce(F.abs(F.get("v", i)) == float("inf"), F.lit(False))))
    lost = F.col("time").isNull() & (~F.col("aligned") | (filled > 0))
    first = F.col("n") == 1
    own = lambda c: F.when(first, c)
    each = parts.groupBy(*KEYS, "n", "time").agg(
        F.count("*").alias("rows"), F.sum(filled).alias("filled"), F.sum(infinite).alias("infinite"), F.count_if(lost).alias("lost"), F.sum(own(F.col("bad"))).alias("bad"),
        F.count_if(own(F.col("clock.conflict"))).alias("conflicts"), F.bit_or(own(F.col("clock.overlap"))).alias("overlap"),
        F.count_if(own(F.exists("ts", lambda t: F.coalesce(F.abs(t) == float("inf"), F.lit(False))))).alias("infinite_times"),
        F.count_if(own(F.get("ts", F.lit(0)).isNull() & F.col("clock.t").isNotNull())).alias("recovered"), F.count(own(F.lit(1))).alias("own"),
    )
    there = F.col("time").isNotNull()
    stats = each.groupBy(*KEYS).agg(
        F.sum("own").alias("rows"), F.count_distinct("time").alias("times"), F.sum(F.when(there, F.col("rows") - 1).otherwise(0)).alias("repeated"), F.min("time").alias("start"), F.max("time").alias("end"),
        F.count_distinct(F.when(there, F.col("n"))).alias("blocks"), F.sum(F.when(there, F.col("filled")).otherwise(0)).alias("filled"), F.sum(F.when(there, F.col("infinite")).otherwise(0)).alias("infinite"),
        *[F.sum(c).alias(c) for c in ("lost", "bad", "conflicts", "infinite_times", "recovered")], F.bit_or("overlap").alias("overlap"),
    )
    judged = cases.join(stats, KEYS, "left").withColumn("max_rows", F.lit(max_rows)).withColumn("error", _errors())
    fields = F.size("names")
    report = judged.select(
        *KEYS, "error", F.col("times").alias("rows"), fields.alias("fields"), "start", "end", F.col("repeated").alias("duplicate_times"), (F.col("times") * fields - F.col("filled")).alias("missing_values"), F.col("infinite").alias("infinite_values"),
        F.size("clocks").alias("clock_columns"), F.when(F.col("aligned"), 0).otherwise(F.col("recovered")).alias("recovered_clocks"), F.col("lost").alias("rejected_rows"),
        F.try_divide(F.col("lost"), F.col("lost") + F.col("times")).alias("rejected_fraction"), "aligned", "inject_time",
    )
    report = report.persist()
    good = parts.join(few(report.where("error IS NULL").select(*KEYS)), KEYS, "left_semi")
    named = good.join(few(cases.select(*KEYS, "header")), KEYS)
    pair = F.transform("at", lambda i: F.struct(F.get("header", i).alias("metric"), finite(F.get("v", i)).alias("value")))
    long = named.where(there).select(*KEYS, "time", F.explode(pair).alias("p")).select(*KEYS, "time", "p.metric", "p.value")
    whole = F.to_json(F.map_from_entries(F.filter(pair, lambda p: p["value"].isNotNull())))
    reason = F.when(F.col("aligned"), "no own clock").otherwise("missing time")
    rejected = named.where(lost).select(*KEYS, F.col("record").alias("source_record_number"), F.col("n").alias("clock_occurrence"), reason.alias("reason"), whole.alias("values"), F.col("value").alias("line"))
    return Scan(long, rejected, report, cases.select(*KEYS, "names"), [cases, report])
