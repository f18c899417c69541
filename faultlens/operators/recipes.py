"""Declarative features: ratios, sums and gaps of windowed metrics, compiled to columns.

A recipe has a name, one or two inputs (metric, kind, units), an operation, a unit, a
target status and a scale. All cohorts (system, entity, dimensions) and recipes are
evaluated in one grouping; there is no loop over data.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import divided, finite, relative_gap
from ..schemas import SERIES
from .windowing import resample

COHORT = ["system_id", "entity_id", "dimensions"]
#: operation: (number of inputs, formula)
OPERATIONS = {
    "identity": (1, lambda a, b: a),
    "sum": (2, lambda a, b: a + b),
    "ratio": (2, divided),
    "fraction_of_sum": (2, lambda a, b: divided(a, a + b)),
    "relative_gap": (2, relative_gap),
}


def check(recipes: list[dict]) -> list[dict]:
    names = [r["name"] for r in recipes]
    if len(set(names)) != len(names):
        raise ValueError("recipe names must be unique")
    for r in recipes:
        if r["operation"] not in OPERATIONS:
            raise ValueError(f"{r['name']}: unknown operation {r['operation']}")
        if len(r["inputs"]) != OPERATIONS[r["operation"]][0]:
            raise ValueError(f"{r['name']}: {r['operation']} takes {OPERATIONS[r['operation']][0]} inputs")
        if not math.isfinite(float(r.get("scale", 1))):
            raise ValueError(f"{r['name']}: the scale must be finite")
    return recipes


def _matches(spec: dict, own: Column) -> Column:
    return (F.col("metric") == spec["metric"]) & own


def calculate(records: DataFrame, recipes: list[dict], window_seconds: int, min_coverage: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Feature rows (with unit and target_status), and the audit: one row for each cohort and recipe.

    The status is, input by input and in this order, missing_source, kind_or_unit_mismatch or
    ambiguous_series; else calculated, or no_valid_windows.
    """
    check(recipes)
    meta = records.groupBy(*SERIES).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("metric", "kind", "unit")])
    windows = resample(records, window_seconds, min_coverage).join(meta, SERIES)

    # Which inputs each cohort has, by series.
    series = records.groupBy(*COHORT, "series_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("metric", "kind", "unit")])
    specs = {}
    for r in recipes:
        for s in r["inputs"]:
            specs.setdefault((s["metric"], s["kind"], tuple(s["units"])), len(specs))
    flags = []
    for (metric, kind, units), i in specs.items():
        named = F.col("metric") == metric
        fits = named & (F.col("kind") == kind) & F.col("unit").isin(*units)
        flags += [F.count_if(named).alias(f"n{i}"), F.count_if(named & ~F.coalesce(fits, F.lit(False))).alias(f"w{i}")]
    have = series.groupBy(*COHORT).agg(*flags)

    def status(r: dict) -> Column:
        ladder = None
        for s in r["inputs"]:
            i = specs[(s["metric"], s["kind"], tuple(s["units"]))]
            for bad, word in ((F.col(f"n{i}") == 0, "missing_source"), (F.col(f"w{i}") > 0, "kind_or_unit_mismatch"), (F.col(f"n{i}") > 1, "ambiguous_series")):
                text = F.lit(f"{word}:{s['metric']}")
                ladder = F.when(bad, text) if ladder is None else ladder.when(bad, text)
        return ladder.otherwise("ok")

    every = F.explode(F.array(*[F.struct(F.lit(r["name"]).alias("recipe"), status(r).alias("status"), F.lit(j).alias("j")) for j, r in enumerate(recipes)]))
    plan = have.select(*COHORT, every.alias("r")).select(*COHORT, "r.recipe", "r.status", "r.j")

    # One value for each input, cohort and window; inputs that don't fit or are ambiguous never reach a valid recipe.
    value = lambda i, m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"v{i}")
    there = lambda i, m: F.count_if(F.col("metric") == m).alias(f"t{i}")
    cells = windows.groupBy(*COHORT, "window_end").agg(*[f(i, m) for (m, _, _), i in specs.items() for f in (value, there)])
    parts = []
    for j, r in enumerate(recipes):
        ids = [specs[(s["metric"], s["kind"], tuple(s["units"]))] for s in r["inputs"]]
        a, b = F.col(f"v{ids[0]}"), F.col(f"v{ids[-1]}")
        any_row = reduce(lambda x, y: x | y, [F.col(f"t{i}") > 0 for i in ids])
        result = finite(OPERATIONS[r["operation"]][1](a, b) * float(r.get("scale", 1)))
        cell = F.struct(F.lit(j).alias("j"), result.alias("value"), F.lit(r["name"]).alias("feature_name"), F.lit(r["unit"]).alias("unit"), F.lit(r["target_status"]).alias("target_status"))
        parts.append(F.when(any_row, cell))
    computed = cells.select(*COHORT, "window_end", F.explode(F.array_compact(F.array(*parts))).alias("c")).select(*COHORT, "window_end", "c.*")
    good = plan.where("status = 'ok'").select(*COHORT, "j")
    computed = computed.join(good, [*COHORT, "j"], "left_semi")
    identity = F.to_json(F.array(*COHORT, "feature_name"))
    features = computed.select(
        "system_id", "entity_id", F.left(F.sha2(identity, 256), F.lit(24)).alias("series_id"), "feature_name", "dimensions", "window_end", "value", "unit", "target_status"
    )
    counts = computed.groupBy(*COHORT, "j").agg(F.count("value").alias("valid_windows"), F.count_if(F.col("value").isNull()).alias("missing_windows"))
    audit = plan.join(counts, [*COHORT, "j"], "left").select(
        *COHORT, "recipe",
        F.when(F.col("status") != "ok", F.col("status")).when(F.coalesce("valid_windows", F.lit(0)) > 0, "calculated").otherwise("no_valid_windows").alias("status"),
        F.coalesce("valid_windows", F.lit(0)).alias("valid_windows"), F.coalesce("missing_windows", F.lit(0)).alias("missing_windows"),
    )
    return features, audit


def audit_after_trim(audit: DataFrame, features: DataFrame) -> DataFrame:
    """The audit with its windows counted again over the features that are kept."""
    kept = features.groupBy(*COHORT, F.col("feature_name").alias("recipe")).agg(F.count("value").alias("v"), F.count_if(F.col("value").isNull()).alias("m"))
    joined = audit.join(kept, [*COHORT, "recipe"], "left")
    was = F.col("status").isin("calculated", "no_valid_windows")
    n, m = F.coalesce("v", F.lit(0)), F.coalesce("m", F.lit(0))
    now = F.when(was & (n > 0), "calculated").when(was & (n + m == 0), "no_selected_windows").when(was, "no_valid_windows").otherwise(F.col("status"))
    return joined.select(*COHORT, "recipe", now.alias("status"), n.alias("valid_windows"), m.alias("missing_windows"))


#: The shipped recipes, which name the exporters' metrics.
#: Name, operation, inputs (metric, kind, unit), unit of the result, what it stands for in the labelled corpora, scale.
SHIPPED = [
    ("cpu_cores", "identity", [("container_cpu_usage_seconds_total", "counter", "seconds")], "cores", "stand_in_for_cpu", 1),
    ("memory_working_set_bytes", "identity", [("container_memory_working_set_bytes", "gauge", "bytes")], "bytes", "stand_in_for_mem", 1),
    ("memory_rss_bytes", "identity", [("container_memory_rss", "gauge", "bytes")], "bytes", "same_as_rss", 1),
    ("memory_limit_ratio", "ratio", [("container_memory_working_set_bytes", "gauge", "bytes"), ("container_spec_memory_limit_bytes", "gauge", "bytes")], "ratio", "own", 1),
    ("container_reads_bytes_per_second", "identity", [("container_fs_reads_bytes_total", "counter", "bytes")], "bytes/s", "same_as_rate", 1),
    ("container_writes_bytes_per_second", "identity", [("container_fs_writes_bytes_total", "counter", "bytes")], "bytes/s", "same_as_rate", 1),
    ("disk_io_bytes_per_second", "sum", [("container_fs_reads_bytes_total", "counter", "bytes"), ("container_fs_writes_bytes_total", "counter", "bytes")], "bytes/s", "stand_in_for_diskio", 1),
    ("request_rate", "identity", [("request_counter", "counter", "request")], "request/s", "stand_in_for_load", 1),
    ("response_rate", "identity", [("response_counter", "counter", "response")], "response/s", "own", 1),
    ("request_response_gap_ratio", "relative_gap", [("request_counter", "counter", "request"), ("response_counter", "counter", "response")], "ratio", "own", 1),
    ("processing_time_ms", "identity", [("process_time_ms", "gauge", "ms")], "ms", "stand_in_for_mean_latency", 1),
    ("timeout_ratio", "ratio", [("request_timeout_counter", "counter", "request"), ("request_counter", "counter", "request")], "ratio", "stand_in_for_some_errors", 1),
    ("node_memory_available_ratio", "ratio", [("node_memory_MemAvailable_bytes", "gauge", "bytes"), ("node_memory_MemTotal_bytes", "gauge", "bytes")], "ratio", "own", 1),
    ("node_filesystem_free_ratio", "ratio", [("node_filesystem_free_bytes", "gauge", "bytes"), ("node_filesystem_size_bytes", "gauge", "bytes")], "ratio", "own", 1),
    ("node_read_mean_io_ms", "ratio", [("node_disk_read_time_seconds_total", "counter", "seconds"), ("node_disk_reads_completed_total", "counter", "operation")], "ms/operation", "own", 1000),
    ("node_write_mean_io_ms", "ratio", [("node_disk_write_time_seconds_total", "counter", "seconds"), ("node_disk_writes_completed_total", "counter", "operation")], "ms/operation", "own", 1000),
    ("db_read_error_ratio", "fraction_of_sum", [("aerospike_namespace_client_read_error", "counter", "operation"), ("aerospike_namespace_client_read_success", "counter", "operation")], "ratio", "database_errors", 1),
    ("db_write_error_ratio", "fraction_of_sum", [("aerospike_namespace_client_write_error", "counter", "operation"), ("aerospike_namespace_client_write_success", "counter", "operation")], "ratio", "database_errors", 1),
    ("db_delete_error_ratio", "fraction_of_sum", [("aerospike_namespace_client_delete_error", "counter", "operation"), ("aerospike_namespace_client_delete_success", "counter", "operation")], "ratio", "database_errors", 1),
]


def shipped() -> list[dict]:
    return [
        {"name": name, "operation": operation, "unit": unit, "target_status": target, "scale": float(scale), "inputs": [{"metric": m, "kind": k, "units": [u]} for m, k, u in inputs]}
        for name, operation, inputs, unit, target, scale in SHIPPED
    ]
