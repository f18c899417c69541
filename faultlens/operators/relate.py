"""Rules between features, and correlations with lags, for all cohorts at once.

A cohort is a (system_id, entity_id, dimensions). Input is a dense grid: each field of a cohort has a
row for every window, NULL where nothing was observed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import average_rank, divided, finite, pearson, relative_gap
from ..schemas import COHORT

DEFAULT_QUANTILE = {"upper": 0.99, "lower": 0.01}
TWO_SIDED = {"relative_gap": relative_gap, "ratio": divided, "difference": lambda a, b: a - b}


def check_rule(rule: dict) -> dict:
    """The rule with its defaults; raises if it has no meaning."""
    r = {"operation": "value", "direction": "upper", "threshold_mode": "reference_quantile", "consecutive_windows": 3, "right": ""} | rule
    if r["operation"] != "value" and r["operation"] not in TWO_SIDED:
        raise ValueError(f"{r['name']}: unknown operation {r['operation']}")
    if r["direction"] not in DEFAULT_QUANTILE:
        raise ValueError(f"{r['name']}: direction must be upper or lower")
    if r["threshold_mode"] == "fixed":
        if not math.isfinite(float(r["threshold"])):
            raise ValueError(f"{r['name']}: the threshold must be finite")
    elif r["threshold_mode"] == "reference_quantile":
        r["quantile"] = float(r.get("quantile", DEFAULT_QUANTILE[r["direction"]]))
        if not 0 < r["quantile"] < 1:
            raise ValueError(f"{r['name']}: the quantile must lie between 0 and 1")
    else:
        raise ValueError(f"{r['name']}: unknown threshold_mode")
    if int(r["consecutive_windows"]) < 1:
        raise ValueError(f"{r['name']}: consecutive_windows must be positive")
    return r


def check_report(config: dict, window_seconds: int) -> list[dict]:
    fields, rules = config["fields"], [check_rule(r) for r in config.get("rules", [])]
    limits = [
        (2 <= len(fields) <= 20 and len(set(fields)) == len(fields), "2 to 20 different fields"),
        (0 <= config.get("max_lag_windows", 3) <= 20, "max_lag_windows 0 to 20"),
        (config.get("min_pairs", 20) >= 3, "min_pairs 3 or more"),
        (config.get("min_reference_points", 20) >= 3, "min_reference_points 3 or more"),
        (window_seconds > 0, "a positive window"),
        (len({r["name"] for r in rules}) == len(rules), "different rule names"),
    ]
    for r in rules:
        two = r["operation"] != "value"
        limits.append((r["left"] in fields and (not two or r["right"] in fields), f"only fields of the report in the rule {r['name']}"))
    for good, what in limits:
        if not good:
            raise ValueError(f"relationships take {what}")
    return rules


def streak(df: DataFrame, flag: str, by: list[str], order: str, out: str) -> DataFrame:
    """Running count of consecutive true flags, 0 at any other row."""
    w = Window.partitionBy(*by).orderBy(order)
    on = F.coalesce(F.col(flag), F.lit(False))
    islands = df.withColumn("__g", F.sum(F.when(on, 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*by, "__g").orderBy(order)
    return islands.withColumn(out, F.sum(F.when(on, 1).otherwise(0)).over(inside)).drop("__g")


def evaluate_rule(wide: DataFrame, rule: dict, reference_end, minimum: int) -> DataFrame:
    """One decision for each cohort and window. wide: a column for each field the rule names."""
    r = check_rule(rule)
    left = F.col(r["left"]) if r["left"] in wide.columns else F.lit(None).cast("double")
    right = F.col(r["right"]) if r["right"] in wide.columns else F.lit(None).cast("double")
    value = finite(left if r["operation"] == "value" else TWO_SIDED[r["operation"]](left, right))
    if "min_left" in r:
        value = F.when(left >= float(r["min_left"]), value)
    rows = wide.select(*COHORT, "window_end", value.alias("value")).withColumn("current", F.col("window_end") > reference_end)
    ref = F.when(~F.col("current"), F.col("value"))
    threshold = F.lit(float(r["threshold"])) if r["threshold_mode"] == "fixed" else F.when(F.count(ref) >= minimum, F.percentile(ref, F.lit(r["quantile"])))
    fit = rows.groupBy(*COHORT).agg(F.count(ref).alias("reference_count"), threshold.alias("threshold"))
    rows = rows.join(fit, COHORT)
    valid = F.col("value").isNotNull() & F.col("threshold").isNotNull()
    over = F.col("value") > F.col("threshold") if r["direction"] == "upper" else F.col("value") < F.col("threshold")
    rows = rows.withColumn("valid", valid).withColumn("exceeds", F.coalesce(over & F.col("current"), F.lit(False)))
    rows = streak(rows, "exceeds", COHORT, "window_end", "consecutive_exceedances")
    status = (
        F.when(~F.col("current"), "reference").when(~F.col("valid"), "unknown").when(F.col("consecutive_exceedances") >= int(r["consecutive_windows"]), "anomaly_candidate")
        .when(F.col("exceeds"), "watch").otherwise("within_threshold")
    )
    said = {k: F.lit(r[v]) for k, v in (("rule", "name"), ("left_field", "left"), ("right_field", "right"), ("operation", "operation"), ("direction", "direction"), ("threshold_mode", "threshold_mode"))}
    at = F.timestamp_micros((F.col("window_end") * 1_000_000).cast("long"))
    return rows.withColumns(said).withColumn("timestamp_utc", at).withColumn("status", status).select(
        *COHORT, "window_end", "timestamp_utc", "rule", "left_field", "right_field", "operation", "direction", "value", "threshold", "threshold_mode", "reference_count", "status", "consecutive_exceedances"
    )


def wide_fields(grid: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each cohort and window, a column for each field (NULL where the cohort lacks it)."""
    return grid.where(F.col("feature_name").isin(fields)).groupBy(*COHORT, "window_end").pivot("feature_name", fields).agg(F.max("value"))


def correlation_pairs(grid: DataFrame, fields: list[str], reference_end, min_pairs: int, max_lag: int, window_seconds: int) -> DataFrame:
    """Pearson and Spearman of every field pair, lag and period. Lag k pairs X(t) with Y(t + k windows) of one period."""
    order = {f: i for i, f in enumerate(fields)}
    rows = grid.where(F.col("feature_name").isin(fields)).select(
        *COHORT, "window_end", F.when(F.col("window_end") <= reference_end, "reference").otherwise("current").alias("period"), F.col("feature_name").alias("left"), F.col("value").alias("x")
    )
    right = rows.select(*COHORT, "period", F.col("window_end").alias("at"), F.col("left").alias("right"), F.col("x").alias("y"))
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    pairs = [(a, b) for a in fields for b in fields if order[a] < order[b]]
    partner = F.explode(F.try_element_at(F.create_map(*[x for a in fields for x in (F.lit(a), F.array(*[F.lit(b) for b in fields if order[a] < order[b]]).cast("array<string>"))]), F.col("left")))
    moved = rows.where("x IS NOT NULL").withColumn("right", partner).withColumn("lag_windows", lags)
    moved = moved.withColumn("at", F.col("window_end") + F.col("lag_windows") * F.lit(window_seconds))
    met = moved.join(right.where("y IS NOT NULL"), [*COHORT, "period", "right", "at"])
    key = [*COHORT, "period", "left", "right", "lag_windows"]
    met = met.withColumn("rx", average_rank(F.col("x"), key)).withColumn("ry", average_rank(F.col("y"), key))
    found = met.groupBy(*key).agg(F.count("*").alias("n_pairs"), pearson("x", "y", min_pairs).alias("pearson"), pearson("rx", "ry", min_pairs).alias("spearman"))
    every = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs]))
    frame = grid.select(*COHORT).distinct().select(*COHORT, every.alias("p")).select(*COHORT, "p.left", "p.right").withColumn("lag_windows", lags)
    frame = frame.withColumn("period", F.explode(F.array(F.lit("reference"), F.lit("current"))))
    return frame.join(found, key, "left").select(*COHORT, "period", "left", "right", "lag_windows", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "pearson", "spearman")


def correlation_change(correlations: DataFrame) -> DataFrame:
    """Current minus reference at lag 0."""
    of = lambda period, c: F.max(F.when(F.col("period") == period, F.col(c)))
    both = correlations.where("lag_windows = 0").groupBy(*COHORT, "left", "right")
    cells = [of(p, c).alias(f"{p}_{c}") for p in ("reference", "current") for c in ("n_pairs", "pearson", "spearman")]
    out = both.agg(*cells)
    return out.withColumns({f"{c}_change": F.col(f"current_{c}") - F.col(f"reference_{c}") for c in ("pearson", "spearman")})


def cohort_status(features: DataFrame, fields: list[str]) -> DataFrame:
    """Per cohort: ambiguous if a field has more than one row in a window, else ok; with the fields it has."""
    rows = features.where(F.col("feature_name").isin(fields))
    cells = rows.groupBy(*COHORT, "feature_name", "window_end").agg(F.count("*").alias("n"))
    found = cells.groupBy(*COHORT).agg(F.max("n").alias("n"), F.count_distinct("feature_name").alias("fields"))
    return found.select(*COHORT, "fields", F.when(F.col("n") > 1, "ambiguous_series").otherwise("ok").alias("status"))
