"""Data of charts: frames whose number of rows depends on the chart and not on the samples.

A chart shows the first entities and features by name. Timelines keep of each bucket of time
its first, last, least and largest value; scatter plots are counts of two-dimensional bins; heat
maps are correlations in both directions with the numbers of their features; threshold charts
keep of each bucket the worst decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..schemas import COHORT, ENTITY

LABEL = 40
#: From the mildest to the worst.
STATUSES = ["reference", "within_threshold", "unknown", "watch", "anomaly_candidate"]


def label(number: Column, feature: Column) -> Column:
    """What a chart calls a feature: its number and what stands before the first bar, shortened."""
    return F.concat(number.cast("string"), F.lit(": "), F.substring(F.substring_index(feature, "|", 1), 1, LABEL))


def chosen(rows: DataFrame, feature: str, entities: int | None, features: int, by: list[str] = ENTITY) -> DataFrame:
    """by, feature, number, label: of the first ``entities`` groups (all, if None) their first ``features``, by name."""
    names = rows.select(*by, feature).distinct()
    if entities is not None:
        names = names.join(names.select(*by).distinct().orderBy(*by).limit(entities), by, "left_semi")
    each = names.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(feature)))
    return each.where(F.col("number") <= features).withColumn("label", label(F.col("number"), F.col(feature)))


def timeline(rows: DataFrame, by: list[str], buckets: int = 200, at: str = "window_end") -> DataFrame:
    """Of each group and bucket of its time: the first, last, least and largest value, when the first and last were, and how many there are."""
    v = finite(F.col("value"))
    rows = rows.select(*by, F.col(at).cast("long").alias("at"), v.alias("v")).where("v IS NOT NULL")
    ends = rows.groupBy(*by).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    place = F.least(F.lit(buckets - 1).cast("long"), F.expr(f"((at - lo) * {buckets}) div greatest(hi - lo, 1L)")).cast("int")
    # Of samples at one time the least value counts as the first, and as the last.
    first, last = F.min_by("v", F.struct("at", "v")), F.max_by("v", F.struct("at", -F.col("v")))
    return rows.join(ends, by).groupBy(*by, place.alias("bucket")).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), first.alias("first"), last.alias("last"), F.min("v").alias("least"), F.max("v").alias("largest"), F.count("*").alias("n")
    )


def scatter(pairs: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    """Counts of x and y (columns of ``pairs``) in equal bins between their least and largest values, and where the bins begin."""
    rows = pairs.select(*by, finite(F.col("x")).alias("x"), finite(F.col("y")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ends = rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    width = lambda c: (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / bins
    place = lambda c: F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"{c}_lo"), width(c))), F.lit(0)).cast("int")).alias(f"{c}_bin")
    start = lambda c: F.first(F.col(f"{c}_lo") + F.col(f"{c}_bin") * width(c)).alias(f"{c}_start")
    met = rows.join(ends, by).select("*", place("x"), place("y"))
    return met.groupBy(*by, "x_bin", "y_bin").agg(F.count("*").alias("n"), start("x"), start("y"))


def paired(rows: DataFrame, by: list[str], fields: list[str], pairs: int = 6, at: str = "window_end") -> DataFrame:
    """by, left, right, x, y: what the first ``pairs`` pairs of the fields have at the same time."""
    which = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]][:pairs]
    own = rows.where(F.col("feature_name").isin(fields))
    wide = own.groupBy(*by, at).pivot("feature_name", fields).agg(F.max("value"))
    cell = lambda a, b: F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y"))
    return wide.select(*by, F.explode(F.array(*[cell(a, b) for a, b in which])).alias("p")).select(*by, "p.*")


def heat_map(correlations: DataFrame, features: DataFrame, by: list[str], feature: str = "feature_name") -> DataFrame:
    """Both directions of each pair of the chosen() features, by their numbers; the diagonal is left out."""
    swapped = {"left": "right", "right": "left"}
    turned = correlations.unionByName(correlations.select(*[F.col(c).alias(swapped.get(c, c)) for c in correlations.columns]))
    side = lambda c: features.select(*by, F.col(feature).alias(c), F.col("number").alias(f"{c}_number"))
    return turned.join(side("left"), [*by, "left"]).join(side("right"), [*by, "right"])


def lag_curves(correlations: DataFrame, fields: list[str], pairs: int = 6) -> DataFrame:
    """Correlations by lag of the first ``pairs`` pairs of the fields."""
    which = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]][:pairs]
    wanted = F.struct("left", "right").isin([F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in which]) if which else F.lit(False)
    return correlations.where(wanted).select(*COHORT, "left", "right", "period", "lag_windows", "n_pairs", "pearson")


def thresholds(decisions: DataFrame, buckets: int = 200) -> DataFrame:
    """Of each cohort, rule and bucket of its time: least and largest value, the limit, the worst status and when it first was."""
    by = [*COHORT, "rule"]
    ends = decisions.groupBy(*by).agg(F.min("window_end").alias("lo"), F.max("window_end").alias("hi"))
    place = F.least(F.lit(buckets - 1).cast("long"), F.expr(f"((window_end - lo) * {buckets}) div greatest(hi - lo, 1L)")).cast("int")
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    worst = F.max(F.struct(rank.alias("rank"), (-F.col("window_end")).alias("back")))
    out = decisions.join(ends, by).groupBy(*by, place.alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"), F.first("threshold").alias("threshold"), worst.alias("w"))
    return out.select(*by, "bucket", "n", "least", "largest", "threshold", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("w.rank").cast("int")).alias("status"), (-F.col("w.back")).alias("status_at"))
