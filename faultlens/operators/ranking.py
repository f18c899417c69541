"""Rankings of features and entities, and what they are worth against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_ranking(evidence: DataFrame, within: list[str] = ["system_id", "method"]) -> DataFrame:  # noqa: B006
    order = Window.partitionBy(*within).orderBy(F.desc_nulls_last("score"), "entity_id", "feature")
    return evidence.withColumn("feature_rank", F.row_number().over(order))


def entity_ranking(evidence: DataFrame, within: list[str] = ["system_id", "method"]) -> DataFrame:  # noqa: B006
    """An entity's score is its best feature's."""
    best = evidence.groupBy(*within, "entity_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*within).orderBy(F.desc_nulls_last("score"), "entity_id")
    return best.withColumn("rank", F.row_number().over(order))


def against_labels(ranking: DataFrame, labels: DataFrame, methods: list[str], case: str = "case") -> DataFrame:
    """One row for each labelled case and method; a root cause that isn't ranked, also for want of any evidence, has rank NULL and counts 0."""
    wanted = labels.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    ranked = ranking.select(case, "method", F.col("entity_id").alias("root_cause_service"), "rank")
    rows = wanted.join(ranked, [case, "method", "root_cause_service"], "left")
    hits = {f"hit_{k}": F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)) for k in (1, 3, 5)}
    return rows.withColumn("reciprocal_rank", F.coalesce(1 / F.col("rank"), F.lit(0.0))).withColumns(hits)


def benchmark(results: DataFrame, by: list[str]) -> DataFrame:
    means = [F.avg(c).alias(c) for c in ("hit_1", "hit_3", "hit_5")]
    return results.groupBy(*by).agg(F.count("*").alias("cases"), F.avg("reciprocal_rank").alias("mrr"), *means)
