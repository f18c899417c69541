"""PCA residuals and isolation forests: fitted on bounded samples, stored as rows, scored row by row.

PCA: the main directions of an entity come from at most 1,023 evenly spread reference windows,
one small singular value decomposition an entity; each feature's loadings are a row. A window's
projections are sums over its features, so that no task holds an entity's windows.

Forests: a tree of one variable is two arrays (where a node cuts, how long a path that ends there
counts) in the order of a binary heap. Trees are drawn from a seeded pool of at most ``trees *
samples`` reference values of the feature; a value walks them by expressions. Both models are
tables that can be written and applied to later data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ENTITY, FEATURE_KEY
from . import scoring

EULER = 0.5772156649015329
#: Reference windows that an entity's directions come from: each n-th, so many at least where there are as many.
SAMPLE_WINDOWS = 512
_KEY = "system_id string, entity_id string, series_id string, feature_name string, dimensions string"


def directions(z: np.ndarray, components: int) -> np.ndarray:
    """The main directions of the rows of ``z``: at most ``components``, and at most half the columns, but one at least."""
    _, _, found = np.linalg.svd(z, full_matrices=False)
    return found[: max(1, min(components, len(found), z.shape[1] // 2))]


def fit_pca(filled: DataFrame, reference_end, components: int = 5) -> DataFrame:
    """FEATURE_KEY, centre, spread, loadings: array<double>; from reference windows of scoring.imputed()."""
    ref = filled.where(scoring.in_reference(reference_end)).select(*FEATURE_KEY, "window_end", "x")
    floor = F.greatest(F.abs("centre") * 1e-6, F.lit(1e-9))
    stats = ref.groupBy(*FEATURE_KEY).agg(F.percentile("x", F.lit(0.5)).alias("centre"), F.stddev_pop("x").alias("std")).withColumn("spread", F.greatest("std", floor)).drop("std")
    windows = ref.select(*ENTITY, "window_end").distinct()
    each = windows.withColumn("i", F.row_number().over(Window.partitionBy(*ENTITY).orderBy("window_end")) - 1)
    stride = F.greatest(F.lit(1).cast("long"), F.expr(f"n div {SAMPLE_WINDOWS}"))
    taken = each.join(windows.groupBy(*ENTITY).agg(F.count("*").alias("n")), ENTITY).where(F.col("i") % stride == 0).select(*ENTITY, "window_end")
    z = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), (F.col("x") - F.col("centre")) / F.col("spread"))).alias("z")
    sample = ref.join(taken, [*ENTITY, "window_end"]).join(stats, FEATURE_KEY).select(*FEATURE_KEY, "window_end", z)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="window_end", columns=["feature_name", "series_id", "dimensions"], values="z").sort_index().sort_index(axis=1)
        found = directions(wide.to_numpy(float), components)
        entity = rows[ENTITY].iloc[0].tolist()
        return pd.DataFrame([(*entity, s, f, d, found[:, j].tolist()) for j, (f, s, d) in enumerate(wide.columns)], columns=[*ENTITY, "series_id", "feature_name", "dimensions", "loadings"])

    return stats.join(sample.groupBy(*ENTITY).applyInPandas(run, f"{_KEY}, loadings array<double>"), FEATURE_KEY)


def pca_scores(filled: DataFrame, model: DataFrame, reference_end, components: int = 5) -> DataFrame:
    """Observed current windows with their absolute residual outside the main directions; components: as the model was fitted, or more."""
    target = (F.col("x") - F.col("centre")) / F.col("spread")
    current = filled.where(~scoring.in_reference(reference_end)).select(*FEATURE_KEY, "window_end", "value", "x").join(model, FEATURE_KEY).withColumn("t", target)
    part = lambda i: F.coalesce(F.get("loadings", F.lit(i)), F.lit(0.0))
    at = [*ENTITY, "window_end"]
    projected = current.groupBy(*at).agg(*[F.sum(F.col("t") * part(i)).alias(f"p{i}") for i in range(components)])
    inside = sum((F.col(f"p{i}") * part(i) for i in range(components)), F.lit(0.0))
    rows = current.where("value IS NOT NULL").join(projected, at)
    return rows.select(*FEATURE_KEY, "window_end", "value", F.lit("pca").alias("method"), F.abs(F.col("t") - inside).alias("score"))


def path_norm(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n


def grow(points: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[list[float | None], list[float]]:
    """cut (None: a leaf) and path of each node; node i's children are 2i + 1 (up to the cut) and 2i + 2."""
    nodes = (1 << depth + 1) - 1
    cut: list[float | None] = [None] * nodes
    path = [0.0] * nodes
    stack = [(np.sort(points), 0, 0)]
    while stack:
        own, node, level = stack.pop()
        path[node] = level + path_norm(len(own))
        if level >= depth or len(own) <= 1 or own[0] == own[-1]:
            continue
        cut[node] = float(rng.uniform(own[0], own[-1]))
        at = int(np.searchsorted(own, cut[node], side="right"))
        stack += [(own[:at], 2 * node + 1, level + 1), (own[at:], 2 * node + 2, level + 1)]
    return cut, path


def fit_forest(filled: DataFrame, reference_end, trees: int = 32, samples: int = 256, seed: int = 42) -> DataFrame:
    """FEATURE_KEY, norm, trees: array<struct<cut, path>>; from reference values of scoring.imputed()."""
    ref = filled.where(scoring.in_reference(reference_end)).select(*FEATURE_KEY, "window_end", "x")
    # The same values whatever the partitions: those of the least hashes.
    draw = F.xxhash64(F.lit(seed), *FEATURE_KEY, "window_end")
    order = Window.partitionBy(*FEATURE_KEY).orderBy(draw, "window_end")
    pool = ref.withColumn("i", F.row_number().over(order)).where(F.col("i") <= trees * samples).drop("i")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[FEATURE_KEY].iloc[0].tolist()
        x = rows.sort_values("window_end")["x"].to_numpy(float)
        rng = np.random.default_rng(_seed(seed, *key))
        size = min(samples, len(x))
        depth = int(np.ceil(np.log2(max(size, 2))))
        grown = [dict(zip(("cut", "path"), grow(rng.choice(x, size, replace=False), depth, rng), strict=True)) for _ in range(trees)]
        return pd.DataFrame([(*key, max(path_norm(size), 1e-12), grown)], columns=[*FEATURE_KEY, "norm", "trees"])

    kinds = ", ".join(f"{c} string" for c in FEATURE_KEY)
    return pool.groupBy(*FEATURE_KEY).applyInPandas(run, f"{kinds}, norm double, trees array<struct<cut: array<double>, path: array<double>>>")


def forest_score(value: Column, trees: Column, norm: Column, samples: int = 256) -> Column:
    """2 ** (-mean path / norm) of a value: the deeper it has to go, the lower."""
    levels = F.sequence(F.lit(1), F.lit(int(np.ceil(np.log2(max(samples, 2))))))

    def down(tree: Column) -> Column:
        step = lambda node, _: F.when(F.get(tree["cut"], node).isNull(), node).otherwise(2 * node + F.when(value <= F.get(tree["cut"], node), 1).otherwise(2))
        return F.get(tree["path"], F.aggregate(levels, F.lit(0), step))

    total = F.aggregate(F.transform(trees, down), F.lit(0.0), lambda a, p: a + p)
    return F.pow(F.lit(2.0), -total / F.size(trees) / norm)


def forest_scores(filled: DataFrame, model: DataFrame, reference_end, samples: int = 256) -> DataFrame:
    """Observed current windows with their isolation score."""
    current = filled.where(~scoring.in_reference(reference_end) & F.col("value").isNotNull()).select(*FEATURE_KEY, "window_end", "value").join(model, FEATURE_KEY)
    return current.select(*FEATURE_KEY, "window_end", "value", F.lit("isolation_forest").alias("method"), forest_score(F.col("value"), F.col("trees"), F.col("norm"), samples).alias("score"))


def _seed(seed: int, *key: str) -> int:
    return int.from_bytes(hashlib.sha256("\0".join((str(seed), *key)).encode()).digest()[:8], "big")


def fit_models(filled: DataFrame, reference_end, methods, components: int = 5, trees: int = 32, samples: int = 256, seed: int = 42) -> dict[str, DataFrame]:
    """The fitted tables of the methods pca and isolation_forest, by method."""
    make = {"pca": lambda: fit_pca(filled, reference_end, components), "isolation_forest": lambda: fit_forest(filled, reference_end, trees, samples, seed)}
    return {m: make[m]() for m in methods}


def apply_models(filled: DataFrame, reference_end, models: dict[str, DataFrame], components: int = 5, samples: int = 256) -> DataFrame:
    """Peaks of each model; ``filled`` as scoring.imputed() gives it, ``reference_end`` a number or a column of it."""
    make = {"pca": lambda m: pca_scores(filled, m, reference_end, components), "isolation_forest": lambda m: forest_scores(filled, m, reference_end, samples)}
    found = None
    for method, model in models.items():
        own = scoring.peaks(make[method](model))
        found = own if found is None else found.unionByName(own)
    return found


def model_peaks(filled: DataFrame, reference_end, methods, components: int = 5, trees: int = 32, samples: int = 256, seed: int = 42) -> DataFrame:
    """Fits and applies at once."""
    return apply_models(filled, reference_end, fit_models(filled, reference_end, methods, components, trees, samples, seed), components, samples)
