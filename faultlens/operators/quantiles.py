"""Exact, linearly interpolated quantiles of groups of any size.

A group's range is cut into equal bins; counts by bin tell in which bins the wanted ranks lie,
and only the values there are counted one by one and ranked. Everything before the ranks is
partial sums, so that no task holds a group, and what is ranked is a small share of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """A row for each group that has a value: ``by`` and, by name, the quantile of a column's values that aren't NULL (NULL if it has none).

    A NULL in ``by`` is a group of its own.
    """
    sides = list({str(c): c for c, _ in wanted.values()}.items())
    number = {name: k for k, (name, _) in enumerate(sides)}
    keys = [f"__k{i}" for i in range(len(by))]
    shown = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), c.cast("double").alias("v")) for k, (_, c) in enumerate(sides)])) if len(sides) > 1 else F.struct(F.lit(0).alias("side"), sides[0][1].cast("double").alias("v"))
    values = rows.select(*shown, each.alias("x")).select(*keys, "x.side", "x.v").where("v IS NOT NULL")
    group = [*keys, "side"]
    same = lambda left, right, on: F.expr(" AND ".join(f"{left}.{c} <=> {right}.{c}" for c in on)) if on else F.lit(True)
    ends = values.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = F.col("hi") / BINS - F.col("lo") / BINS
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)).cast("int"), F.lit(0))))
    binned = values.alias("a").join(ends.alias("b"), same("a", "b", group)).select(*[f"a.{c}" for c in group], place.alias("bin"), "v")
    counted = binned.groupBy(*group, "bin", "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    bins = counted.groupBy(*group, "bin").agg(F.sum("c").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    # Ranks from 0; each quantile lies between two of them.
    at = {name: (number[str(c)], q) for name, (c, q) in wanted.items()}
    total = F.col("n") - 1
    rank = lambda q: F.lit(q) * total
    ranks = F.array(*[F.when(F.col("side") == k, f(rank(q))) for k, q in at.values() for f in (F.floor, F.ceil)])
    bins = bins.alias("a").join(ends.alias("b"), same("a", "b", group)).select(*[f"a.{c}" for c in group], "bin", "m", "before", "n")
    needed = bins.where(F.exists(ranks, lambda r: F.coalesce((r >= F.col("before")) & (r < F.col("before") + F.col("m")), F.lit(False))))
    inside = [*group, "bin"]
    near = counted.alias("a").join(needed.alias("b"), same("a", "b", inside)).select(*[f"a.{c}" for c in inside], "v", "c", "before", "n")
    within = Window.partitionBy(*inside).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = near.withColumn("first", F.col("before") + F.coalesce(F.sum("c").over(within), F.lit(0)))

    def value(k: int, r: Column) -> Column:
        return F.max(F.when((F.col("side") == k) & (F.col("first") <= r) & (r < F.col("first") + F.col("c")), F.col("v")))

    cells = []
    for name, (k, q) in at.items():
        low, high = F.floor(rank(q)), F.ceil(rank(q))
        size = F.max(F.when(F.col("side") == k, F.col("n")))
        cells += [value(k, low).alias(f"{name}__l"), value(k, high).alias(f"{name}__h"), size.alias(f"{name}__n")]
    found = ranked.groupBy(*keys).agg(*cells)

    def between(name: str, q: float) -> Column:
        pos = F.lit(q) * (F.col(f"{name}__n") - 1)
        low, high = F.col(f"{name}__l"), F.col(f"{name}__h")
        return F.when(F.floor(pos) == F.ceil(pos), low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *[between(name, q).alias(name) for name, (_, q) in at.items()])


def beside(rows: DataFrame, found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the ``names`` that quantiles() found for their group, NULL where it has no value."""
    on = F.expr(" AND ".join(f"a.`{c}` <=> b.`{c}`" for c in by))
    return rows.alias("a").join(found.alias("b"), on, "left").select("a.*", *[f"b.{n}" for n in names])
