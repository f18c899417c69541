import random

import pytest
from pyspark.sql import functions as F

from faultlens.operators import quantiles


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_quantiles_equal_the_buffered_ones(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(71)
    draw = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: rng.choice([1e-300, 1.0, 1e300]), lambda: 5.0, lambda: None]
    rows = [(rng.choice(["a", "b", "c", None]), g, draw[g]() if rng.random() < 0.9 else None, rng.random()) for g in range(5) for _ in range(400)]
    rows += [("one", 0, 2.5, 0.1), ("two", 0, 1.0, 0.2), ("two", 0, 4.0, 0.9)]
    df = spark.createDataFrame(rows, "k string, g int, v double, w double").repartition(5)
    half = F.when(F.col("w") < 0.5, F.col("v"))
    wanted = {"p0": (F.col("v"), 0.0), "p25": (F.col("v"), 0.25), "p95": (F.col("v"), 0.95), "p100": (F.col("v"), 1.0), "h50": (half, 0.5), "a50": (F.abs("v"), 0.5)}
    plain = df.groupBy("k", "g").agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()])
    groups = df.select("k", "g").distinct()
    got = {(r["k"], r["g"]): r for r in quantiles.beside(groups, quantiles.quantiles(df, ["k", "g"], wanted), ["k", "g"], list(wanted)).collect()}
    want = plain.collect()
    assert len(got) == len(want)
    for r in want:
        for n in wanted:
            assert got[r["k"], r["g"]][n] == (r[n] if r[n] is None else pytest.approx(r[n], rel=1e-12)), (r, n)
    assert quantiles.quantiles(df.limit(0), ["k"], {"x": (F.col("v"), 0.5)}).collect() == []
