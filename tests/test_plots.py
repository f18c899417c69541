"""Chart frames against plain loops."""

import random
from collections import defaultdict

from faultlens.operators import plots


def test_timeline_keeps_the_ends_of_each_bucket(spark):
    rng = random.Random(81)
    rows = [(g, rng.randint(0, 5000), rng.choice([None, float("nan"), float("inf"), float(rng.randint(0, 9))])) for g in "ab" for _ in range(900)] + [("one", 7, 2.0)]
    got = {(r["g"], r["bucket"]): r for r in plots.timeline(spark.createDataFrame(rows, "g string, window_end long, value double"), ["g"], 16).collect()}
    own = defaultdict(list)
    for g, t, v in rows:
        if v is not None and v == v and v != float("inf"):
            own[g].append((t, v))
    want = defaultdict(list)
    for g, points in own.items():
        lo, hi = min(points)[0], max(points)[0]
        for t, v in points:
            want[g, min(15, (t - lo) * 16 // max(hi - lo, 1))].append((t, v))
    assert set(got) == set(want) and len(got) <= 2 * 16 + 1
    for k, points in want.items():
        r, last = got[k], max(t for t, _ in points)
        assert (r["first_at"], r["first"]) == min(points) and (r["last_at"], r["last"]) == (last, min(v for t, v in points if t == last))
        assert (r["least"], r["largest"], r["n"]) == (min(v for _, v in points), max(v for _, v in points), len(points))


def test_chosen_features_and_labels(spark):
    rows = [("s", e, f"{f}{'x' * 50}|series") for e in ("e3", "e1", "e2") for f in ("b", "a", "c")]
    got = plots.chosen(spark.createDataFrame(rows, "system_id string, entity_id string, feature string"), "feature", 2, 2).collect()
    assert sorted((r["entity_id"], r["number"], r["label"]) for r in got) == [(e, i, f"{i}: {f}{'x' * 39}") for e in ("e1", "e2") for i, f in ((1, "a"), (2, "b"))]


def test_scatter_counts_every_pair_once(spark):
    rng = random.Random(82)
    rows = [("g", float(rng.randint(0, 40)) if rng.random() < 0.9 else None, rng.gauss(0, 1)) for _ in range(500)] + [("flat", 3.0, 3.0)] * 4
    got = plots.scatter(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], 5).collect()
    assert sum(r["n"] for r in got if r["g"] == "g") == sum(x is not None for g, x, _ in rows if g == "g")
    assert [(r["x_bin"], r["y_bin"], r["n"], r["x_start"]) for r in got if r["g"] == "flat"] == [(0, 0, 4, 3.0)]
    assert all(0 <= r["x_bin"] < 5 and 0 <= r["y_bin"] < 5 for r in got)
