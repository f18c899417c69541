import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.operators import models, profile, ranking, relate, scoring, windowing

FEATURE = "system_id string, entity_id string, series_id string, feature_name string, dimensions string, window_end long, value double"


def frame(spark, columns, entity="e", step=60):
    rows = [("s", entity, n, n, "{}", (i + 1) * step, None if v is None else float(v)) for n, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, FEATURE)


def test_ranking_finds_the_peak(spark):
    f = frame(spark, {"queue": [7, 9, 8, 6, 7, 9, 8, 8, 31, 7], "disk": [40, 44, 42, 41, 45, 40, 43, 44, 41, 47]})
    ev = scoring.evidence(windowing.dense_grid(f, 60), 420, 5, 0.8, ["mad"])
    rows = ranking.feature_ranking(ev).orderBy("feature_rank").collect()
    assert [r["feature_rank"] for r in rows] == [1, 2]
    assert (rows[0]["feature_name"], rows[0]["peak_window_end"], rows[0]["peak_value"], rows[0]["reference_count"]) == ("queue", 540, 31.0, 7)
    assert rows[0]["score"] == pytest.approx((31 - 8) / (1.4826 * 1)) and rows[1]["score"] == pytest.approx((47 - 42) / (1.4826 * 2))


def test_fit_does_not_see_current_windows(spark):
    calm = [12.5, 11.0, 14.25, 13.0, 12.0, 11.75, 15.5, 12.25]
    fits = []
    for later in ([12.0, 13.5], [-4e9, 7e7]):
        g = windowing.dense_grid(frame(spark, {"x": calm + later}), 60)
        filled = scoring.imputed(g, scoring.eligibility(g, 480, 5, 0.5))
        fits.append(scoring.fitted(filled, 480).collect())
    assert fits[0] == fits[1] and fits[0][0]["mean"] == pytest.approx(np.mean(calm))


def test_each_system_has_its_own_reference_end(spark):
    """Boundaries as rows: times stay absolute, and each system is fitted on its own reference."""
    early, late = [5.0, 6.0, 5.5, 6.5, 5.0, 60.0, 6.0], [5.0, 6.0, 5.5, 6.5, 5.0, 6.0, 60.0]
    f = frame(spark, {"x": early}).union(frame(spark, {"x": late}).withColumn("system_id", F.lit("t")))
    ends = spark.createDataFrame([("s", 300), ("t", 360)], "system_id string, boundary long")
    g = windowing.dense_grid(f, 60).join(ends, "system_id")
    filled = scoring.imputed(g, scoring.eligibility(g, F.col("boundary"), 5, 0.5))
    forest = models.model_peaks(filled, F.col("boundary"), ["isolation_forest"]).collect()
    plain = scoring.evidence(g, F.col("boundary"), 5, 0.5, ["mad", "iqr"]).collect()
    assert {(r["system_id"], r["peak_window_end"], r["peak_value"]) for r in [*plain, *forest]} == {("s", 360, 60.0), ("t", 420, 60.0)}
    assert {(r["system_id"], r["reference_count"]) for r in plain} == {("s", 5), ("t", 6)}


def test_dense_grid_exposes_silent_windows_and_gates(spark):
    f = frame(spark, {"x": [3, 4, 3, 5, 4, 3, 6, 4]}).where("window_end NOT IN (120, 300)")
    g = windowing.dense_grid(f, 60)
    assert g.count() == 8 and g.where("value IS NULL").count() == 2
    e = scoring.eligibility(g, 360, 5, 0.5).first()
    assert not e["eligible"] and e["reference_count"] == 4 and e["reference_windows"] == 6
    with pytest.raises(ValueError, match="budget"):
        windowing.dense_grid(f, 60, 2)


def test_missing_current_never_scores(spark):
    rng = np.random.default_rng(8)
    tide, noise = [round(20 + 4 * np.sin(i / 3), 3) for i in range(24)], [round(float(v), 3) for v in rng.uniform(1, 2, 24)]
    g = windowing.dense_grid(frame(spark, {"tide": [*tide, 21.5, None, -35.0, None], "noise": [*noise, None, 1.4, None, 9.25]}), 60)
    filled = scoring.imputed(g, scoring.eligibility(g, 1440, 5, 0.5))
    plain = {r["feature_name"]: r["peak_value"] for r in scoring.evidence(g, 1440, 5, 0.5, ["nsigma"]).collect()}
    assert plain == {"tide": -35.0, "noise": 9.25}
    found = models.model_peaks(filled, 1440, ["pca", "isolation_forest"]).collect()
    assert {r["peak_value"] for r in found if r["feature_name"] == "tide" and r["method"] == "isolation_forest"} == {-35.0}
    again = models.model_peaks(filled.repartition(3), 1440, ["isolation_forest"]).collect()
    one = lambda rows: sorted((r["feature_name"], r["score"]) for r in rows if r["method"] == "isolation_forest")
    assert one(found) == one(again)


def walked(value, tree):
    node = 0
    while tree["cut"][node] is not None:
        node = 2 * node + (1 if value <= tree["cut"][node] else 2)
    return tree["path"][node]


def test_models_against_plain_numpy(spark):
    rng = np.random.default_rng(5)
    n, end = 1100, 1100 * 60
    base = rng.normal(size=(n + 40, 2)) @ rng.normal(size=(2, 6)) + 0.1 * rng.normal(size=(n + 40, 6))
    base[n + 7, 2] += 9
    columns = {f"m{j}": [None if rng.random() < 0.05 else float(v) for v in base[:, j]] for j in range(6)}
    g = windowing.dense_grid(frame(spark, columns), 60)
    filled = scoring.imputed(g, scoring.eligibility(g, end, 5, 0.5))
    rows = filled.orderBy("feature_name", "window_end").collect()
    x, seen = (np.array([[r[c] if r[c] is not None else np.nan for r in rows if r["feature_name"] == m] for m in sorted(columns)], dtype=float).T for c in ("x", "value"))
    ref, cur = x[:n], x[n:]
    centre = np.median(ref, axis=0)
    spread = np.maximum(ref.std(axis=0), np.maximum(abs(centre) * 1e-6, 1e-9))
    main = np.linalg.svd(np.clip((ref - centre) / spread, -100, 100)[:: n // 512], full_matrices=False)[2][:2]
    t = (cur - centre) / spread
    want = np.where(np.isnan(seen[n:]), np.nan, abs(t - t @ main.T @ main))
    stored = models.fit_models(filled, end, ["pca", "isolation_forest"], 2, 8, 64, 3)
    got = {(r["feature_name"], r["window_end"]): r["score"] for r in models.pca_scores(filled, stored["pca"], end, 5).collect()}
    assert len(got) == (~np.isnan(want)).sum()
    for j, m in enumerate(sorted(columns)):
        for i in range(40):
            if not np.isnan(want[i, j]):
                assert got[m, (n + i + 1) * 60] == pytest.approx(want[i, j], abs=1e-9)
    trees = {r["feature_name"]: r for r in stored["isolation_forest"].collect()}
    for r in models.forest_scores(filled, stored["isolation_forest"], end, 64).collect():
        own = trees[r["feature_name"]]
        assert len(own["trees"]) == 8 and r["score"] == pytest.approx(2 ** -(np.mean([walked(r["value"], tree) for tree in own["trees"]]) / own["norm"]), rel=1e-12)
    for row in trees.values():
        for tree in row["trees"]:
            leaves = [k for k, c in enumerate(tree["cut"]) if c is None]
            assert len(tree["cut"]) == 127 and all(c is None or lo < c for c, lo in [(tree["cut"][0], min(v for v in columns[row["feature_name"]] if v is not None))]) and leaves


def test_stored_models_give_the_same_peaks(spark, tmp_path):
    rng = np.random.default_rng(6)
    g = windowing.dense_grid(frame(spark, {k: [float(v) for v in rng.normal(size=60)] for k in "abc"}), 60)
    filled = scoring.imputed(g, scoring.eligibility(g, 2400, 5, 0.5))
    fitted = models.fit_models(filled, 2400, ["pca", "isolation_forest"])
    for m, df in fitted.items():
        df.write.parquet(str(tmp_path / m))
    kept = {m: spark.read.parquet(str(tmp_path / m)) for m in fitted}
    one = lambda df: sorted((r["method"], r["feature_name"], round(r["score"], 9), r["peak_window_end"]) for r in df.collect())
    assert one(models.apply_models(filled, 2400, kept)) == one(models.model_peaks(filled.repartition(7), 2400, ["pca", "isolation_forest"]))


def test_forest_sets_far_values_apart():
    rng = np.random.default_rng(1)
    ref = rng.normal(size=300)
    trees = [dict(zip(("cut", "path"), models.grow(rng.choice(ref, 256, replace=False), 8, rng), strict=True)) for _ in range(32)]
    near, far = (2 ** -(np.mean([walked(v, t) for t in trees]) / models.path_norm(256)) for v in (0.0, 8.0))
    assert far > 0.6 > near


def test_iqr_fences_come_from_the_reference(spark):
    f = frame(spark, {"f": [14, 10, 18, 12, 16, 13, 15, 26, None, 11, 2]})
    r = profile.distribution(f, ["feature_name"], F.col("window_end") <= 420).first()
    # Of the seven reference values the quartiles are 12.5 and 15.5.
    assert (r["iqr_lower"], r["iqr_upper"], r["iqr_outlier_count"], r["missing_count"], r["count"]) == (8.0, 20.0, 2, 1, 10)
    c = profile.contrast(f, ["feature_name"], F.col("window_end") <= 420).first()
    assert (c["reference_median"], c["current_median"], c["current_missing_ratio"]) == (14.0, 11.0, 0.25)


def test_correlations_need_variation(spark):
    up = [3.0, 3.5, 9.0, 11.0, 40.0, 41.0, 70.0]
    f = frame(spark, {"a": up, "b": [90 - 2 * v for v in up], "c": [6.5] * 7})
    got = {(r["left"], r["right"]): (r["pearson"], r["spearman"]) for r in profile.correlation_matrix(f, ["entity_id"]).collect()}
    assert got[("a", "b")] == (pytest.approx(-1), pytest.approx(-1)) and got[("a", "c")] == (None, None)


def decisions(spark, columns, rule, end, minimum=3):
    wide = relate.wide_fields(windowing.dense_grid(frame(spark, columns), 60), list(columns))
    return [r["status"] for r in relate.evaluate_rule(wide, rule, end, minimum).orderBy("window_end").collect()]


def test_rules(spark):
    gap = {"name": "g", "left": "sent", "right": "got", "operation": "relative_gap", "threshold_mode": "fixed", "threshold": 0.15, "consecutive_windows": 2}
    lost = decisions(spark, {"sent": [80, 64, 0, 50, 50, 20, None], "got": [60, 32, 5, 49, 30, 10, 4]}, gap, 0)
    assert lost == ["watch", "anomaly_candidate", "unknown", "within_threshold", "watch", "anomaly_candidate", "unknown"]
    low = {"name": "l", "left": "x", "direction": "lower", "quantile": 0.25, "consecutive_windows": 3}
    assert decisions(spark, {"x": [22, 30, 26, 28, 19, 18, 17, 27], "y": [2] * 8}, low, 240) == ["reference"] * 4 + ["watch", "watch", "anomaly_candidate", "within_threshold"]
    for bad in ({"operation": "odd"}, {"direction": "up"}, {"threshold_mode": "odd"}, {"quantile": 1.5}, {"consecutive_windows": 0}):
        with pytest.raises(ValueError):
            relate.check_rule({"name": "r", "left": "x"} | bad)


def test_lag_sign(spark):
    rng = np.random.default_rng(3)
    lead = rng.uniform(5, 50, 64)
    follows = [None] * 3 + [400 - 3 * v for v in lead[:-3]]
    g = windowing.dense_grid(frame(spark, {"lead": list(lead), "follows": follows, "still": [0.25] * 64}), 60)
    rows = relate.correlation_pairs(g, ["lead", "follows", "still"], 64 * 60, 10, 4, 60).where("period = 'reference'").collect()
    best = min((r for r in rows if (r["left"], r["right"]) == ("lead", "follows")), key=lambda r: r["pearson"] or 0)
    assert (best["lag_windows"], best["n_pairs"]) == (3, 61) and best["pearson"] == pytest.approx(-1)
    assert all(r["pearson"] is None for r in rows if r["right"] == "still")


def test_dimensions_are_cohorts_of_their_own(spark):
    values = {"hot": [4, 9, 5, 8, 6, 30, 31], "cold": [7, 7, 8, 6, 7, 8, 6]}
    f = None
    for zone, vs in values.items():
        one = frame(spark, {"x": vs, "y": [2 * v + 1 for v in vs] if zone == "hot" else [50 - v for v in vs]}).withColumn("dimensions", F.lit(zone))
        f = one if f is None else f.union(one)
    assert {(r["dimensions"], r["fields"], r["status"]) for r in relate.cohort_status(f, ["x", "y"]).collect()} == {("hot", 2, "ok"), ("cold", 2, "ok")}
    g = windowing.dense_grid(f, 60, within=["system_id", "entity_id", "dimensions"])
    pairs = relate.correlation_pairs(g, ["x", "y"], 300, 3, 0, 60).where("period = 'reference'").collect()
    assert {r["dimensions"]: round(r["pearson"], 6) for r in pairs} == {"hot": 1.0, "cold": -1.0}
    rule = {"name": "r", "left": "x", "quantile": 0.9, "consecutive_windows": 2}
    got = relate.evaluate_rule(relate.wide_fields(g, ["x", "y"]), rule, 300, 3).where("window_end > 300").orderBy("window_end").collect()
    assert [r["status"] for r in got if r["dimensions"] == "hot"] == ["watch", "anomaly_candidate"]
    assert [r["status"] for r in got if r["dimensions"] == "cold"] == ["watch", "within_threshold"]
    with pytest.raises(ValueError, match="only fields of the report"):
        relate.check_report({"fields": ["x", "y"], "rules": [{"name": "r", "left": "z"}]}, 60)


def test_unranked_root_cause_counts_zero(spark):
    ranked = spark.createDataFrame([("c", "mad", "a", 1), ("c", "mad", "b", 2)], "`case` string, method string, entity_id string, rank int")
    labels = spark.createDataFrame([("c", "d", "absent"), ("nothing", "d", "a")], "`case` string, dataset string, root_cause_service string")
    rows = ranking.against_labels(ranked, labels, ["mad", "iqr"]).collect()
    assert {(r["case"], r["method"]) for r in rows} == {(c, m) for c in ("c", "nothing") for m in ("mad", "iqr")}
    assert {(r["rank"], r["reciprocal_rank"], r["hit_5"]) for r in rows} == {(None, 0.0, 0)}
    assert ranking.benchmark(ranking.against_labels(ranked, labels.withColumn("root_cause_service", F.lit("a")), ["mad"]), ["method"]).first()["mrr"] == 0.5
