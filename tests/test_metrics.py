import pytest
from pyspark.sql import functions as F

from faultlens.operators import recipes, validate, windowing
from faultlens.schemas import METRIC


def records(spark, rows, **same):
    base = {"system_id": "a", "entity_id": "pod", "series_id": "s", "metric": "requests", "kind": "counter", "unit": "count", "cadence_seconds": 10.0, "dimensions": "{}", "labels": None}
    full = [base | same | r for r in rows]
    names = [x.split()[0] for x in METRIC.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], METRIC)


def samples(spark, pairs, **same):
    return records(spark, [{"timestamp": float(t), "value": None if v is None else float(v)} for t, v in pairs], **same)


def values(features):
    return [r["value"] for r in features.orderBy("window_end").collect()]


def test_counter_resets_and_gaps_are_missing(spark):
    got = values(windowing.resample(samples(spark, [(0, 300), (10, 345), (20, 360), (30, 12), (40, 72), (95, 200), (105, 230)]), 10))
    # No rate for the first sample, after the reset at 30, and over the gap before 95.
    assert got == [None, 4.5, 1.5, None, 6.0, None, 3.0]


def test_sample_on_a_boundary_is_of_the_next_window(spark):
    got = windowing.resample(samples(spark, [(45, 8), (59.99, 2), (60, 7), (75, 9), (90, 4)], kind="gauge"), 30, 0.1).orderBy("window_end").collect()
    assert [(r["window_end"], r["value"]) for r in got] == [(60, 5.0), (90, 8.0), (120, 4.0)]


def test_coverage_gate_keeps_the_row_without_a_value(spark):
    got = values(windowing.resample(samples(spark, [(3, 14), (12, 10), (24, 12), (33, 16), (41, 50), (47, 70), (85, 6)], kind="gauge"), 40, 0.5))
    assert got == [13.0, 60.0, None]


def test_non_finite_values_are_missing_and_counted(spark):
    rows = samples(spark, [(15, 2.5), (25, float("-inf")), (35, 8), (35, 8), (35, 8), (45, float("nan")), (55, float("inf"))], kind="gauge")
    clean, quality = validate.validate(rows)
    assert quality["nonfinite"] == 3 and quality["exact_duplicates"] == 2
    assert values(clean.select(F.col("timestamp").alias("window_end"), "value")) == [2.5, None, 8.0, None, None]


@pytest.mark.parametrize("change, match", [({"kind": "odd"}, "kind"), ({"system_id": " "}, "identity"), ({"cadence_seconds": 0.0}, "cadence")])
def test_contract_violations_raise(spark, change, match):
    with pytest.raises(ValueError, match=match):
        validate.validate(samples(spark, [(0, 1)], **change))


def test_conflicting_values_and_metadata_raise(spark):
    with pytest.raises(ValueError, match="differing"):
        validate.validate(samples(spark, [(0, 1), (0, 2)]))
    with pytest.raises(ValueError, match="metadata"):
        validate.validate(samples(spark, [(0, 1)]).union(samples(spark, [(10, 1)], unit="ms")))
    with pytest.raises(ValueError, match="more than 1 rows"):
        validate.within_budget(samples(spark, [(0, 1), (10, 2)]), 1)


def feature(spark, rows):
    return spark.createDataFrame([("s", "e", n, n, "{}", int(w), v) for n, w, v in rows], "system_id string, entity_id string, series_id string, feature_name string, dimensions string, window_end long, value double")


def test_request_response(spark):
    rules = [{"name": "lost", "request": "asked", "response": "told"}]
    rows = [("asked", 30, 64.0), ("told", 30, 48.0), ("asked", 60, 0.0), ("told", 60, 3.0), ("asked", 90, 40.0), ("told", 90, 50.0), ("asked", 120, 7.0)]
    got = windowing.request_response(feature(spark, rows), rules).where("feature_name = 'lost'")
    assert values(got) == [pytest.approx(0.25), None, pytest.approx(0.25)]
    with pytest.raises(ValueError, match="more than one series"):
        windowing.request_response(feature(spark, [("told", 30, 5.0), ("told", 30, 6.0), ("asked", 30, 9.0)]), rules)


def test_trim_by_either_end(spark):
    rows = feature(spark, [("x", w, float(w)) for w in (30, 60, 90, 120)])
    ends = lambda start, end: sorted(r["window_end"] for r in windowing.trimmed(rows, start, end, 30).collect())
    assert (ends(31, None), ends(None, 90), ends(30, 119), ends(None, None)) == ([90, 120], [30, 60, 90], [60, 90], [30, 60, 90, 120])


def recipe(op, *metrics, kind="gauge", units=("bytes",)):
    return {"name": "r", "operation": op, "unit": "x", "target_status": "t", "scale": 1, "inputs": [{"metric": m, "kind": kind, "units": list(units)} for m in metrics]}


def test_recipes(spark):
    used = samples(spark, [(5, 36), (15, 9), (25, 75)], metric="heap", series_id="h", kind="gauge", unit="bytes")
    limit = samples(spark, [(5, 48), (15, 0), (25, 60)], metric="cap", series_id="c", kind="gauge", unit="bytes")
    both, ratio = used.union(limit), recipe("ratio", "heap", "cap")
    features, audit = recipes.calculate(both, [ratio], 10)
    assert values(features) == [pytest.approx(0.75), None, pytest.approx(1.25)]
    assert audit.first()["status"] == "calculated"
    status = lambda rows, r=ratio: recipes.calculate(rows, [r], 10)[1].where("entity_id = 'pod'").first()["status"]
    assert status(used.union(limit.withColumn("entity_id", F.lit("other")))) == "missing_source:cap"
    assert status(used.union(limit.withColumn("unit", F.lit("kb")))) == "kind_or_unit_mismatch:cap"
    assert status(both.union(used.withColumn("series_id", F.lit("u2")))) == "ambiguous_series:heap"
    trimmed = features.where("window_end > 10")
    row = recipes.audit_after_trim(audit, trimmed).first()
    assert (row["status"], row["valid_windows"], row["missing_windows"]) == ("calculated", 1, 1)
    assert recipes.audit_after_trim(audit, features.limit(0)).first()["status"] == "no_selected_windows"


def test_partial_sum_is_missing_and_error_fraction(spark):
    came = samples(spark, [(2, 5), (12, 75), (22, 90), (32, 200)], metric="came", series_id="i", unit="bytes")
    went = samples(spark, [(2, 700), (12, 725), (22, 790)], metric="went", series_id="o", unit="bytes")
    features, _ = recipes.calculate(came.union(went), [recipe("sum", "came", "went", kind="counter")], 10)
    assert values(features)[1:] == [pytest.approx(9.5), pytest.approx(8.0), None]
    failed = samples(spark, [(2, 40), (12, 46), (22, 46)], metric="failed", series_id="f", unit="bytes")
    done = samples(spark, [(2, 11), (12, 29), (22, 29)], metric="done", series_id="d", unit="bytes")
    features, _ = recipes.calculate(failed.union(done), [recipe("fraction_of_sum", "failed", "done", kind="counter")], 10)
    assert values(features)[1:] == [pytest.approx(0.25), None]


def test_shipped_recipes_and_checks():
    assert len(recipes.check(recipes.shipped())) == 19
    with pytest.raises(ValueError, match="unique"):
        recipes.check([recipe("identity", "a"), recipe("identity", "b")])
    with pytest.raises(ValueError, match="takes 2 inputs"):
        recipes.check([recipe("ratio", "a")])
