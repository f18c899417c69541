import json
from pathlib import Path

import pytest

from faultlens import cli, flows
from faultlens.artifacts import file_sha256, write_json
from faultlens.settings import AnalysisSettings, RuntimeSettings
from faultlens.sources import corpus, range_api


def case_csv(path: Path, *lines: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{line}\n" for line in lines))
    return str(path)


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("time").collect()]


def test_scenarios_and_files():
    assert corpus.parse_scenario("cart_service_cpu_2") == ("cart_service", "cpu") and corpus.parse_scenario("a_f3") == ("a", "f3")
    with pytest.raises(ValueError):
        corpus.parse_scenario("cart_unknown")
    cases = corpus.expected_cases()
    assert {d: len(c) for d, c in cases.items()} == {**{f"RE1-{s}": 125 for s in ("OB", "SS", "TT")}, **{f"RE2-{s}": 90 for s in ("OB", "SS", "TT")}, **{f"RE3-{s}": 30 for s in ("OB", "SS", "TT")}}
    assert all(corpus.parse_scenario(c.split("/")[0]) for own in cases.values() for c in own) and len({c for own in cases.values() for c in own}) > 300
    assert [corpus.metric_file(d) for d in ("RE1-OB", "RE1-SS", "RE2-TT")] == ["data.csv", "simple_data.csv", "simple_metrics.csv"]


BLOCKS = ["time,web_rps,web_err,time,db_qps", "5000,31,0,5015,870", "5030,29,2,5030,905", "5060,,,5045,861", "5090,35,1,,"]


def test_clock_blocks(spark, tmp_path):
    p = case_csv(tmp_path / "blocks.csv", *BLOCKS)
    with pytest.raises(ValueError, match="differ, first"):
        corpus.read_metrics(spark, p)
    frame, quality, rejected = corpus.read_metrics(spark, p, duplicate_time_policy="align_blocks", expected_time_columns=[1, 4])
    assert rows(frame, "time", "web_rps", "web_err", "db_qps") == [
        (5000, 31, 0, None), (5015, None, None, 870), (5030, 29, 2, 905), (5045, None, None, 861), (5060, None, None, None), (5090, 35, 1, None),
    ]
    assert rejected is None and quality["clock_columns"] == 2
    with pytest.raises(ValueError, match="time columns"):
        corpus.read_metrics(spark, p, duplicate_time_policy="align_blocks", expected_time_columns=[1, 3])


def test_values_without_an_own_clock(spark, tmp_path):
    p = case_csv(tmp_path / "lost.csv", *BLOCKS, ",44,3,5120,799", "5150,28,0,,640")
    with pytest.raises(ValueError, match="quarantine"):
        corpus.read_metrics(spark, p, duplicate_time_policy="align_blocks")
    frame, quality, rejected = corpus.read_metrics(spark, p, missing_time_policy="quarantine", duplicate_time_policy="align_blocks")
    assert quality["rejected_rows"] == 2 and frame.where("time = 5150").first()["db_qps"] is None
    kept = {(r["source_record_number"], r["clock_occurrence"], r["web_rps"], r["web_err"], r["db_qps"]) for r in rejected.collect()}
    assert kept == {(5, 1, 44, 3, None), (6, 2, None, None, 640)}


@pytest.mark.parametrize(
    "lines, match",
    [
        (["time,web_rps,time,db_qps", "70,1,80,2", "71,3,80,4"], "duplicate timestamps"),
        (["time,web_rps,time,db_qps", "70,1,80,2", "71,3,inf,4"], "infinite"),
        (["time,web_rps,time,db_qps", "70,1,,", "71,3,,"], "no or duplicate"),
        (["web_rps,time,time,db_qps", "1,70,80,2"], "column 1"),
        (["time,time,db_qps", "70,70,2"], "column 1"),
    ],
)
def test_bad_clock_blocks(spark, tmp_path, lines, match):
    with pytest.raises(ValueError, match=match):
        corpus.read_metrics(spark, case_csv(tmp_path / "bad.csv", *lines), missing_time_policy="quarantine", duplicate_time_policy="align_blocks")


def test_equal_clocks_and_quarantine(spark, tmp_path):
    frame, quality, _ = corpus.read_metrics(spark, case_csv(tmp_path / "same.csv", "time,mq_depth,time", "640,17,640", "655,12,655", "670,90,670"))
    assert rows(frame, "time", "mq_depth") == [(640, 17), (655, 12), (670, 90)] and quality["clock_columns"] == 2
    p = case_csv(tmp_path / "holes.csv", "time,mq_depth,time,mq_age", "640,17,640,0.5", ",23,655,0.25", ",41,,4.5", "670,,670,1.5", ",,,8")
    with pytest.raises(ValueError, match="without a time"):
        corpus.read_metrics(spark, p)
    frame, quality, rejected = corpus.read_metrics(spark, p, missing_time_policy="quarantine")
    assert rows(frame, "time", "mq_depth") == [(640, 17), (655, 23), (670, None)] and (quality["recovered_clocks"], quality["rejected_rows"]) == (1, 2)
    assert {(r["source_record_number"], r["mq_depth"], r["mq_age"]) for r in rejected.collect()} == {(3, 41, 4.5), (5, None, 8)}
    far = case_csv(tmp_path / "far.csv", "time,mq_depth,time", *[f"{640 + k},{k},{640 + k + (k > 3)}" for k in range(12)])
    with pytest.raises(ValueError, match=r"8 rows whose clocks differ, first \[5, 6, 7, 8, 9\]"):
        corpus.read_metrics(spark, far)


def test_frame_checks(spark, tmp_path):
    _, quality, _ = corpus.read_metrics(spark, case_csv(tmp_path / "odd.csv", "time,gc_ms,,Unnamed: 3", "12,-Infinity,5,6", "13,,7,8", "14,250,9,1", "15,,2,3"))
    assert (quality["missing_values"], quality["infinite_values"], quality["fields"], quality["rows"]) == (2, 1, 1, 4)
    bad = {
        "seconds": ["time,gc_ms", "1688888888123,4"], "duplicate timestamps": ["time,gc_ms", "12,4", "13,5", "12,6"], "no metric": ["time", "12"],
        "no time": ["gc_ms", "4"], "duplicate metric": ["time,gc_ms,gc_ms", "12,4,5"], "infinite": ["time,gc_ms", "12,4", "inf,5"],
    }
    for match, lines in bad.items():
        with pytest.raises(ValueError, match=match):
            corpus.read_metrics(spark, case_csv(tmp_path / f"{match[:4]}.csv", *lines), missing_time_policy="quarantine")
    with pytest.raises(ValueError, match="more than 2 rows"):
        corpus.read_metrics(spark, case_csv(tmp_path / "long.csv", "time,gc_ms", "12,4", "13,5", "14,6"), max_rows=2)


@pytest.fixture
def tree(tmp_path):
    """A queue that fills up from the injection on, beside two that go on as before."""
    lines = ["time,orders_mem,payment_mem,user_mem"]
    for k in range(160):
        t = 7200 + 15 * k
        full = 40 if t >= 8700 else 0
        lines.append(f"{t},{50 + k % 7},{30 + k % 5 + full},{12 + k % 3}")
    folder = tmp_path / "data/RE1-SS/RE1-SS/payment_mem/2"
    case_csv(folder / "simple_data.csv", *lines)
    (folder / "inject_time.txt").write_text("8700\n")
    return tmp_path / "data"


EXPECTED = {"RE1-SS": ["payment_mem/2"]}
ANALYSIS = {"analysis": {"window_seconds": 60, "min_reference_points": 5}}


def test_benchmark_end_to_end(spark, tree, tmp_path):
    overall = {r["method"]: r for r in flows.run_benchmark(spark, ANALYSIS, tmp_path / "run", tree, EXPECTED).collect()}
    assert set(overall) == {"mad", "nsigma", "iqr", "pca", "isolation_forest"} and overall["mad"]["hit_1"] == 1
    manifest = json.loads((tmp_path / "run/manifest.json").read_text())
    assert manifest["files"]["inventory.json"] == file_sha256(tmp_path / "run/inventory.json")
    found = spark.read.parquet(str(tmp_path / "run/evidence.parquet"))
    assert {(r["lo"] > 8700, r["hi"] <= 9585) for r in found.selectExpr("min(peak_window_end) lo", "max(peak_window_end) hi").collect()} == {(True, True)}
    with pytest.raises(FileExistsError):
        flows.run_benchmark(spark, ANALYSIS, tmp_path / "run", tree, EXPECTED)


def test_inventory_gate(spark, tree, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        corpus.inventory(spark, tree, {"RE1-SS": ["payment_mem/2", "payment_mem/3"]})
    with pytest.raises(ValueError, match="unknown"):
        corpus.inventory(spark, tree, EXPECTED, ["RE9"])
    with pytest.raises(ValueError, match="unexpected"):
        corpus.inventory(spark, tree, {"RE1-SS": []})
    rows = flows.preflight(spark, ANALYSIS, tmp_path / "pre", tree, EXPECTED)
    assert [r["status"] for r in rows] == ["READY"]
    (tree / "RE1-SS/RE1-SS/payment_mem/2/inject_time.txt").write_text("99000")
    assert flows.preflight(spark, ANALYSIS, tmp_path / "pre2", tree, EXPECTED)[0]["status"] == "ERROR"


def test_catalogue(spark, tmp_path):
    spark.createDataFrame([("a_cpu-1", "RE1-OB", "OB", "cpu", "a", 30.0)], "`case` string, dataset string, system string, fault string, root_cause_service string, inject_time double").write.parquet(str(tmp_path / "cases.parquet"))
    spark.createDataFrame([(float(t), 1.0) for t in range(60)], "time double, a_cpu double").write.parquet(str(tmp_path / "a_cpu-1/metrics.parquet"))
    found, report = corpus.inventory(spark, tmp_path, {"RE1-OB": ["a_cpu-1"]})
    assert found[0].source_format == "parquet" and report["mode"] == "full"
    frame, quality, _ = corpus.read_metrics(spark, found[0].metric_file)
    assert quality["rows"] == 60 and frame.columns == ["time", "a_cpu"]
    assert corpus.modality_summary(spark, None) == {"present": False}


def test_read_options():
    config = {"case_overrides": {"c": {"duplicate_time_policy": "align_blocks"}}}
    assert corpus.read_options(config, "c")["duplicate_time_policy"] == "align_blocks" and "duplicate_time_policy" not in corpus.read_options(config, "d")
    with pytest.raises(ValueError, match="unknown options"):
        corpus.read_options({"case_overrides": {"c": {"odd": 1}}}, "c")


def test_selectors_and_chunks():
    assert range_api.selector("up", {"b": "2"}, {"a": 'x"'}) == 'up{a="x\\"",b="2"}'
    with pytest.raises(ValueError, match="can't be changed"):
        range_api.selector("up", {"b": "2"}, {"b": "3"})
    with pytest.raises(ValueError, match="not a metric"):
        range_api.selector("1up", {"b": "2"})
    with pytest.raises(ValueError, match="labels of its system"):
        range_api.selector("up", {}, {"a": "1"})
    assert range_api.chunks(0, 100, 10, 40) == [(0, 30), (40, 70), (80, 100)]
    with pytest.raises(ValueError):
        range_api.chunks(0, 100, 10, 5)


def answer(**more):
    body = {"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"pod_id": "p1", "zone": "z"}, "values": [[10, "1.5"], [20, "NaN"]]}]}}
    return json.dumps(body | more)


METRIC = {"name": "cpu", "kind": "gauge", "unit": "cores", "comparison_dimensions": ["zone", "rack"]}


def test_decode(spark):
    got = range_api.decode(spark.createDataFrame([(answer(),)], "body string"), "s", METRIC, "pod_id", 60).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["value"], r["entity_id"]) for r in got] == [(10.0, 1.5, "p1"), (20.0, None, "p1")]
    assert got[0]["dimensions"] == '{"rack":"","zone":"z"}' and len(got[0]["series_id"]) == 24
    for bad in (answer(isPartial=True), answer(status="error"), answer(warnings=["w"])):
        with pytest.raises(ValueError, match="partial"):
            range_api.decode(spark.createDataFrame([(bad,)], "body string"), "s", METRIC, "pod_id", 60)
    ids = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string").select(range_api.series_id("x", "y")).distinct()
    assert ids.count() == 2
    odd = json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"pod_id": "p"}, "values": [[1, "many"]]}]}})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        range_api.decode(spark.createDataFrame([(odd,)], "body string"), "s", METRIC, "pod_id", 60).collect()
    with pytest.raises(ValueError, match="lacks the label"):
        range_api.decode(spark.createDataFrame([(answer(),)], "body string"), "s", METRIC, "other", 60)


def test_export_and_internal_flow(spark, tmp_path):
    def transport(url, authorization):
        import urllib.parse

        q = urllib.parse.parse_qs(urllib.parse.urlparse(url).query)
        a, b = float(q["start"][0]), float(q["end"][0])
        points = [[a + 10 * i, str(1 + i % 3 + 50 * (a + 10 * i >= 1500))] for i in range(int((b - a) // 10) + 1)]
        return json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"pod_id": "p1"}, "values": points}]}})

    config = ANALYSIS | {"metric": {"enabled": True, "step_seconds": 10, "chunk_seconds": 300, "systems": [{"system_id": "s", "match_labels": {"job": "j"}}], "metrics": [METRIC | {"cadence_seconds": 10}]}}
    runtime = RuntimeSettings(api_url="http://none")
    ranked = flows.run_internal(spark, config, tmp_path / "run", runtime, 1200, 0, 1800, transport=transport)
    assert {r["method"]: r["rank"] for r in ranked.collect()}["mad"] == 1
    assert spark.read.parquet(str(tmp_path / "run/raw_responses.parquet")).where("url LIKE '%deny_partial_response=1%'").count() == 7
    assert flows.run_internal(spark, config, tmp_path / "eda", runtime, 1200, 0, 1800, eda_only=True, transport=transport) is None
    with pytest.raises(ValueError, match="more than 100 rows"):
        flows.run_internal(spark, config | {"analysis": {**ANALYSIS["analysis"], "max_rows": 100}}, tmp_path / "much", runtime, 1200, 0, 1800, transport=transport)
    with pytest.raises(ValueError, match="reserved"):
        flows.run_internal(spark, {"trace": {"enabled": True}}, tmp_path / "x", runtime, 0)
    with pytest.raises(ValueError, match="no source"):
        flows.run_internal(spark, {}, tmp_path / "x", runtime, 0)


def test_range_source_reads_each_chunk_as_a_partition(spark):
    def transport(url, authorization):
        assert authorization == "Bearer x"
        name = "b" if "%7B__name__" in url or "beta" in url else "a"
        return json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"pod_id": name, "zone": 'z"1'}, "values": [[0, "1"], [10, "2"]]}]}})

    config = {"step_seconds": 10, "chunk_seconds": 300, "systems": [{"system_id": s, "match_labels": {"job": s}} for s in ("s1", "s2")], "metrics": [METRIC, METRIC | {"name": "beta", "kind": "counter"}]}
    rows = range_api.export(spark, config, "http://none", 0, 900, "Bearer x", transport)
    asked, specs = range_api.requests(config, "http://none", 0, 900)
    assert len(specs) == 4 and len(asked) == 16
    options = {"api_url": "http://none", "start": "0", "end": "900", "config": json.dumps(config), "token": "Bearer x"}
    source = spark.read.format("metric_range").options(**options).load()
    assert source.rdd.getNumPartitions() == 16 and source.select("url").distinct().count() == 16
    assert {(r["system_id"], r["metric"], r["kind"], r["entity_id"], r["count"]) for r in rows.groupBy("system_id", "metric", "kind", "entity_id").count().collect()} == {
        (s, m, k, e, 8) for s in ("s1", "s2") for m, k, e in (("cpu", "gauge", "a"), ("beta", "counter", "b"))
    }
    assert {r["dimensions"] for r in rows.collect()} == {'{"rack":"","zone":"z\\"1"}'}
    for body, why in ((answer(isPartial=True), "partial"), ("no json", "failed"), (answer(data={"resultType": "matrix", "result": [{"metric": {}, "values": []}]}), "lacks the label")):
        with pytest.raises(Exception, match=why):
            range_api.export(spark, config, "http://none", 0, 900, None, lambda url, token, body=body: body)


def test_settings_and_cli(tmp_path, monkeypatch):
    for bad in ({"window_seconds": 0}, {"min_reference_points": 4}, {"min_coverage_ratio": 0}, {"max_rows": 0}, {"forest_trees": 0}, {"methods": ["odd"]}, {"methods": []}):
        with pytest.raises(ValueError):
            AnalysisSettings(**bad)
    env = RuntimeSettings.from_env({"RCA_DATA_ROOT": "~/x", "RCA_VM_AUTHORIZATION": "hidden"})
    assert env.data_root == Path.home() / "x" and "hidden" not in repr(env)
    with pytest.raises(SystemExit, match="reference-end"):
        cli.check(cli.parser().parse_args(["internal", "--config", "c", "--output", "o"]))
    with pytest.raises(SystemExit, match="doesn't take"):
        cli.check(cli.parser().parse_args(["rcaeval", "--config", "c", "--output", "o", "--start", "1"]))
    with pytest.raises(ValueError):
        write_json(tmp_path / "x.json", {"v": float("nan")})
    assert not (tmp_path / "x.json").exists()


def test_streaming_windows_match_batch(spark, tmp_path):
    from faultlens.operators import windowing
    from faultlens.schemas import METRIC as SCHEMA
    from faultlens.streaming import windows

    records = [(float(t), float(t % 7), "s", "e", "x", "m", "gauge", "u", 10.0, "{}", None) for t in range(0, 600, 10)]
    spark.createDataFrame(records, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = windows.gauge_means(stream, 60, delay="0 seconds").writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["window_end"]: r["value"] for r in spark.table("w").collect()}
    batch = {r["window_end"]: r["value"] for r in windowing.resample(spark.createDataFrame(records, SCHEMA), 60).collect()}
    assert len(got) >= 9 and all(batch[k] == pytest.approx(v) for k, v in got.items())
