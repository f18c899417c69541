"""The one scan of all cases against the reader of single files, and record numbers in split files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from faultlens import flows
from faultlens.settings import AnalysisSettings
from faultlens.sources import case_scan, corpus, records


def written(folder, name, lines):
    path = folder / name / "1" / "simple_data.csv"
    path.parent.mkdir(parents=True)
    path.write_text("".join(f"{line}\n" for line in lines))
    return corpus.Case(f"{name}/1", "RE1-SS", "SS", "cpu", "own", 1030.0, str(path), "csv")


def some_value(rng):
    return rng.choice([f"{rng.uniform(-5, 5):.3f}", str(rng.randint(0, 9)), "", "NA", "null", "N/A", "nan", "inf", "-Infinity", "1e3", " 7 "])


def some_case(rng, k):
    """Lines of a file of one of several layouts, and its options."""
    n, own, layout = rng.randint(8, 30), {}, k % 6
    times = [1000 + 10 * i for i in range(n)]
    metrics = [f"svc{i}_m{k}" for i in range(rng.randint(1, 4))]
    if layout == 0:  # one clock, anywhere, and junk columns
        at = rng.randint(0, len(metrics))
        names = [*metrics[:at], "time", *metrics[at:], "Unnamed: 9", ""]
        rows = [[str(t) if x == "time" else some_value(rng) for x in names] for t in times]
    elif layout in (1, 2):  # two or three clocks that agree, with holes
        names = ["time", *metrics, *["time"] * layout]
        rows = []
        for i, t in enumerate(times):
            hole = rng.randrange(layout + 1) if i % 4 == 1 else None
            seen = -1
            row = []
            for x in names:
                seen += x == "time"
                row.append((rng.choice(["", "NaN"]) if seen == hole else str(t)) if x == "time" else some_value(rng))
            rows.append(row)
    elif layout == 3:  # rows without a time
        names = ["time", *metrics]
        rows = [[str(t) if i % 5 else "", *(some_value(rng) for _ in metrics)] for i, t in enumerate(times, 1)]
        own["missing_time_policy"] = "quarantine"
    else:  # blocks with clocks of their own
        more = [f"db_m{k}", f"mq_m{k}"]
        names = ["time", *metrics, "time", *more]
        rows = [[str(t), *(some_value(rng) for _ in metrics), str(t + 5 * (k % 2)) if i % 6 else "", *(some_value(rng) if i % 6 else "" for _ in more)] for i, t in enumerate(times, 1)]
        if layout == 5:
            rows[2][0] = ""  # values without their own clock
            own["missing_time_policy"] = "quarantine"
        own |= {"duplicate_time_policy": "align_blocks", "expected_time_columns": [1, len(metrics) + 2]}
    return [",".join(names), *(",".join(f'"{c}"' if rng.random() < 0.05 else c for c in r) for r in rows)], own


BAD = {
    "no time column": ["a_m,b_m", "1,2"], "duplicate metric names": ["time,a_m,a_m", "1000,1,2"], "no metric columns": ["time", "1000"], "no rows": ["time,a_m"],
    "infinite": ["time,a_m", "1000,1", "inf,2", "1060,2"], "no numbers": ["time,a_m", "1000,1", "1010,x", "1060,2"], "duplicate timestamps": ["time,a_m", "1000,1", "1000,2", "1060,3"],
    "without a time": ["time,a_m", "1000,1", ",2", "1060,3"], "seconds": ["time,a_m", "1000,1", "1688888888123,4"], "never overlap": ["time,a_m,time,time", "1000,1,1000,", "1060,2,1060,", ",3,,1070"],
    "clocks differ": ["time,a_m,time", "1000,1,1000", "1060,2,1061"], "outside the data": ["time,a_m", "1000,1", "1010,2"],
}


def test_one_scan_equals_single_files(spark, tmp_path):
    rng = random.Random(61)
    found, overrides, single, quality, lost = [], {}, {}, {}, {}
    for k in range(60):
        lines, own = some_case(rng, k)
        case = written(tmp_path, f"c{k}", lines)
        found.append(case)
        overrides[case.case] = {x: own[x] for x in own if x != "missing_time_policy"}
        overrides[case.case]["duplicate_time_policy"] = own.get("duplicate_time_policy", "strict")
    for name, lines in BAD.items():
        found.append(written(tmp_path, name.replace(" ", "_"), lines))
    config = {"missing_time_policy": "quarantine", "case_overrides": overrides}
    strict = [c for c in found if c.case == "without_a_time/1"]
    assert "without a time" in case_scan.scan(spark, strict, {}).report.first()["error"]
    jobs = {}
    for some in (found[:6], found):
        spark.sparkContext.setJobGroup(f"scan {len(some)}", "scan")
        got = case_scan.scan(spark, some, config)
        report = {r["case"]: r for r in got.report.collect()}
        rows = {(r["case"], r["time"], r["metric"]): r["value"] for r in got.long.collect()}
        rejected = got.rejected.collect()
        jobs[len(some)] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scan {len(some)}"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs[len(found)] <= jobs[6] + 2  # twelve times as many cases
    for case in found[:60:3]:
        frame, q, bad = corpus.read_metrics(spark, case.metric_file, **corpus.read_options(config, case.case))
        want = {(case.case, r["time"], m): r[m] for r in frame.collect() for m in frame.columns if m != "time"}
        # In blocks, the scan has only the values of a time's own blocks; the joined frame fills up with NULL.
        own = {x: v for x, v in rows.items() if x[0] == case.case}
        assert {x: v for x, v in own.items() if v is not None} == {x: v for x, v in want.items() if v is not None} and set(own) <= set(want)
        r = report[case.case]
        assert r["error"] is None and [r[x] for x in q] == list(q.values())
        assert sorted((x["source_record_number"], x["clock_occurrence"]) for x in rejected if x["case"] == case.case) == sorted((x["source_record_number"], x["clock_occurrence"]) for x in (bad.collect() if bad else []))
    for name in BAD:
        if name != "without a time":
            assert name in (report[f"{name.replace(' ', '_')}/1"]["error"] or ""), name
    assert sum(r["error"] is not None for r in report.values()) == len(BAD) - 1
    assert {x[0] for x in rows} == {c for c, r in report.items() if r["error"] is None}


@pytest.fixture
def split_at_64k(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_record_numbers_in_split_files(spark, tmp_path, split_at_64k):
    (tmp_path / "wide.csv").write_text("time,gc_ms\n" + "".join(f"{k if k not in (59_000, 100) else ''},{k}\n" + "\n" * (k % 1000 == 0) for k in range(60_000)))
    lines = records.csv_lines(spark, [str(tmp_path / "wide.csv")])
    assert lines.rdd.getNumPartitions() > 5
    assert lines.agg(F.min("number"), F.max("number"), F.count_distinct("number"), F.count_if(F.expr("number > 1 AND split(value, ',')[1] <> number - 2"))).first()[:] == (1, 60_001, 60_001, 0)
    _, _, rejected = corpus.read_metrics(spark, str(tmp_path / "wide.csv"), missing_time_policy="quarantine")
    assert sorted((r["source_record_number"], r["gc_ms"]) for r in rejected.collect()) == [(101, 100.0), (59_001, 59_000.0)]


def test_records_with_line_breaks_in_split_files(spark, tmp_path, split_at_64k):
    rng = random.Random(62)
    wanted = [(str(k), rng.choice(["plain", 'a "quote", too', "a\nb\n\nc", "", "x,y", "\r\nodd", '"', "\n" * 50])) for k in range(20_000)]
    with open(tmp_path / "log.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        for k, row in enumerate([("id", "message"), *wanted]):
            out.writerow(row)
            f.write("\n" * (k % 500 == 0))
    found = records.csv_records(spark, str(tmp_path / "log.csv"))
    parsed = found.select("number", F.from_csv("value", "id string, message string", {"escape": '"', "emptyValue": "", "nullValue": "\u0001"}).alias("r")).select("number", "r.*")
    got = [(r["number"], r["id"], r["message"] or "") for r in parsed.orderBy("number").collect()]
    assert got == [(k, *r) for k, r in enumerate([("id", "message"), *wanted], 1)]


def test_flows_read_all_cases_at_once(spark, tmp_path):
    root = tmp_path / "data" / "RE1-SS"
    for service, extra in (("carts", []), ("user", [",7,1"]), ("orders", ["oops,1,1"])):
        folder = root / f"{service}_cpu" / "1"
        folder.mkdir(parents=True)
        (folder / "inject_time.txt").write_text("9000")
        (folder / "simple_data.csv").write_text("\n".join([f"time,{service}_cpu,front_mem", *[f"{t},{t % 7},{t % 5}" for t in range(8000, 10_000, 20)], *extra]) + "\n")
    expected = {"RE1-SS": ["carts_cpu/1", "orders_cpu/1", "user_cpu/1"]}
    config = {"rcaeval_input": {"missing_time_policy": "quarantine"}}
    rows = flows.preflight(spark, config, tmp_path / "pre", tmp_path / "data", expected)
    assert [(r["case"], r["status"], r["rejected_rows"]) for r in rows] == [("carts_cpu/1", "READY", 0), ("orders_cpu/1", "ERROR", 1), ("user_cpu/1", "READY_WITH_QUARANTINE", 1)]
    assert "no numbers" in rows[1]["error"]
    with open(tmp_path / "pre" / "preflight.csv", newline="") as f:
        assert [r["case"] for r in csv.DictReader(f)] == [r["case"] for r in rows]
    found, _ = corpus.inventory(spark, tmp_path / "data", expected)
    (tmp_path / "run").mkdir()
    with pytest.raises(ValueError, match="RE1-SS orders_cpu/1: 1 values that are no numbers"):
        flows.case_features(spark, found, config, AnalysisSettings(window_seconds=60), tmp_path / "run")
    features, quality = flows.case_features(spark, [c for c in found if c.case != "orders_cpu/1"], config, AnalysisSettings(window_seconds=60), tmp_path / "run")
    assert [(q["case"], q["rows"], q["rejected_rows"]) for q in quality] == [("carts_cpu/1", 100, 0), ("user_cpu/1", 100, 1)]
    kept = features.collect()
    assert {(r["system_id"], r["entity_id"]) for r in kept} == {("RE1-SS/carts_cpu/1", "carts"), ("RE1-SS/carts_cpu/1", "front"), ("RE1-SS/user_cpu/1", "user"), ("RE1-SS/user_cpu/1", "front")}
    assert {r["boundary"] for r in kept} == {9000} and all(not 9000 < r["window_end"] <= 9060 and r["window_end"] <= 9980 for r in kept)
    lost = spark.read.options(header=True, escape='"').csv(str(tmp_path / "run" / "quarantine.csv")).collect()
    assert [(r["case"], r["source_record_number"], r["reason"], r["line"]) for r in lost] == [("user_cpu/1", "101", "missing time", ",7,1")]
