import pytest

from faultlens.operators import logs
from faultlens.schemas import LOG
from faultlens.sources import files

HEAD = "2027-03-11 19:42:07.318 a.b.Writer [INFO] [main] MSISDN_CHECK: 84, sessionId=[0012] createDate: 2027-03-11 19:42:07.306"
RAW = "CdrUtils.toRawCdr: " + ";".join(["0007"] + ["x"] * 8 + ["12.5"] + ["y"] * 12)
WRITE = "Write cdr service id: 7000003 to file : /data/out"


def record(spark, *texts, expected="", t=60.0, zone="Asia/Ho_Chi_Minh"):
    return spark.createDataFrame([(t, x, "s", "e", "f.csv", i + 1, zone, expected) for i, x in enumerate(texts)], LOG)


def events(spark, *texts, **more):
    return logs.parse(record(spark, *texts, **more)).orderBy("source_record", "line_number").collect()


def test_families_and_fields(spark):
    raw, write, head = events(spark, f"{RAW}\n{WRITE}\n{HEAD}")
    assert [e["family"] for e in (raw, write, head)] == ["cdr_raw", "cdr_write", "application_log"]
    assert (raw["call_id"], raw["resource_charge1"], raw["cdr_field_count"], raw["cdr_service_id"]) == ("0007", 12.5, 22, "7000003")
    assert (head["session_id"], head["thread"], head["level"]) == ("0012", "main", "INFO")
    assert head["logger_create_delay_ms"] == pytest.approx(12, abs=0.1)
    assert write["output_path"] == "/data/out"


def test_statuses(spark):
    longer = RAW + ";z"
    assert events(spark, f"{longer}\n{WRITE}")[0]["parse_status"] == "cdr_field_count_mismatch"
    assert events(spark, f"{RAW}\n{WRITE}", expected="7000004")[0]["parse_status"] == "cdr_service_mismatch"
    assert events(spark, RAW)[0]["parse_status"] == "cdr_schema_unknown"
    late = HEAD.replace("07.306", "08.100")
    assert events(spark, late)[0]["logger_create_delay_ms"] < 0
    assert events(spark, HEAD.replace("2027-03-11 19:42:07.318", "2027-13-11 19:42:07.318"))[0]["parse_status"] == "invalid_event_time"
    assert [e["family"] for e in events(spark, "who knows\n\nCustHis_Rollback")] == ["unparsed", "custhis_rollback"]
    assert [e["message"] for e in events(spark, "")] == [""]


def test_budgets(spark):
    with pytest.raises(ValueError, match="budget"):
        logs.parse(record(spark, "a\nb"), logs.ParserConfig(max_events=1))
    with pytest.raises(ValueError, match="budget"):
        logs.parse(record(spark, "abc"), logs.ParserConfig(max_message_characters=2))


def test_silent_windows_stay_absent(spark):
    rows = record(spark, HEAD, t=30.0).union(record(spark, HEAD + "\n" + RAW, t=500.0))
    got = logs.message_features(logs.parse(rows), 60)
    assert {r["window_end"] for r in got.select("window_end").distinct().collect()} == {60, 540}
    at = {(r["window_end"], r["feature_name"]): r["value"] for r in got.collect()}
    assert at[(540, "log_event_count")] == 2 and at[(540, "log_record_count")] == 1 and at[(540, "cdr_schema_mismatch_count")] == 1
    assert at[(60, "cdr_charge_coverage_ratio")] is None and len({k[1] for k in at}) == 21
    basic = {r["feature_name"]: r["value"] for r in logs.basic_features(rows, 600, "writer").collect()}
    assert basic == {"log_count": 2, "log_error_count": 2, "log_error_ratio": 1}


def test_log_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿@timestamp,message\n"Mar 11, 2027 @ 19:42:07.306","one\ntwo ""x"""\n2027-03-12T07:30:00,\n', encoding="utf-8")
    source = {"file": "a.csv", "system_id": "s", "timestamp_column": "@timestamp", "text_column": "message"}
    rows = files.log_csv(spark, tmp_path, [source]).orderBy("source_record").collect()
    assert [r["source_record"] for r in rows] == [1, 2] and rows[0]["text"] == 'one\ntwo "x"' and rows[1]["text"] == ""
    assert rows[1]["timestamp"] == 1804811400.0  # 07:30 in UTC+7
    with pytest.raises(ValueError, match="outside"):
        files.log_csv(spark, tmp_path, [source | {"file": "../b.csv"}])
    with pytest.raises(ValueError, match="no column"):
        files.log_csv(spark, tmp_path, [source | {"text_column": "body"}])
    with pytest.raises(ValueError, match="different names"):
        files.log_csv(spark, tmp_path, [source, source])
