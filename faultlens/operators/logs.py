"""Log events and their windowed features.

Each physical line of a message becomes one event; families and statuses follow from a
chain of regular expressions, all within the row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, window_end
from ..functions.timeparse import epoch_seconds

# The patterns of the lines, and the families.
EVENT_TIME = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[.,]\d+"
LOGGER = r"^(" + EVENT_TIME + r")\s+(\S+)\s+\[(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\](?:\s+\[([^\]]*)\])?"
WRITE = r"(?i)Write cdr service id:\s*(\d+)\s+to file\s*:\s*(\S+)"
RAW_RECORD = r"CdrUtils[.]toRawCdr:\s*(.*)$"
ROLLBACK = "CustHis_Rollback"
KEYS = {
    "msisdn_check": r"MSISDN_CHECK:\s*([^,\s]+)",
    "telecom_service_id": r"TELECOMSERVICE_ID:\s*(\d+)",
    "file_name_id": r"FILE_NAME_ID:\s*(\d+)",
    "session_id": r"sessionId=\[([^\]]*)\]",
    "msisdn": r"msisdn=\[([^\]]*)\]",
    "topic": r"Topic:\s*([^,]+)",
    "create_date": r"createDate:\s*(" + EVENT_TIME + r")",
}
FAMILIES = ("cdr_raw", "cdr_write", "custhis_rollback", "application_log", "unparsed")
# The 22 fields of a raw record, and the services that write them. One template names the last field otherwise, one the 17th.
RECORD_FIELDS = (
    "CALL_ID CONTRACT_ID SUB_ID MSISDN EVENT_ID BILL_CYCLE STA_DATETIME END_DATETIME PRICE_PLAN_ID RESOURCE_CHARGE1 DISCOUNT PAID_NUMBER PAID SEQ "
    "PAID_SUB_ID PAID_CONTRACT_ID TelecomServiceID EVENT_BEGIN_TIME CHARGING_CALL_ID ACM_DATE BILLING_NBR SERVICE_ID"
).split()
RECORD_SERVICES = {
    "7000003": {},
    "7000004": {},
    "7000001": {"SERVICE_ID": "SERVICE_TYPE"},
    "7000006": {"TelecomServiceID": "TELECOM_SERVICE_ID"},
    "7000005": {},
}
EVENT_KEYS = ["system_id", "entity_id"]


def shipped_schemas() -> dict[str, list[str]]:
    return {service: [other.get(f, f) for f in RECORD_FIELDS] for service, other in RECORD_SERVICES.items()}


@dataclass(frozen=True)
class ParserConfig:
    schemas: dict[str, list[str]] = field(default_factory=shipped_schemas)
    max_events: int = 1_000_000
    max_message_characters: int = 200_000

    @classmethod
    def of(cls, config: dict) -> ParserConfig:
        if config.get("version") != 1:
            raise ValueError("a log parser configuration has version 1")
        schemas = {k: v["fields"] for k, v in config.get("cdr_schemas", {}).items()}
        return cls(schemas, config.get("max_events", 1_000_000), config.get("max_message_characters", 200_000))


def unicode_classes(pattern: str) -> str:
    return "(?U)" + pattern


def lines_of(records: DataFrame) -> DataFrame:
    """One row a line (line_number from 1, message); blank lines go unless the whole text is blank."""
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, r"\R|[\x1c-\x1e]", -1)
    parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    blank = lambda c: ~c.rlike(unicode_classes(r"\S"))
    out = records.select("*", F.posexplode(parts).alias("__i", "message"))
    return out.where(~blank(F.col("message")) | blank(text)).withColumn("line_number", F.col("__i") + 1).drop("__i")


def key_columns(line: Column) -> dict[str, Column]:
    return {k: F.trim(F.regexp_extract(line, unicode_classes(p), 1)) for k, p in KEYS.items()}


def parse(records: DataFrame, config: ParserConfig | None = None) -> DataFrame:
    """Canonical log records to events; budgets raise instead of truncating."""
    config = config or ParserConfig()
    if not records.where(F.char_length(F.coalesce("text", F.lit(""))) > config.max_message_characters).isEmpty():
        raise ValueError("a message is longer than the character budget; inspect its source")
    events = parsed_lines(records, config)
    if events.limit(config.max_events + 1).count() > config.max_events:
        raise ValueError("more events than the budget; divide the files")
    return events


def parsed_lines(records: DataFrame, config: ParserConfig) -> DataFrame:
    text, line = F.coalesce("text", F.lit("")), F.col("message")
    services = F.array_distinct(F.regexp_extract_all(text, F.lit(unicode_classes(WRITE)), F.lit(1)))
    rows = lines_of(records.withColumn("__services", services))
    bare = F.trim(line)
    header = lambda g: F.regexp_extract(bare, unicode_classes(LOGGER), g)
    rows = rows.withColumns({"event_time": header(1), "logger": header(2), "level": header(3), "thread": header(4), **key_columns(line)})
    has = lambda c: F.col(c) != ""
    zone = F.coalesce("source_timezone", F.lit("Asia/Ho_Chi_Minh"))
    rows = rows.withColumns({
        "event_timestamp": epoch_seconds(F.col("event_time"), "iso", zone), "create_timestamp": epoch_seconds(F.col("create_date"), "iso", zone),
        "__service": F.regexp_extract(line, unicode_classes(WRITE), 1), "__path": F.regexp_extract(line, unicode_classes(WRITE), 2),
        "__raw": F.when(line.rlike(RAW_RECORD), F.split(F.trim(F.regexp_extract(line, RAW_RECORD, 1)), ";", -1)),
        "__one": F.when(F.size("__services") == 1, F.element_at("__services", 1)).otherwise(""),
    })
    raw = F.col("__raw")
    schemas = F.create_map(*[x for k, names in config.schemas.items() for x in (F.lit(k), F.array(*map(F.lit, names)))]) if config.schemas else F.lit(None).cast("map<string,array<string>>")
    rows = rows.withColumn("__schema", F.try_element_at(schemas, F.col("__one")))
    expected = F.coalesce("expected_cdr_service_id", F.lit(""))
    mismatch = (expected != "") & (F.col("__one") != expected)
    fits = F.coalesce(F.size("__schema") == F.size(raw), F.lit(False)) & F.col("__schema").isNotNull()
    raw_status = F.when(mismatch, "cdr_service_mismatch").when(fits, "parsed").when(F.col("__schema").isNotNull(), "cdr_field_count_mismatch").otherwise("cdr_schema_unknown")
    base = F.when(has("event_time") & F.col("event_timestamp").isNull(), "invalid_event_time").when(has("event_time"), "parsed").otherwise("unparsed")
    base = F.when(line.contains(ROLLBACK) & (base == "unparsed"), "parsed").otherwise(base)
    base = F.when(has("create_date") & F.col("create_timestamp").isNull(), "invalid_create_time").otherwise(base)
    status = F.when(raw.isNotNull(), raw_status).when(has("__service"), "parsed").otherwise(base)
    family = (
        F.when(raw.isNotNull(), "cdr_raw").when(has("__service"), "cdr_write").when(line.contains(ROLLBACK), "custhis_rollback").when(has("event_time"), "application_log").otherwise("unparsed")
    )
    named = F.when(raw.isNotNull() & (status == "parsed"), F.map_from_arrays("__schema", raw))
    value = lambda name: F.try_element_at(named, F.lit(name))
    delay = (F.col("event_timestamp") - F.col("create_timestamp")) * 1000
    out = rows.withColumns({
        "family": family, "parse_status": status, "logger_create_delay_ms": delay, "cdr_field_count": F.size(raw), "cdr_fields": named, "cdr_values": raw,
        "resource_charge1": finite(value("RESOURCE_CHARGE1").try_cast("double")), "call_id": F.coalesce(value("CALL_ID"), F.lit("")),
        "cdr_service_id": F.when(raw.isNotNull() & (status == "parsed"), F.col("__one")).otherwise(F.col("__service")), "output_path": F.col("__path"),
        "template_status": F.when(raw.isNotNull() & (status == "parsed"), "matched_template_candidate").when(raw.isNotNull(), "unconfirmed").otherwise("not_applicable"),
    })
    out = out.withColumn("template_id", F.col("family")).withColumn("cdr_field_count", F.when(F.col("cdr_values").isNotNull(), F.col("cdr_field_count")))
    return out.drop("text", *[c for c in out.columns if c.startswith("__")])


def parse_quality(events: DataFrame) -> DataFrame:
    return events.groupBy("system_id", "family", "parse_status").agg(F.count("*").alias("events"))


def basic_features(records: DataFrame, window_seconds: int, error_pattern: str) -> DataFrame:
    """log_count, log_error_count and log_error_ratio of a system, entity and window, in long form."""
    hit = F.coalesce(F.col("text").rlike("(?i)" + error_pattern), F.lit(False))
    rows = records.withColumn("window_end", window_end(F.col("timestamp"), window_seconds))
    wide = rows.groupBy(*EVENT_KEYS, "window_end").agg(F.count("*").cast("double").alias("log_count"), F.count_if(hit).cast("double").alias("log_error_count"))
    wide = wide.withColumn("log_error_ratio", F.col("log_error_count") / F.col("log_count"))
    return melted(wide, ["log_count", "log_error_count", "log_error_ratio"])


def melted(wide: DataFrame, names: list[str]) -> DataFrame:
    long = wide.unpivot([*EVENT_KEYS, "window_end"], names, "feature_name", "value")
    return long.select(*EVENT_KEYS, F.col("feature_name").alias("series_id"), "feature_name", F.lit("{}").alias("dimensions"), "window_end", "value")


MESSAGE_FEATURES = [
    "log_event_count", "log_record_count", "log_parse_unknown_ratio", "log_level_error_ratio", "log_level_missing_ratio", "log_warning_count",
    "cdr_schema_mismatch_count", "cdr_valid_count", "cdr_duplicate_call_id_ratio", "cdr_charge_observed_count", "cdr_charge_coverage_ratio",
    "cdr_resource_charge1_sum", "cdr_resource_charge1_mean", "log_logger_create_delay_p95_ms", "log_negative_delay_count", "log_delay_observed_count",
    *[f"log_template_{f}_count" for f in FAMILIES],
]


def message_aggregates() -> list[Column]:
    raw = F.col("family") == "cdr_raw"
    valid = raw & (F.col("parse_status") == "parsed")
    charge = F.when(valid, F.col("resource_charge1"))
    known = F.col("level") != ""
    delay = F.col("logger_create_delay_ms")
    ids = F.when(valid & (F.col("call_id") != ""), F.col("call_id"))
    share = lambda c: F.avg(c.cast("double"))
    d = lambda c: c.cast("double")
    found = [
        d(F.count("*")),
        d(F.count_distinct(F.struct("source_file", "source_record"))),
        share(F.col("parse_status") != "parsed"),
        F.try_divide(d(F.count_if(F.col("level").isin("ERROR", "FATAL"))), d(F.count_if(known))),
        share(~known),
        d(F.count_if(F.col("level").isin("WARN", "WARNING"))),
        d(F.count_if(F.col("parse_status").startswith("cdr_"))),
        d(F.count_if(valid)),
        1 - F.try_divide(d(F.count_distinct(ids)), d(F.count(ids))),
        d(F.count(charge)),
        F.try_divide(d(F.count(charge)), d(F.count_if(raw))),
        F.when((F.count(charge) == F.count_if(raw)) & (F.count(charge) > 0), F.sum(charge)),
        F.avg(charge),
        F.percentile(F.when(delay >= 0, delay), F.lit(0.95)),
        d(F.count_if(delay < 0)),
        d(F.count(delay)),
        *[d(F.count_if(F.col("family") == f)) for f in FAMILIES],
    ]
    return [c.alias(n) for c, n in zip(found, MESSAGE_FEATURES, strict=True)]


def message_features(events: DataFrame, window_seconds: int) -> DataFrame:
    """21 features of a system, entity and window, in long form; silent windows stay absent."""
    rows = events.withColumn("window_end", window_end(F.col("timestamp"), window_seconds))
    return melted(rows.groupBy(*EVENT_KEYS, "window_end").agg(*message_aggregates()), MESSAGE_FEATURES)


def log_coverage(records: DataFrame) -> DataFrame:
    return records.groupBy("system_id", "source_file").agg(F.count("*").alias("rows"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))


def log_quality(records: DataFrame) -> DataFrame:
    """Rows, blank messages and exact duplicates of a system; nothing is removed."""
    same = F.count_distinct(F.struct("entity_id", "timestamp", "text"))
    return records.groupBy("system_id").agg(
        F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank_messages"), (F.count("*") - same).alias("exact_duplicates")
    )


def record_counts(records: DataFrame, window_seconds: int) -> DataFrame:
    return records.groupBy("system_id", window_end(F.col("timestamp"), window_seconds).alias("window_end")).agg(F.count("*").alias("records"))


