"""The driver's tables as canonical frames, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread

DAY = 86400
#: End of the reference: the first twenty days of events.
REFERENCE_END = 1704067200 + 20 * DAY
CADENCE = 43200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def series_id() -> Column:
    return F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string"))


def metric(events: DataFrame, name: str, kind: str, unit: str, value: Column) -> DataFrame:
    return events.select(
        seconds().alias("timestamp"), value.cast("double").alias("value"), F.lit("shop").alias("system_id"), F.col("event_type").alias("entity_id"), series_id().alias("series_id"),
        F.lit(name).alias("metric"), F.lit(kind).alias("kind"), F.lit(unit).alias("unit"), F.lit(CADENCE).alias("cadence_seconds"), F.lit("{}").alias("dimensions"),
    )


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values; every seventh is missing."""
    return metric(table(spark, sf_dir, "events"), "value", "gauge", "unit", F.when(F.col("event_id") % 7 != 0, F.col("value")))


GAUGE = """g AS (SELECT epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 7 <> 0 THEN value END AS v, 'shop' AS system_id, event_type AS entity_id,
  event_type || '-' || CAST(user_id % 3 AS VARCHAR) AS series_id, 'value' AS metric, 'gauge' AS kind, 'unit' AS unit, CAST(43200 AS DOUBLE) AS cadence, '{}' AS dimensions, event_id FROM events)"""


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running cents of a series, which start anew at 500,000."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("event_type", F.col("user_id") % 3).orderBy("ts", "event_id")
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).over(w) % 500_000
    return metric(events.withColumn("cents", cents), "cents", "counter", "cent", F.col("cents"))


COUNTER = """c AS (SELECT epoch_us(ts) / 1e6 AS t, CAST(CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) AS BIGINT) % 500000 AS DOUBLE) AS v,
  'shop' AS system_id, event_type AS entity_id, event_type || '-' || CAST(user_id % 3 AS VARCHAR) AS series_id, 'cents' AS metric, 'counter' AS kind, 'cent' AS unit,
  CAST(43200 AS DOUBLE) AS cadence, '{}' AS dimensions, event_id FROM events)"""


def end_sql(t: str, w: int = DAY) -> str:
    return f"((CAST(floor({t} / {w}.0) AS BIGINT) + 1) * {w})"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of the gauge."""
    from ..operators.windowing import resample

    return resample(gauge(spark, sf_dir), DAY, 0.8)


def thinned(features: DataFrame) -> DataFrame:
    """``features`` with gaps for the grid to fill: one day in six of each series is absent."""
    return features.where((F.col("window_end") / DAY + F.length("entity_id")) % 6 != 0)


MEANS = f"""m AS (SELECT system_id, entity_id, series_id, metric AS feature_name, dimensions, {end_sql('t')} AS window_end, CASE WHEN count(v) / greatest(1, 86400 / max(cadence)) >= 0.8 THEN avg(v) END AS value
  FROM g GROUP BY ALL)"""
FEATURES = f"{GAUGE}, {MEANS}, f AS (SELECT * FROM m)"
THINNED = f"{GAUGE}, {MEANS}, f AS (SELECT * FROM m WHERE (window_end // 86400 + length(entity_id)) % 6 <> 0)"
KEY = "system_id, entity_id, series_id, feature_name, dimensions"


def grid_sql(within: str) -> str:
    """The dense grid of f."""
    return f"""b AS (SELECT {within}, min(window_end) AS lo, max(window_end) AS hi FROM f GROUP BY ALL),
k AS (SELECT DISTINCT {KEY} FROM f), x AS (SELECT k.*, unnest(range(lo, hi + 1, 86400)) AS window_end FROM k JOIN b USING ({within})),
grid AS (SELECT x.*, f.value FROM x LEFT JOIN f USING ({KEY}, window_end))"""


GRID = f"{FEATURES}, {grid_sql('system_id, entity_id')}"
ELIGIBLE = f"""{GRID}, el AS (SELECT {KEY}, count(value) FILTER (WHERE window_end <= {REFERENCE_END}) AS reference_count, count(*) FILTER (WHERE window_end <= {REFERENCE_END}) AS reference_windows,
  count(*) FILTER (WHERE window_end > {REFERENCE_END}) AS current_windows, count(value) FILTER (WHERE window_end > {REFERENCE_END}) AS current_count,
  quantile_cont(value, 0.5) FILTER (WHERE window_end <= {REFERENCE_END}) AS reference_median, quantile_cont(value, 0.95) FILTER (WHERE window_end <= {REFERENCE_END}) AS reference_p95
  FROM grid GROUP BY ALL), el2 AS (SELECT *, reference_count >= 5 AND reference_count >= 0.4 * reference_windows AS eligible FROM el)"""
SCORES = f"""{ELIGIBLE}, fi AS (SELECT grid.*, reference_median AS med, coalesce(value, reference_median) AS x FROM grid JOIN el2 USING ({KEY}) WHERE eligible),
mo AS (SELECT {KEY}, any_value(med) AS med, quantile_cont(abs(x - med), 0.5) AS mad, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
  greatest(abs(any_value(med)) * 1e-6, 1e-9) AS least FROM fi WHERE window_end <= {REFERENCE_END} GROUP BY ALL),
w AS (SELECT {KEY}, window_end, value, mo.med, mad, mean, std, q1, q3, least FROM fi JOIN mo USING ({KEY}) WHERE window_end > {REFERENCE_END} AND value IS NOT NULL),
sc AS (SELECT {KEY}, window_end, value, 'mad' AS method, abs(value - med) / greatest(1.4826 * mad, least) AS score FROM w
  UNION ALL SELECT {KEY}, window_end, value, 'nsigma', abs(value - mean) / greatest(std, least) FROM w
  UNION ALL SELECT {KEY}, window_end, value, 'iqr', greatest(q1 - value, value - q3, 0) / greatest(q3 - q1, least) FROM w),
pk AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, method ORDER BY score DESC, window_end) AS i FROM sc),
ev AS (SELECT {KEY}, method, score, window_end AS peak_window_end, value AS peak_value, reference_median, reference_p95, reference_count, current_count,
  feature_name || '|' || series_id || '|' || dimensions AS feature FROM pk JOIN el2 USING ({KEY}) WHERE i = 1)"""
MIN_POINTS, MIN_COVERAGE = 5, 0.4


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windowing import dense_grid

    return dense_grid(features(spark, sf_dir), DAY)


def counts(spark: SparkSession, sf_dir: str, halves: bool = False) -> DataFrame:
    """Feature rows: events of a type by day, as one entity; with ``halves`` of even and odd users, as two dimensions of it."""
    from ..functions.numeric import window_end

    dimensions = F.concat(F.lit('{"half":"'), (F.col("user_id") % 2).cast("string"), F.lit('"}')) if halves else F.lit("{}")
    rows = table(spark, sf_dir, "events").groupBy("event_type", dimensions.alias("dimensions"), window_end(seconds(), DAY).alias("window_end")).agg(F.count("*").cast("double").alias("value"))
    return rows.select(
        F.lit("shop").alias("system_id"), F.lit("site").alias("entity_id"), F.col("event_type").alias("series_id"), F.col("event_type").alias("feature_name"),
        "dimensions", "window_end", "value",
    )


def counts_sql(dimensions: str) -> str:
    return f"""f AS (SELECT 'shop' AS system_id, 'site' AS entity_id, event_type AS series_id, event_type AS feature_name, dimensions, window_end, CAST(n AS DOUBLE) AS value
  FROM (SELECT event_type, {dimensions} AS dimensions, {end_sql('epoch_us(ts) / 1e6')} AS window_end, count(*) AS n FROM events GROUP BY ALL))"""


COUNTS = counts_sql("'{}'")
HALVES = counts_sql("""'{"half":"' || CAST(user_id % 2 AS VARCHAR) || '"}'""")
HALF_GRID = f"{HALVES}, {grid_sql('system_id, entity_id, dimensions')}"
FIELDS = ["click", "error", "purchase", "signup", "view"]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of two lines: a logger line for the event and, for every third, a raw record or a write marker."""
    e = spread(table(spark, sf_dir, "events"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_id") % 11 == 0, "WARN").otherwise("INFO")
    head = F.concat(stamp, F.lit(" app."), F.col("event_type"), F.lit(" ["), level, F.lit("] [u"), F.col("user_id").cast("string"), F.lit("] Topic: t"), (F.col("event_id") % 5).cast("string"), F.lit(", createDate: "), F.date_format((F.col("ts").cast("timestamp") - F.expr("INTERVAL 9 MILLISECONDS")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    raw = F.concat(F.lit("CdrUtils.toRawCdr: id"), (F.col("event_id") % 40).cast("string"), F.lit(";" + "a;" * 8), (F.col("event_id") % 100).cast("string"), F.lit(";b" * 12))
    write = F.concat(F.lit("Write cdr service id: 700000"), (F.col("event_id") % 4 + 1).cast("string"), F.lit(" to file : /out/f"), F.col("event_id").cast("string"))
    third = F.col("event_id") % 3
    tail = F.when(third == 0, F.concat(F.lit("\n"), raw, F.lit("\n"), write)).when(third == 1, F.lit("\n  \njob CustHis_Rollback done")).otherwise("\nplain words")
    return e.select(
        seconds().alias("timestamp"), F.concat(head, tail).alias("text"), F.lit("shop").alias("system_id"), F.col("event_type").alias("entity_id"), F.lit("app.csv").alias("source_file"),
        F.col("event_id").alias("source_record"), F.lit("UTC").alias("source_timezone"), F.when(F.col("event_id") % 6 == 0, "7000003").otherwise("").alias("expected_cdr_service_id"),
    )


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
LOGS = rf"""lg AS (SELECT epoch_us(ts) / 1e6 AS t, event_id, event_type AS entity_id, CASE WHEN event_id % 6 = 0 THEN '7000003' ELSE '' END AS expected,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 11 = 0 THEN 'WARN' ELSE 'INFO' END AS lvl,
  {_STAMP.format('ts')} || ' app.' || event_type || ' [' || (CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 11 = 0 THEN 'WARN' ELSE 'INFO' END) || '] [u' || user_id || '] Topic: t' || (event_id % 5) ||
    ', createDate: ' || {_STAMP.format('ts - INTERVAL 9 MILLISECONDS')} AS head,
  CASE WHEN event_id % 3 = 0 THEN chr(10) || 'CdrUtils.toRawCdr: id' || (event_id % 40) || ';' || repeat('a;', 8) || (event_id % 100) || repeat(';b', 12) || chr(10) ||
      'Write cdr service id: 700000' || (event_id % 4 + 1) || ' to file : /out/f' || event_id
    WHEN event_id % 3 = 1 THEN chr(10) || '  ' || chr(10) || 'job CustHis_Rollback done' ELSE chr(10) || 'plain words' END AS tail FROM events),
ln AS (SELECT lg.*, unnest(string_split(head || tail, chr(10))) AS message, unnest(range(1, len(string_split(head || tail, chr(10))) + 1)) AS line_number FROM lg),
pa AS (SELECT *, regexp_matches(message, '^\d{{4}}-\d\d-\d\d ') AS is_log, contains(message, 'CdrUtils.toRawCdr:') AS is_raw, contains(message, 'Write cdr service id:') AS is_write,
  contains(message, 'CustHis_Rollback') AS is_roll, '700000' || (event_id % 4 + 1) AS service FROM ln WHERE trim(message) <> ''),
pe AS (SELECT *, CASE WHEN is_raw THEN 'cdr_raw' WHEN is_write THEN 'cdr_write' WHEN is_roll THEN 'custhis_rollback' WHEN is_log THEN 'application_log' ELSE 'unparsed' END AS family,
  CASE WHEN is_raw AND expected <> '' AND expected <> service THEN 'cdr_service_mismatch' WHEN is_raw AND service = '7000002' THEN 'cdr_schema_unknown' WHEN is_raw OR is_write OR is_roll OR is_log THEN 'parsed' ELSE 'unparsed' END AS parse_status,
  CASE WHEN is_log THEN lvl ELSE '' END AS level FROM pa)"""
