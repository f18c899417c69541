"""Queries over the driver's tables, each with the SQL that must give the same rows.

Results are rounded to six places, since engines add doubles in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, window_end
from ..functions.timeparse import epoch_seconds
from ..operators import cases, logs, models, plots, profile, ranking, recipes, relate, scoring, validate, windowing
from ..schemas import COHORT, ENTITY, FEATURE_KEY
from ..sources import range_api
from . import frames as fr
from .frames import DAY, REFERENCE_END, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Fences and means of means have one digit more than six where values have two: rounding them there would meet ties.
LONGER = dict.fromkeys(["iqr_lower", "iqr_upper", "mean", "reference_mean", "current_mean", "mean_difference"], 9)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    # Adding zero makes one zero of two.
    return df.select(*[(F.round(c, LONGER.get(c, places)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0 AS {n}" for n in names.split())


KEY = fr.KEY

# Sources and validation


@query(f"WITH {fr.GAUGE} SELECT system_id, entity_id, kind, count(*) AS rows, min(t) AS start, max(t) AS last FROM g GROUP BY ALL")
def metric_scan_budget(spark, d):
    rows = validate.within_budget(fr.gauge(spark, d), 100_000_000, "events")
    return rows.groupBy("system_id", "entity_id", "kind").agg(F.count("*").alias("rows"), F.min("timestamp").alias("start"), F.max("timestamp").alias("last"))


@query(f"""WITH {fr.GAUGE}, x AS (SELECT * FROM g UNION ALL SELECT * REPLACE (CASE WHEN event_id % 100 = 0 THEN v + 1 ELSE v END AS v) FROM g WHERE event_id % 50 = 0)
SELECT system_id, series_id, t AS timestamp, count(*) AS rows, coalesce(min(v) <> max(v) OR (count(v) > 0 AND count(v) < count(*)), FALSE) AS conflict FROM x GROUP BY system_id, series_id, t HAVING count(*) > 1""")
def metric_validate_dups(spark, d):
    events = table(spark, d, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    again = events.where("event_id % 50 = 0")
    more = fr.metric(again, "value", "gauge", "unit", F.when(F.col("event_id") % 100 == 0, value + 1).otherwise(value))
    return validate.duplicates(fr.metric(events, "value", "gauge", "unit", value).union(more))


@query(f"""WITH {fr.GAUGE}, x AS (SELECT *, CASE WHEN event_id % 500 = 0 AND entity_id <> 'view' THEN NULL ELSE unit END AS u FROM g)
SELECT system_id, series_id, count(DISTINCT entity_id) AS entity_id_values, count(DISTINCT metric) AS metric_values, count(DISTINCT kind) AS kind_values, count(DISTINCT coalesce(u, '')) AS unit_values,
count(DISTINCT cadence) AS cadence_seconds_values, count(DISTINCT dimensions) AS dimensions_values FROM x GROUP BY ALL HAVING count(DISTINCT coalesce(u, '')) > 1""")
def series_metadata_conflicts(spark, d):
    events = table(spark, d, "events")
    odd = (F.pmod(F.col("event_id"), F.lit(500)) == 0) & (F.col("event_type") != "view")
    unit = fr.metric(events.where(odd), "value", "gauge", "unit", F.col("value")).withColumn("unit", F.lit(None).cast("string"))
    return validate.metadata_conflicts(fr.metric(events.where(~odd), "value", "gauge", "unit", F.col("value")).unionByName(unit))


@query(f"""WITH {fr.COUNTER}, d AS (SELECT DISTINCT ON (system_id, series_id, t) * FROM c ORDER BY system_id, series_id, t, event_id),
s AS (SELECT *, v - lag(v) OVER w AS dv, t - lag(t) OVER w AS dt FROM c WINDOW w AS (PARTITION BY system_id, series_id ORDER BY t))
SELECT system_id, series_id, count(*) AS samples, count(*) FILTER (WHERE v IS NULL) AS nonfinite, count(*) FILTER (WHERE dv < 0) AS resets, count(*) FILTER (WHERE dt > 86400) AS long_gaps FROM s GROUP BY ALL""")
def counter_resets_gaps(spark, d):
    return validate.sample_quality(fr.counter(spark, d))


@query(f"""WITH {fr.GAUGE} SELECT count(*) FILTER (WHERE v IS NULL) AS missing, count(*) AS rows, count(DISTINCT series_id) AS series FROM g""")
def metric_validate_summary(spark, d):
    clean, quality = validate.validate(fr.gauge(spark, d).dropDuplicates(validate.SAMPLE))
    return clean.agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("rows"), F.count_distinct("series_id").alias("series"))


# Windows


@query(f"WITH {fr.GAUGE}, {fr.MEANS} SELECT {KEY}, window_end, {r('value')} FROM m")
def tumbling_window_mean(spark, d):
    return rounded(windowing.resample(fr.gauge(spark, d), DAY, 0.8))


RATES = f"""{fr.COUNTER}, s AS (SELECT *, v - lag(v) OVER w AS dv, t - lag(t) OVER w AS dt FROM c WINDOW w AS (PARTITION BY system_id, series_id ORDER BY t)),
o AS (SELECT *, CASE WHEN dt > 0 AND dt <= 2 * cadence AND dv >= 0 THEN dv / dt END AS o FROM s),
ra AS (SELECT system_id, entity_id, series_id, metric || '_rate' AS feature_name, dimensions, {fr.end_sql('t')} AS window_end, CASE WHEN count(o) / greatest(1, 86400 / max(cadence)) >= 0.8 THEN avg(o) END AS value FROM o GROUP BY ALL)"""


@query(f"WITH {RATES} SELECT {KEY}, window_end, {r('value')} FROM ra")
def counter_rate(spark, d):
    return rounded(windowing.resample(fr.counter(spark, d), DAY, 0.8))


@query(f"""WITH {fr.COUNTS}, p AS (SELECT system_id, entity_id, dimensions, window_end, max(value) FILTER (WHERE feature_name = 'click') AS a, max(value) FILTER (WHERE feature_name = 'purchase') AS b,
count(*) FILTER (WHERE feature_name = 'click') AS na, count(*) FILTER (WHERE feature_name = 'purchase') AS nb FROM f GROUP BY ALL)
SELECT system_id, entity_id, 'gap' AS series_id, 'gap' AS feature_name, dimensions, window_end, CASE WHEN a > 0 THEN round(abs(a - b) / a, 6) END AS value FROM p WHERE na = 1 AND nb = 1
UNION ALL SELECT {KEY}, window_end, value FROM f""")
def request_response_gap(spark, d):
    rules = [{"name": "gap", "request": "click", "response": "purchase"}]
    return rounded(windowing.request_response(fr.counts(spark, d), rules).select(*FEATURE_KEY, "window_end", "value"))


@query(f"WITH {fr.THINNED}, {fr.grid_sql('system_id, entity_id')} SELECT {KEY}, window_end, {r('value')} FROM grid")
def dense_grid(spark, d):
    return rounded(windowing.dense_grid(fr.thinned(fr.features(spark, d)), DAY))


@query(f"WITH {fr.ELIGIBLE} SELECT {KEY}, reference_count, reference_windows, current_windows, current_count, {r('reference_median reference_p95')}, eligible FROM el2")
def eligibility(spark, d):
    return rounded(scoring.eligibility(fr.grid(spark, d), REFERENCE_END, fr.MIN_POINTS, fr.MIN_COVERAGE))


@query(f"WITH {fr.ELIGIBLE} SELECT system_id, entity_id, count(*) AS features, count(*) FILTER (WHERE eligible) AS eligible, max(current_windows) AS current_windows FROM el2 GROUP BY ALL")
def entity_coverage(spark, d):
    return scoring.coverage(scoring.eligibility(fr.grid(spark, d), REFERENCE_END, fr.MIN_POINTS, fr.MIN_COVERAGE))


@query(f"WITH {fr.FEATURES} SELECT {KEY}, window_end, {r('value')} FROM f WHERE window_end - 86400 >= {REFERENCE_END - 5 * DAY} AND window_end <= {REFERENCE_END + 3 * DAY}")
def interval_trim(spark, d):
    return rounded(windowing.trimmed(fr.features(spark, d), REFERENCE_END - 5 * DAY, REFERENCE_END + 3 * DAY, DAY))


@query(f"WITH {fr.FEATURES}, u AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE entity_id = 'error') SELECT {KEY}, window_end, count(*) AS count FROM u GROUP BY ALL HAVING count(*) > 1")
def ambiguous_features(spark, d):
    f = fr.features(spark, d)
    return windowing.ambiguous(f.union(f.where("entity_id = 'error'")))


# Scores


def _scored(spark, d, method):
    g = fr.grid(spark, d)
    e = scoring.eligibility(g, REFERENCE_END, fr.MIN_POINTS, fr.MIN_COVERAGE)
    filled = scoring.imputed(g, e)
    return rounded(scoring.window_scores(filled, scoring.fitted(filled, REFERENCE_END), REFERENCE_END, [method]))


def _add_scores():
    for method in scoring.PLAIN_METHODS:
        f = lambda spark, d, m=method: _scored(spark, d, m)
        f.__name__ = f"score_{method}"
        query(f"WITH {fr.SCORES} SELECT {KEY}, window_end, method, {r('value score')} FROM sc WHERE method = '{method}'")(f)


_add_scores()


def _evidence(spark, d):
    return scoring.evidence(fr.grid(spark, d), REFERENCE_END, fr.MIN_POINTS, fr.MIN_COVERAGE)


EVIDENCE = "score peak_value reference_median reference_p95"


@query(f"WITH {fr.SCORES} SELECT {KEY}, method, peak_window_end, {r(EVIDENCE)}, reference_count, current_count, feature, 'unlabelled' AS label_status FROM ev")
def evidence_peaks(spark, d):
    return rounded(_evidence(spark, d))


@query(f"""WITH {fr.SCORES} SELECT system_id, entity_id, method, feature, {r('score')}, CAST(row_number() OVER (PARTITION BY system_id, method ORDER BY score DESC, entity_id, feature) AS INTEGER) AS feature_rank FROM ev""")
def feature_ranking(spark, d):
    return rounded(ranking.feature_ranking(_evidence(spark, d)).select("system_id", "entity_id", "method", "feature", "score", "feature_rank"))


RANKED = f"""{fr.SCORES}, en AS (SELECT system_id, method, entity_id, max(score) AS score FROM ev GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY system_id, method ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM en)"""


@query(f"WITH {RANKED} SELECT system_id, method, entity_id, {r('score')}, rank FROM rk")
def entity_ranking(spark, d):
    return rounded(ranking.entity_ranking(_evidence(spark, d)))


CASE_DAY = 20
CASE_SQL = f"""cw AS (SELECT CAST(user_id % 10 AS BIGINT) AS case_id, event_type AS entity_id, {fr.end_sql('epoch_us(ts) / 1e6')} AS window_end, avg(value) AS value FROM events GROUP BY ALL),
cb AS (SELECT max(epoch_us(ts) / 1e6) AS last FROM events), ck AS (SELECT cw.* FROM cw, cb WHERE (window_end <= {REFERENCE_END} OR window_end > {REFERENCE_END + DAY}) AND window_end <= last)"""


def _case_windows(spark, d):
    e = table(spark, d, "events")
    long = e.select((F.col("user_id") % 10).cast("long").alias("case_id"), F.col("event_type").alias("entity_id"), F.lit("value").alias("metric"), fr.seconds().alias("time"), "value")
    last = long.agg(F.max("time").alias("t")).first()["t"]
    windows = cases.case_windows(long, ["case_id"], DAY)
    return cases.without_leakage(windows, F.lit(REFERENCE_END + 3600.0), F.lit(last), DAY)


@query(f"WITH {CASE_SQL} SELECT case_id, entity_id, 'value' AS metric, window_end, {r('value')}, CAST({REFERENCE_END} AS BIGINT) AS boundary FROM ck")
def leakage_filter(spark, d):
    return rounded(_case_windows(spark, d))


def _case_results(spark, d):
    w = _case_windows(spark, d)
    f = w.select(F.col("case_id").cast("string").alias("system_id"), "entity_id", F.col("entity_id").alias("series_id"), F.lit("value").alias("feature_name"), F.lit("{}").alias("dimensions"), "window_end", "value")
    found = scoring.evidence(windowing.dense_grid(f, DAY), REFERENCE_END, 5, 0.5, ["mad", "nsigma"])
    ranked = ranking.entity_ranking(found).withColumnRenamed("system_id", "case")
    names = F.array(*map(F.lit, [*fr.FIELDS, "absent"]))
    # Cases 10 and 11 have no data: their root causes aren't ranked by any method.
    labels = spark.range(12).select(F.col("id").cast("string").alias("case"), F.lit("demo").alias("dataset"), F.element_at(names, (F.col("id") % 6 + 1).cast("int")).alias("root_cause_service"))
    return ranking.against_labels(ranked, labels, ["mad", "nsigma"])


RESULTS = f"""{CASE_SQL}, cbd AS (SELECT case_id, min(window_end) AS lo, max(window_end) AS hi FROM ck GROUP BY ALL), cbe AS (SELECT case_id, entity_id, min(window_end) AS lo, max(window_end) AS hi FROM ck GROUP BY ALL),
cg AS (SELECT case_id, entity_id, unnest(range(lo, hi + 1, 86400)) AS window_end FROM cbe), cgv AS (SELECT cg.*, ck.value FROM cg LEFT JOIN ck USING (case_id, entity_id, window_end)),
ce AS (SELECT case_id, entity_id, count(value) FILTER (WHERE window_end <= {REFERENCE_END}) AS n, count(*) FILTER (WHERE window_end <= {REFERENCE_END}) AS m, quantile_cont(value, 0.5) FILTER (WHERE window_end <= {REFERENCE_END}) AS med FROM cgv GROUP BY ALL),
cf AS (SELECT cgv.*, med, coalesce(value, med) AS x FROM cgv JOIN ce USING (case_id, entity_id) WHERE n >= 5 AND n >= 0.5 * m),
cm AS (SELECT case_id, entity_id, any_value(med) AS med, quantile_cont(abs(x - med), 0.5) AS mad, avg(x) AS mean, stddev_pop(x) AS std, greatest(abs(any_value(med)) * 1e-6, 1e-9) AS least FROM cf WHERE window_end <= {REFERENCE_END} GROUP BY ALL),
cs AS (SELECT case_id, entity_id, 'mad' AS method, max(abs(value - cm.med) / greatest(1.4826 * mad, least)) AS score FROM cf JOIN cm USING (case_id, entity_id) WHERE window_end > {REFERENCE_END} AND value IS NOT NULL GROUP BY ALL
 UNION ALL SELECT case_id, entity_id, 'nsigma', max(abs(value - mean) / greatest(std, least)) FROM cf JOIN cm USING (case_id, entity_id) WHERE window_end > {REFERENCE_END} AND value IS NOT NULL GROUP BY ALL),
cr AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, method ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM cs),
la AS (SELECT i AS case_id, (['click', 'error', 'purchase', 'signup', 'view', 'absent'])[i % 6 + 1] AS root FROM range(12) t(i)),
re AS (SELECT CAST(la.case_id AS VARCHAR) AS "case", m.method, la.root AS root_cause_service, 'demo' AS dataset, cr.rank, coalesce(1.0 / cr.rank, 0) AS reciprocal_rank, CAST(coalesce(cr.rank <= 1, FALSE) AS INTEGER) AS hit_1,
 CAST(coalesce(cr.rank <= 3, FALSE) AS INTEGER) AS hit_3, CAST(coalesce(cr.rank <= 5, FALSE) AS INTEGER) AS hit_5
 FROM la CROSS JOIN (VALUES ('mad'), ('nsigma')) m(method) LEFT JOIN cr ON cr.case_id = la.case_id AND cr.method = m.method AND cr.entity_id = la.root)"""


@query(f'WITH {RESULTS} SELECT "case", method, root_cause_service, dataset, rank, {r("reciprocal_rank")}, hit_1, hit_3, hit_5 FROM re')
def case_results(spark, d):
    return rounded(_case_results(spark, d))


@query(f"WITH {RESULTS} SELECT dataset, method, count(*) AS cases, round(avg(reciprocal_rank), 6) AS mrr, round(avg(hit_1), 6) AS hit_1, round(avg(hit_3), 6) AS hit_3, round(avg(hit_5), 6) AS hit_5 FROM re GROUP BY ALL")
def benchmark_hits_mrr(spark, d):
    return rounded(ranking.benchmark(_case_results(spark, d), ["dataset", "method"]))


@query()
def score_pca(spark, d):
    g = fr.grid(spark, d)
    filled = scoring.imputed(g, scoring.eligibility(g, REFERENCE_END, fr.MIN_POINTS, fr.MIN_COVERAGE))
    return rounded(models.model_peaks(filled, REFERENCE_END, ["pca"]))


@query()
def score_isolation_forest(spark, d):
    g = fr.grid(spark, d)
    filled = scoring.imputed(g, scoring.eligibility(g, REFERENCE_END, fr.MIN_POINTS, fr.MIN_COVERAGE))
    return rounded(models.model_peaks(filled, REFERENCE_END, ["isolation_forest"]))


# Recipes


def _recipe_inputs(spark, d):
    """Two gauges of each entity: daily event values as bytes used and bytes there."""
    e = table(spark, d, "events")
    one = lambda name, value: fr.metric(e, name, "gauge", "bytes", value).withColumn("series_id", F.concat_ws("/", "entity_id", F.lit(name))).dropDuplicates(validate.SAMPLE)
    return one("used", F.when(F.col("event_id") % 7 != 0, F.col("value"))).union(one("there", F.col("value") * 0 + (F.col("event_id") % 5).cast("double")))


RECIPE_ROWS = f"""rw AS (SELECT event_type AS entity_id, {fr.end_sql('epoch_us(ts) / 1e6')} AS window_end, avg(CASE WHEN event_id % 7 <> 0 THEN value END) AS a, count(CASE WHEN event_id % 7 <> 0 THEN value END) AS na,
 avg(CAST(event_id % 5 AS DOUBLE)) AS b, count(*) AS nb FROM events GROUP BY ALL), rc AS (SELECT entity_id, window_end, CASE WHEN na / 2.0 >= 0.8 THEN a END AS a, CASE WHEN nb / 2.0 >= 0.8 THEN b END AS b FROM rw)"""
FORMULA = {
    "identity": "a", "sum": "a + b", "ratio": "CASE WHEN b > 0 THEN a / b END", "fraction_of_sum": "CASE WHEN a + b > 0 THEN a / (a + b) END",
    "relative_gap": "CASE WHEN a > 0 THEN abs(a - b) / a END",
}


def _recipe(op: str) -> dict:
    inputs = [{"metric": m, "kind": "gauge", "units": ["bytes"]} for m in (["used"] if op == "identity" else ["used", "there"])]
    return {"name": op, "inputs": inputs, "operation": op, "unit": "x", "target_status": "demo", "scale": 10}


def _add_recipes():
    for op, formula in FORMULA.items():
        def f(spark, d, op=op):
            features, _ = recipes.calculate(_recipe_inputs(spark, d), [_recipe(op)], DAY)
            return rounded(features.select("system_id", "entity_id", "feature_name", "window_end", "value", "unit", "target_status"))

        f.__name__ = f"recipe_{op}"
        query(f"WITH {RECIPE_ROWS} SELECT 'shop' AS system_id, entity_id, '{op}' AS feature_name, window_end, round(10 * ({formula}), 6) AS value, 'x' AS unit, 'demo' AS target_status FROM rc")(f)


_add_recipes()


@query(f"""WITH {RECIPE_ROWS}, s AS (SELECT entity_id, count(*) FILTER (WHERE b > 0 AND a IS NOT NULL) AS v, count(*) AS n FROM rc GROUP BY ALL)
SELECT 'shop' AS system_id, entity_id, '{{}}' AS dimensions, u.recipe, u.status, CASE WHEN u.recipe = 'ratio' THEN v ELSE 0 END AS valid_windows, CASE WHEN u.recipe = 'ratio' THEN n - v ELSE 0 END AS missing_windows
FROM s, (VALUES ('ratio', 'calculated'), ('absent', 'missing_source:none'), ('unit', 'kind_or_unit_mismatch:there')) u(recipe, status)""")
def recipe_audit(spark, d):
    more = [_recipe("ratio"), _recipe("ratio") | {"name": "absent"}, _recipe("ratio") | {"name": "unit"}]
    more[1]["inputs"] = [{"metric": "none", "kind": "gauge", "units": ["bytes"]}, more[1]["inputs"][1]]
    more[2]["inputs"] = [more[2]["inputs"][0], {"metric": "there", "kind": "gauge", "units": ["bits"]}]
    _, audit = recipes.calculate(_recipe_inputs(spark, d), more, DAY)
    return audit


@query(f"""WITH {RECIPE_ROWS}, t AS (SELECT entity_id, count(CASE WHEN b > 0 THEN a END) AS v, count(*) AS n FROM rc WHERE window_end <= {REFERENCE_END - 10 * DAY} AND window_end - 86400 >= {REFERENCE_END - 20 * DAY} GROUP BY ALL)
SELECT 'shop' AS system_id, entity_id, '{{}}' AS dimensions, 'ratio' AS recipe, CASE WHEN v > 0 THEN 'calculated' ELSE 'no_valid_windows' END AS status, v AS valid_windows, n - v AS missing_windows FROM t""")
def recipe_audit_trimmed(spark, d):
    features, audit = recipes.calculate(_recipe_inputs(spark, d), [_recipe("ratio")], DAY)
    return recipes.audit_after_trim(audit, windowing.trimmed(features, REFERENCE_END - 20 * DAY, REFERENCE_END - 10 * DAY, DAY))


# Profiles


@query(f"""WITH {fr.GRID}, fe AS (SELECT {KEY}, quantile_cont(value, 0.25) FILTER (WHERE window_end <= {REFERENCE_END}) AS q1, quantile_cont(value, 0.75) FILTER (WHERE window_end <= {REFERENCE_END}) AS q3 FROM grid GROUP BY ALL),
j AS (SELECT grid.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM grid JOIN fe USING ({KEY}))
SELECT {KEY}, count(value) AS count, round(avg(value), 9) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
{', '.join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in profile.QUANTILES.items())}, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_ratio, count(DISTINCT value) AS unique_count,
count(*) - count(value) AS missing_count, round(CAST(count(*) FILTER (WHERE value = 0) AS DOUBLE) / nullif(count(value), 0), 6) AS zero_ratio, count(DISTINCT value) = 1 AS constant, count(value) = 0 AS all_missing,
0::BIGINT AS infinite_count, round(any_value(lo), 9) AS iqr_lower, round(any_value(hi), 9) AS iqr_upper, count(*) FILTER (WHERE value < lo OR value > hi) AS iqr_outlier_count FROM j GROUP BY ALL""")
def distribution_summary(spark, d):
    return rounded(profile.distribution(fr.grid(spark, d), FEATURE_KEY, F.col("window_end") <= REFERENCE_END))


@query(f"""WITH {fr.GAUGE}, fe AS (SELECT entity_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM g GROUP BY ALL)
SELECT g.entity_id, round(any_value(q1 - 1.5 * (q3 - q1)), 9) AS iqr_lower, round(any_value(q3 + 1.5 * (q3 - q1)), 9) AS iqr_upper,
count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr_outlier_count FROM g JOIN fe USING (entity_id) GROUP BY ALL""")
def iqr_fences(spark, d):
    return rounded(profile.distribution(fr.gauge(spark, d), ["entity_id"], large=True).select("entity_id", "iqr_lower", "iqr_upper", "iqr_outlier_count"))


def _half(p: str, op: str) -> str:
    own = f"FILTER (WHERE window_end {op} {REFERENCE_END})"
    return (
        f"round(avg(value) {own}, 9) AS {p}_mean, count(value) {own} AS {p}_count, round(quantile_cont(value, 0.5) {own}, 6) AS {p}_median, round(quantile_cont(value, 0.95) {own}, 6) AS {p}_p95, "
        f"round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) {own}, 6) AS {p}_missing_ratio"
    )


@query(f"WITH {fr.GRID} SELECT {KEY}, {_half('reference', '<=')}, {_half('current', '>')}, round(avg(value) FILTER (WHERE window_end > {REFERENCE_END}) - avg(value) FILTER (WHERE window_end <= {REFERENCE_END}), 9) AS mean_difference FROM grid GROUP BY ALL")
def contrast(spark, d):
    return rounded(profile.contrast(fr.grid(spark, d), FEATURE_KEY, F.col("window_end") <= REFERENCE_END))


@query(f"""WITH {fr.COUNTS} SELECT a.system_id, a.entity_id, a.feature_name AS "left", b.feature_name AS "right", count(*) AS n FROM f a JOIN f b USING (system_id, entity_id, window_end) GROUP BY ALL""")
def pair_counts(spark, d):
    return profile.pair_counts(fr.counts(spark, d), ENTITY)


CORRELATED = f"""{fr.COUNTS}, p AS (SELECT a.system_id, a.entity_id, a.feature_name AS l, b.feature_name AS r, a.value AS x, b.value AS y FROM f a JOIN f b USING (system_id, entity_id, window_end) WHERE a.feature_name < b.feature_name),
k AS (SELECT *, rank() OVER (PARTITION BY l, r ORDER BY x) + (count(*) OVER (PARTITION BY l, r, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l, r ORDER BY y) + (count(*) OVER (PARTITION BY l, r, y) - 1) / 2.0 AS ry FROM p),
co AS (SELECT system_id, entity_id, l AS "left", r AS "right", count(*) AS n, CASE WHEN count(*) >= 5 AND min(x) <> max(x) AND min(y) <> max(y) THEN round(corr(x, y), 6) END AS pearson,
CASE WHEN count(*) >= 5 AND min(x) <> max(x) AND min(y) <> max(y) THEN round(corr(rx, ry), 6) END AS spearman FROM k GROUP BY ALL)"""


@query(f'WITH {CORRELATED} SELECT system_id, entity_id, "left", "right", n, pearson FROM co')
def pearson_matrix(spark, d):
    return rounded(profile.correlation_matrix(fr.counts(spark, d), ENTITY).drop("spearman"))


@query(f'WITH {CORRELATED} SELECT system_id, entity_id, "left", "right", n, spearman FROM co')
def spearman_matrix(spark, d):
    return rounded(profile.correlation_matrix(fr.counts(spark, d), ENTITY).drop("pearson"))


@query(f"""WITH {fr.COUNTS}, e AS (SELECT feature_name, min(value) AS lo, max(value) AS hi FROM f GROUP BY ALL),
b AS (SELECT feature_name, lo, hi, least(29, CAST(coalesce(floor((value - lo) / nullif((hi - lo) / 30, 0)), 0) AS INTEGER)) AS bin FROM f JOIN e USING (feature_name))
SELECT feature_name, bin, count(*) AS n, round(any_value(lo + bin * (hi - lo) / 30), 6) AS bin_start FROM b GROUP BY ALL""")
def histogram(spark, d):
    return rounded(profile.histogram(fr.counts(spark, d), ["feature_name"]))


# Plot data


@query(f"""WITH {fr.GAUGE}, s AS (SELECT entity_id, CAST(floor(t) AS BIGINT) AS a, v FROM g WHERE v IS NOT NULL), e AS (SELECT entity_id, min(a) AS lo, max(a) AS hi FROM s GROUP BY ALL),
b AS (SELECT s.*, CAST(least(39, ((a - lo) * 40) // greatest(hi - lo, 1)) AS INTEGER) AS bucket FROM s JOIN e USING (entity_id))
SELECT entity_id, bucket, min(a) AS first_at, max(a) AS last_at, {r('"first" "last" least largest')}, n FROM (SELECT entity_id, bucket, a, min(a) OVER w AS m, max(a) OVER w AS x, first_value(v) OVER (PARTITION BY entity_id, bucket ORDER BY a, v) AS "first",
first_value(v) OVER (PARTITION BY entity_id, bucket ORDER BY a DESC, v) AS "last", min(v) OVER w AS least, max(v) OVER w AS largest, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY entity_id, bucket)) GROUP BY entity_id, bucket, "first", "last", least, largest, n""")
def plot_timeline(spark, d):
    return rounded(plots.timeline(fr.gauge(spark, d), ["entity_id"], 40, "timestamp"))


def _bin(c, bins):
    return f"CAST(least({bins - 1}, coalesce(floor(({c} - {c}_lo) / nullif(({c}_hi - {c}_lo) / {bins}, 0)), 0)) AS INTEGER)"


@query(f"""WITH {fr.COUNTS}, w AS (SELECT window_end, max(value) FILTER (WHERE feature_name = 'click') AS a, max(value) FILTER (WHERE feature_name = 'error') AS b, max(value) FILTER (WHERE feature_name = 'purchase') AS c FROM f GROUP BY ALL),
p AS (SELECT 'click' AS l, 'error' AS r, a AS x, b AS y FROM w UNION ALL SELECT 'click', 'purchase', a, c FROM w UNION ALL SELECT 'error', 'purchase', b, c FROM w), q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
e AS (SELECT l, r, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM q GROUP BY ALL), b AS (SELECT q.*, e.* EXCLUDE (l, r), {_bin('x', 8)} AS x_bin, {_bin('y', 8)} AS y_bin FROM q JOIN e USING (l, r))
SELECT 'shop' AS system_id, l AS "left", r AS "right", x_bin, y_bin, count(*) AS n, round(any_value(x_lo + x_bin * ((x_hi - x_lo) / 8)), 6) AS x_start, round(any_value(y_lo + y_bin * ((y_hi - y_lo) / 8)), 6) AS y_start FROM b GROUP BY ALL""")
def plot_scatter(spark, d):
    fields = ["click", "error", "purchase"]
    return rounded(plots.scatter(plots.paired(fr.counts(spark, d), ["system_id"], fields), ["system_id", "left", "right"], 8))


@query(f"""WITH {CORRELATED}, nu AS (SELECT *, row_number() OVER (ORDER BY feature_name) AS i FROM (SELECT DISTINCT feature_name FROM f)), t AS (SELECT * FROM co UNION ALL SELECT system_id, entity_id, "right", "left", n, pearson, spearman FROM co)
SELECT system_id, entity_id, "left", "right", n, pearson, spearman, CAST(a.i AS INTEGER) AS left_number, CAST(b.i AS INTEGER) AS right_number FROM t JOIN nu a ON a.feature_name = "left" JOIN nu b ON b.feature_name = "right" WHERE a.i <= 4 AND b.i <= 4""")
def plot_heat_map(spark, d):
    rows = fr.counts(spark, d)
    return rounded(plots.heat_map(profile.correlation_matrix(rows, ENTITY), plots.chosen(rows, "feature_name", 1, 4), ENTITY))


@query(f"""WITH {fr.GRID}, n AS (SELECT DISTINCT system_id, entity_id, series_id AS feature FROM grid), e AS (SELECT DISTINCT system_id, entity_id FROM n ORDER BY ALL LIMIT 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY system_id, entity_id ORDER BY feature) AS INTEGER) AS number FROM n JOIN e USING (system_id, entity_id))
SELECT system_id, entity_id, feature, number, number || ': ' || left(split_part(feature, '|', 1), 40) AS label FROM r WHERE number <= 2""")
def plot_features(spark, d):
    return plots.chosen(fr.grid(spark, d).withColumn("feature", F.col("series_id")), "feature", 2, 2)


# Logs


@query(f"WITH {fr.LOGS} SELECT 'shop' AS system_id, 'app.csv' AS source_file, count(*) AS rows, min(t) AS start, max(t) AS \"end\" FROM lg")
def log_coverage(spark, d):
    return logs.log_coverage(fr.logs(spark, d))


@query(f"WITH {fr.LOGS}, x AS (SELECT length(head || tail) AS v FROM lg) SELECT 'shop' AS system_id, count(v) AS count, round(avg(v), 9) AS mean, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max, quantile_cont(CAST(v AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(v AS DOUBLE), 0.95) AS p95 FROM x")
def text_length(spark, d):
    return rounded(profile.distribution(profile.text_lengths(fr.logs(spark, d)), ["system_id"], large=True).select("system_id", "count", "mean", "min", "max", "p50", "p95"))


@query(f"WITH {fr.LOGS}, x AS (SELECT entity_id, t, head || tail AS text FROM lg UNION ALL SELECT entity_id, t, head || tail FROM lg WHERE event_id % 10 = 0) SELECT 'shop' AS system_id, count(*) AS rows, count(*) FILTER (WHERE trim(text) = '') AS blank_messages, count(*) - count(DISTINCT (entity_id, t, text)) AS exact_duplicates FROM x")
def log_quality(spark, d):
    rows = fr.logs(spark, d)
    return logs.log_quality(rows.union(rows.where("source_record % 10 = 0")))


@query(f"WITH {fr.LOGS} SELECT 'shop' AS system_id, {fr.end_sql('t')} AS window_end, count(*) AS records FROM lg GROUP BY ALL")
def log_record_counts(spark, d):
    return logs.record_counts(fr.logs(spark, d), DAY)


LONG_LOG = "'shop' AS system_id, entity_id, {n} AS series_id, {n} AS feature_name, '{{}}' AS dimensions, window_end, round({v}, 6) AS value"


@query(f"""WITH {fr.LOGS}, x AS (SELECT entity_id, {fr.end_sql('t')} AS window_end, CAST(count(*) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE regexp_matches(head || tail, '(?i)rollback|fail')) AS DOUBLE) AS e FROM lg GROUP BY ALL)
SELECT {LONG_LOG.format(n="'log_count'", v='c')} FROM x UNION ALL SELECT {LONG_LOG.format(n="'log_error_count'", v='e')} FROM x UNION ALL SELECT {LONG_LOG.format(n="'log_error_ratio'", v='e / c')} FROM x""")
def log_basic_features(spark, d):
    return rounded(logs.basic_features(fr.logs(spark, d), DAY, "rollback|fail"))


@query(f"WITH {fr.LOGS} SELECT event_id AS source_record, CAST(line_number AS INTEGER) AS line_number, family, parse_status, level FROM pe")
def log_parse_lines(spark, d):
    return logs.parse(fr.logs(spark, d), logs.ParserConfig(max_events=2_000_000_000)).select("source_record", "line_number", "family", "parse_status", "level")


@query(f"WITH {fr.LOGS} SELECT 'shop' AS system_id, family, parse_status, count(*) AS events FROM pe GROUP BY ALL")
def log_parse_quality(spark, d):
    return logs.parse_quality(logs.parsed_lines(fr.logs(spark, d), logs.ParserConfig()))


@query(rf"""WITH {fr.LOGS} SELECT event_id AS source_record, CAST(line_number AS INTEGER) AS line_number, trim(regexp_extract(message, 'Topic:\s*([^,]+)', 1)) AS topic,
trim(regexp_extract(message, 'createDate:\s*(\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d[.,]\d+)', 1)) AS create_date, regexp_extract(message, '\[(u\d+)\]', 1) AS thread FROM pe WHERE is_log""")
def key_extractors(spark, d):
    rows = logs.parsed_lines(fr.logs(spark, d), logs.ParserConfig()).where("family = 'application_log'")
    return rows.select("source_record", "line_number", "topic", "create_date", "thread")


@query(f"WITH {fr.LOGS} SELECT event_id AS source_record, parse_status, CASE WHEN parse_status = 'parsed' THEN 'id' || (event_id % 40) ELSE '' END AS call_id, CASE WHEN parse_status = 'parsed' THEN CAST(event_id % 100 AS DOUBLE) END AS resource_charge1, CAST(22 AS INTEGER) AS cdr_field_count, CASE WHEN parse_status = 'parsed' THEN service ELSE '' END AS cdr_service_id FROM pe WHERE is_raw")
def raw_record_map(spark, d):
    rows = logs.parsed_lines(fr.logs(spark, d), logs.ParserConfig()).where("family = 'cdr_raw'")
    return rows.select("source_record", "parse_status", "call_id", "resource_charge1", "cdr_field_count", "cdr_service_id")


def _message_sql() -> str:
    valid = "is_raw AND parse_status = 'parsed'"
    cells = {
        "log_event_count": "count(*)", "log_record_count": "count(DISTINCT event_id)", "log_parse_unknown_ratio": "avg(CASE WHEN parse_status <> 'parsed' THEN 1.0 ELSE 0 END)",
        "log_level_error_ratio": "CAST(count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS DOUBLE) / nullif(count(*) FILTER (WHERE level <> ''), 0)",
        "log_level_missing_ratio": "avg(CASE WHEN level = '' THEN 1.0 ELSE 0 END)", "log_warning_count": "count(*) FILTER (WHERE level IN ('WARN', 'WARNING'))",
        "cdr_schema_mismatch_count": "count(*) FILTER (WHERE parse_status LIKE 'cdr!_%' ESCAPE '!')", "cdr_valid_count": f"count(*) FILTER (WHERE {valid})",
        "cdr_duplicate_call_id_ratio": f"1 - CAST(count(DISTINCT event_id % 40) FILTER (WHERE {valid}) AS DOUBLE) / nullif(count(*) FILTER (WHERE {valid}), 0)",
        "cdr_charge_observed_count": f"count(*) FILTER (WHERE {valid})", "cdr_charge_coverage_ratio": f"CAST(count(*) FILTER (WHERE {valid}) AS DOUBLE) / nullif(count(*) FILTER (WHERE is_raw), 0)",
        "cdr_resource_charge1_sum": f"CASE WHEN count(*) FILTER (WHERE {valid}) = count(*) FILTER (WHERE is_raw) THEN sum(event_id % 100) FILTER (WHERE {valid}) END",
        "cdr_resource_charge1_mean": f"avg(event_id % 100) FILTER (WHERE {valid})", "log_logger_create_delay_p95_ms": "CASE WHEN count(*) FILTER (WHERE is_log) > 0 THEN 9 END",
        "log_negative_delay_count": "0", "log_delay_observed_count": "count(*) FILTER (WHERE is_log)", **{f"log_template_{f}_count": f"count(*) FILTER (WHERE family = '{f}')" for f in logs.FAMILIES},
    }
    parts = [f"SELECT {LONG_LOG.format(n=repr(n), v=f'CAST({v} AS DOUBLE)')} FROM pw GROUP BY entity_id, window_end" for n, v in cells.items()]
    return f"WITH {fr.LOGS}, pw AS (SELECT *, {fr.end_sql('t')} AS window_end FROM pe) " + " UNION ALL ".join(parts)


@query(_message_sql().replace("round(CAST(CASE WHEN count(*) FILTER (WHERE is_log) > 0 THEN 9 END AS DOUBLE), 6)", "round(CAST(CASE WHEN count(*) FILTER (WHERE is_log) > 0 THEN 9 END AS DOUBLE), 1)"))
def message_features(spark, d):
    rows = rounded(logs.message_features(logs.parsed_lines(fr.logs(spark, d), logs.ParserConfig()), DAY))
    # Epoch seconds as doubles hold microseconds to a tenth only.
    return rows.withColumn("value", F.when(F.col("feature_name") == "log_logger_create_delay_p95_ms", F.round("value", 1)).otherwise(F.col("value")))


# Relationships


def _count_grid(spark, d):
    """Two cohorts: the dimensions of one entity."""
    return windowing.dense_grid(fr.counts(spark, d, halves=True), DAY, within=COHORT)


WIDE = f"""{fr.HALF_GRID}, w AS (SELECT system_id, entity_id, dimensions, window_end, max(value) FILTER (WHERE feature_name = 'click') AS a, max(value) FILTER (WHERE feature_name = 'purchase') AS b FROM grid GROUP BY ALL)"""


def _rule_sql(name, value, threshold, mode, op, direction, k, right):
    sign = ">" if direction == "upper" else "<"
    return f"""WITH {WIDE}, v AS (SELECT *, {value} AS value, window_end > {REFERENCE_END} AS cur FROM w),
t AS (SELECT system_id, entity_id, dimensions, count(value) FILTER (WHERE NOT cur) AS reference_count, {threshold} AS threshold FROM v GROUP BY ALL),
e AS (SELECT v.*, reference_count, threshold, coalesce(cur AND value {sign} threshold, FALSE) AS ex FROM v JOIN t USING (system_id, entity_id, dimensions)),
i AS (SELECT *, sum(CASE WHEN ex THEN 0 ELSE 1 END) OVER (PARTITION BY system_id, entity_id, dimensions ORDER BY window_end) AS isl FROM e),
s AS (SELECT *, CAST(sum(CASE WHEN ex THEN 1 ELSE 0 END) OVER (PARTITION BY system_id, entity_id, dimensions, isl ORDER BY window_end) AS BIGINT) AS n FROM i)
SELECT system_id, entity_id, dimensions, window_end, '{name}' AS rule, 'click' AS left_field, '{right}' AS right_field, '{op}' AS operation, '{direction}' AS direction, {r('value threshold')}, '{mode}' AS threshold_mode, reference_count,
CASE WHEN NOT cur THEN 'reference' WHEN value IS NULL OR threshold IS NULL THEN 'unknown' WHEN n >= {k} THEN 'anomaly_candidate' WHEN ex THEN 'watch' ELSE 'within_threshold' END AS status, n AS consecutive_exceedances FROM s"""


@query(_rule_sql("gap", "CASE WHEN a > 0 THEN abs(a - b) / a END", f"CASE WHEN count(value) FILTER (WHERE NOT cur) >= 5 THEN quantile_cont(value, 0.6) FILTER (WHERE NOT cur) END", "reference_quantile", "relative_gap", "upper", 2, "purchase"))
def rule_threshold_quantile(spark, d):
    rule = {"name": "gap", "left": "click", "right": "purchase", "operation": "relative_gap", "quantile": 0.6, "consecutive_windows": 2}
    return rounded(relate.evaluate_rule(relate.wide_fields(_count_grid(spark, d), fr.FIELDS), rule, REFERENCE_END, 5).drop("timestamp_utc"))


@query(f"""WITH de AS ({_rule_sql("gap", "CASE WHEN a > 0 THEN abs(a - b) / a END", "CASE WHEN count(value) FILTER (WHERE NOT cur) >= 5 THEN quantile_cont(value, 0.6) FILTER (WHERE NOT cur) END", "reference_quantile", "relative_gap", "upper", 2, "purchase")}),
en AS (SELECT dimensions, min(window_end) AS lo, max(window_end) AS hi FROM de GROUP BY ALL), bu AS (SELECT de.*, CAST(least(24, ((window_end - lo) * 25) // greatest(hi - lo, 1)) AS INTEGER) AS bucket,
list_position(['reference', 'within_threshold', 'unknown', 'watch', 'anomaly_candidate'], status) AS k FROM de JOIN en USING (dimensions))
SELECT system_id, entity_id, dimensions, rule, bucket, count(*) AS n, min(value) AS least, max(value) AS largest, any_value(threshold) AS threshold, arg_max(status, k) AS status, min(window_end) FILTER (WHERE k = top) AS status_at
FROM (SELECT *, max(k) OVER (PARTITION BY dimensions, bucket) AS top FROM bu) GROUP BY system_id, entity_id, dimensions, rule, bucket""")
def plot_thresholds(spark, d):
    rule = {"name": "gap", "left": "click", "right": "purchase", "operation": "relative_gap", "quantile": 0.6, "consecutive_windows": 2}
    return rounded(plots.thresholds(relate.evaluate_rule(relate.wide_fields(_count_grid(spark, d), fr.FIELDS), rule, REFERENCE_END, 5), 25))


@query(_rule_sql("low", "CASE WHEN b > 0 THEN a / b END", "CAST(1.0 AS DOUBLE)", "fixed", "ratio", "lower", 3, "purchase"))
def rule_fixed(spark, d):
    rule = {"name": "low", "left": "click", "right": "purchase", "operation": "ratio", "threshold_mode": "fixed", "threshold": 1.0, "direction": "lower"}
    return rounded(relate.evaluate_rule(relate.wide_fields(_count_grid(spark, d), fr.FIELDS), rule, REFERENCE_END, 5).drop("timestamp_utc"))


@query("""WITH f AS (SELECT user_id, event_id, ts, event_type = 'view' AS flag FROM events), i AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM f)
SELECT user_id, event_id, flag, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS streak FROM i""")
def streak(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("flag"))
    return relate.streak(e, "flag", ["user_id"], "event_id", "streak")


LAGGED = f"""{fr.HALF_GRID}, z AS (SELECT system_id, entity_id, dimensions, feature_name, window_end, value, CASE WHEN window_end <= {REFERENCE_END} THEN 'reference' ELSE 'current' END AS period FROM grid),
p AS (SELECT a.dimensions, a.period, a.feature_name AS l, b.feature_name AS r, k AS lag, a.value AS x, b.value AS y FROM z a, range(-2, 3) t(k), z b
 WHERE a.feature_name < b.feature_name AND a.dimensions = b.dimensions AND a.period = b.period AND b.window_end = a.window_end + k * 86400 AND a.value IS NOT NULL AND b.value IS NOT NULL),
kr AS (SELECT *, rank() OVER (PARTITION BY dimensions, period, l, r, lag ORDER BY x) + (count(*) OVER (PARTITION BY dimensions, period, l, r, lag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dimensions, period, l, r, lag ORDER BY y) + (count(*) OVER (PARTITION BY dimensions, period, l, r, lag, y) - 1) / 2.0 AS ry FROM p),
co AS (SELECT dimensions, period, l, r, lag, count(*) AS n, CASE WHEN count(*) >= 6 AND min(x) <> max(x) AND min(y) <> max(y) THEN corr(x, y) END AS pearson, CASE WHEN count(*) >= 6 AND min(x) <> max(x) AND min(y) <> max(y) THEN corr(rx, ry) END AS spearman FROM kr GROUP BY ALL),
fs AS (SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(f)),
al AS (SELECT di.dimensions, pe.period, a.f AS l, b.f AS r, k AS lag FROM (SELECT DISTINCT dimensions FROM f) di, fs a, fs b, range(-2, 3) t(k), (VALUES ('reference'), ('current')) pe(period) WHERE a.f < b.f),
lc AS (SELECT 'shop' AS system_id, 'site' AS entity_id, dimensions, period, l AS "left", r AS "right", CAST(lag AS INTEGER) AS lag_windows, coalesce(n, 0) AS n_pairs, pearson, spearman FROM al LEFT JOIN co USING (dimensions, period, l, r, lag))"""


def _lagged(spark, d):
    return relate.correlation_pairs(_count_grid(spark, d), fr.FIELDS, REFERENCE_END, 6, 2, DAY)


@query(f'WITH {LAGGED} SELECT system_id, entity_id, dimensions, period, "left", "right", lag_windows, n_pairs, {r("pearson spearman")} FROM lc')
def lag_correlation(spark, d):
    return rounded(_lagged(spark, d))


@query(f"""WITH {LAGGED} SELECT system_id, entity_id, dimensions, "left", "right", period, lag_windows, n_pairs, {r("pearson")} FROM lc
WHERE ("left", "right") IN (('click', 'error'), ('click', 'purchase'), ('click', 'signup'), ('click', 'view'), ('error', 'purchase'), ('error', 'signup'))""")
def plot_lag_curves(spark, d):
    return rounded(plots.lag_curves(_lagged(spark, d), fr.FIELDS))


@query(f"""WITH {LAGGED}, z0 AS (SELECT * FROM lc WHERE lag_windows = 0) SELECT a.system_id, a.entity_id, a.dimensions, a."left", a."right", a.n_pairs AS reference_n_pairs, b.n_pairs AS current_n_pairs,
round(a.pearson, 6) AS reference_pearson, round(b.pearson, 6) AS current_pearson, round(a.spearman, 6) AS reference_spearman, round(b.spearman, 6) AS current_spearman,
round(b.pearson - a.pearson, 6) AS pearson_change, round(b.spearman - a.spearman, 6) AS spearman_change FROM z0 a JOIN z0 b ON a.dimensions = b.dimensions AND a."left" = b."left" AND a."right" = b."right" AND a.period = 'reference' AND b.period = 'current'""")
def correlation_change(spark, d):
    return rounded(relate.correlation_change(_lagged(spark, d)))


@query(f"WITH {fr.HALVES}, u AS (SELECT * FROM f UNION ALL SELECT * REPLACE ('twin' AS entity_id) FROM f UNION ALL SELECT * REPLACE ('twin' AS entity_id) FROM f WHERE feature_name = 'click') SELECT system_id, entity_id, dimensions, count(DISTINCT feature_name) AS fields, CASE WHEN entity_id = 'twin' THEN 'ambiguous_series' ELSE 'ok' END AS status FROM u GROUP BY ALL")
def cohort_status(spark, d):
    f = fr.counts(spark, d, halves=True)
    twin = f.withColumn("entity_id", F.lit("twin"))
    return relate.cohort_status(f.union(twin).union(twin.where("feature_name = 'click'")), fr.FIELDS)


# Cases


@query("""WITH h AS (SELECT DISTINCT CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS DOUBLE) AS time FROM events), m AS (SELECT CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS DOUBLE) AS time, event_type, avg(value) AS v FROM events GROUP BY ALL)
SELECT h.time, e || '_value' AS metric, round(v, 6) AS value, e AS entity_id FROM h CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(e) LEFT JOIN m ON m.time = h.time AND m.event_type = e""")
def unpivot_wide_case(spark, d):
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).cast("double").alias("time")
    wide = table(spark, d, "events").groupBy(hour).pivot("event_type", fr.FIELDS).agg(F.avg("value"))
    wide = wide.withColumnsRenamed({f: f"{f}_value" for f in fr.FIELDS})
    return rounded(cases.long_case(wide, [f"{f}_value" for f in fr.FIELDS], []))


CLOCKS = """c AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS DOUBLE) END AS t0, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS DOUBLE) END AS t1,
  CASE WHEN event_id % 3 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 7 <> 0 THEN CAST(event_id AS DOUBLE) END AS t2, value AS a, value * 2 AS b FROM events)"""


def _clocks(spark, d):
    t = lambda n: F.when(F.col("event_id") % n != 0, F.col("event_id").cast("double").cast("string"))
    third = F.when(F.col("event_id") % 3 == 0, "NaN").otherwise(t(7))
    return table(spark, d, "events").select("event_id", t(5).alias("t0"), t(4).alias("t1"), third.alias("t2"), F.col("value").alias("a"), (F.col("value") * 2).alias("b"))


@query(f"WITH {CLOCKS} SELECT event_id, coalesce(t0, t1, CASE WHEN NOT isnan(t2) THEN t2 END) AS time, a, b FROM c")
def clock_merge(spark, d):
    return cases.merge_equal_clocks(_clocks(spark, d), ["t0", "t1", "t2"])


@query(f"WITH {CLOCKS}, x AS (SELECT t0 AS time, a FROM c WHERE t0 IS NOT NULL), y AS (SELECT t1 AS time, b FROM c WHERE t1 IS NOT NULL) SELECT coalesce(x.time, y.time) AS time, a, b FROM x FULL JOIN y ON x.time = y.time")
def clock_block_full_outer(spark, d):
    joined, _ = cases.align_clock_blocks(_clocks(spark, d), [("t0", ["a"]), ("t1", ["b"])], "event_id")
    return joined


@query(f"WITH {CLOCKS} SELECT event_id, 'missing time' AS reason, a FROM c WHERE t0 IS NULL")
def quarantine_rows(spark, d):
    return cases.quarantined(_clocks(spark, d), "t0")[1].select("event_id", "reason", "a")


@query(f"WITH {CLOCKS} SELECT count(*) AS rows, CAST(2 AS INTEGER) AS fields, min(t0) AS start, max(t0) AS \"end\", count(t0) - count(DISTINCT t0) AS duplicate_times, 0::BIGINT AS missing_values, 0::BIGINT AS infinite_values FROM c")
def frame_quality(spark, d):
    return cases.frame_quality(_clocks(spark, d).withColumn("t0", F.col("t0").cast("double")), ["a", "b"], "t0")


@query("""WITH e AS (SELECT n_nationkey AS k FROM nation), f AS (SELECT DISTINCT c_nationkey + 3 AS k FROM customer), g AS (SELECT k FROM f UNION ALL SELECT k FROM f WHERE k % 10 = 0)
SELECT CAST(k AS INTEGER) AS k, 'missing' AS problem FROM e WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT k, 'unexpected' FROM f WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT k, 'duplicate' FROM g GROUP BY k HAVING count(*) > 1""")
def missing_cases_anti(spark, d):
    expected = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    found = table(spark, d, "customer").select((F.col("c_nationkey") + 3).cast("int").alias("k")).distinct()
    return cases.missing_cases(expected, found.union(found.where("k % 10 = 0")), ["k"])


# Functions and unions


@query(f"WITH {fr.FEATURES}, {fr.COUNTS.replace('f AS', 'n AS', 1)} SELECT {KEY}, window_end, {r('value')}, NULL::VARCHAR AS unit FROM f UNION ALL SELECT {KEY}, window_end, value, 'count' FROM n")
def union_features(spark, d):
    return rounded(fr.features(spark, d).unionByName(fr.counts(spark, d).withColumn("unit", F.lit("count")), allowMissingColumns=True))


@query("""SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS iso, round(epoch_us(ts) / 1e6 - 25200, 3) AS local, round(epoch_us(ts) / 1e6 - 7200, 3) AS shifted, CAST(event_id AS DOUBLE) / 1000 AS ms, round(epoch_us(ts) / 1e6 - 25200, 3) AS shown, NULL::DOUBLE AS bad FROM events""")
def epoch_parse(spark, d):
    t = F.col("ts").cast("timestamp")
    text = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shown = F.date_format(t, "MMM d, yyyy '@' HH:mm:ss.SSSSSS")
    at = lambda c, unit, zone="UTC": F.round(epoch_seconds(c, unit, zone), 3)
    return table(spark, d, "events").select(
        "event_id", at(F.concat(text, F.lit("Z")), "iso", "Asia/Ho_Chi_Minh").alias("iso"), at(F.translate(text, ".T", ", "), "iso", "Asia/Ho_Chi_Minh").alias("local"),
        at(F.concat(text, F.lit("+02:00")), "iso").alias("shifted"), at(F.col("event_id").cast("string"), "ms").alias("ms"), at(shown, "iso", "Asia/Ho_Chi_Minh").alias("shown"),
        at(F.lit("yesterday"), "iso").alias("bad"),
    )


@query("""SELECT c_custkey, left(sha256('["shop","' || c_name || '","' || c_mktsegment || '"]'), 24) AS series_id FROM customer""")
def series_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", range_api.series_id(F.lit("shop"), F.col("c_name"), F.col("c_mktsegment")).alias("series_id"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) SELECT 'pod-' || o_custkey AS entity_id, CAST(o_orderkey AS DOUBLE) AS timestamp, round(o_totalprice, 2) AS value, 'orders' AS metric, '{"zone":""}' AS dimensions FROM p""")
def api_matrix_decode(spark, d):
    point = F.format_string('[%d,"%s"]', F.col("o_orderkey"), F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string"))
    one = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(point), ",").alias("values"))
    result = F.format_string('{"metric":{"pod":"pod-%d","job":"x"},"values":[%s]}', F.col("o_custkey"), F.col("values"))
    body = one.select(F.concat(F.lit('{"status":"success","data":{"resultType":"matrix","result":['), result, F.lit("]}}")).alias("body"))
    spec = {"name": "orders", "kind": "gauge", "unit": "money", "comparison_dimensions": ["zone"]}
    return rounded(range_api.decode(body, "shop", spec, entity_label="pod", cadence_seconds=60).select("entity_id", "timestamp", "value", "metric", "dimensions"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS value FROM events")
def missing_numbers(spark, d):
    v = F.when(F.col("event_id") % 6 == 0, float("nan")).when(F.col("event_id") % 6 == 3, float("-inf")).otherwise(F.col("event_id").cast("double"))
    return table(spark, d, "events").select("event_id", finite(v).alias("value"))


@query(f"SELECT event_id, {fr.end_sql('epoch_us(ts) / 1e6', 300)} AS window_end FROM events")
def window_assignment(spark, d):
    return table(spark, d, "events").select("event_id", window_end(fr.seconds(), 300).alias("window_end"))


@query("SELECT event_type, event_id, value, i AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS i FROM events) WHERE i <= 5")
def first_of_each(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc_nulls_last("value"), "event_id")
    return table(spark, d, "events").select("event_type", "event_id", "value", F.row_number().over(w).alias("rank")).where("rank <= 5")
