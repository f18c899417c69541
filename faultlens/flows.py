"""The two flows: unlabelled internal telemetry, and the labelled benchmark."""

from __future__ import annotations

import csv
import shutil
from dataclasses import asdict
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifacts
from .operators import cases, logs, models, plots, profile, ranking, recipes, relate, scoring, validate, windowing
from .schemas import COHORT, ENTITY, FEATURE_KEY, Modality
from .settings import METHODS, AnalysisSettings, RuntimeSettings
from .sources import case_scan, corpus, files, range_api


def analyze(features: DataFrame, reference_end: float | DataFrame, settings: AnalysisSettings, folder: Path, eda_only: bool = False) -> DataFrame | None:
    """Profiles, evidence and rankings of all entities; the ranking of entities, or None for profiles only.

    reference_end: one time for all, or rows (system_id, boundary) with a time for each system.
    """
    features = artifacts.write_parquet(features.select(*FEATURE_KEY, "window_end", "value"), folder, "features")
    if not windowing.ambiguous(features).isEmpty():
        raise ValueError("duplicate feature identity; refine the mapping")
    grid = windowing.dense_grid(features, settings.window_seconds, settings.max_rows)
    if isinstance(reference_end, DataFrame):
        grid, reference_end = grid.join(reference_end, "system_id"), F.col("boundary")
    grid = grid.persist()
    try:
        is_reference = scoring.in_reference(reference_end)
        eligible = scoring.eligibility(grid, reference_end, settings.min_reference_points, settings.min_coverage_ratio).persist()
        artifacts.write_csv(scoring.coverage(eligible), folder, "coverage")
        profiles(grid, is_reference, settings, folder)
        if eda_only:
            return None
        plain = [m for m in settings.methods if m in scoring.PLAIN_METHODS]
        slow = [m for m in settings.methods if m not in scoring.PLAIN_METHODS]
        filled = scoring.imputed(grid, eligible)
        # Models are written and applied as they were written.
        stored = models.fit_models(filled, reference_end, slow, settings.pca_components, settings.forest_trees, settings.forest_samples, settings.random_seed)
        stored = {m: artifacts.write_parquet(df, folder, f"model_{m}") for m, df in stored.items()}
        more = (lambda f: models.apply_models(f, reference_end, stored, settings.pca_components, settings.forest_samples)) if slow else None
        artifacts.write_parquet(filled.where(is_reference), folder, "reference", ENTITY)
        artifacts.write_parquet(scoring.fitted(filled, reference_end), folder, "model")
        found = scoring.evidence(grid, reference_end, settings.min_reference_points, settings.min_coverage_ratio, plain, more)
        found = artifacts.write_parquet(found, folder, "evidence")
        if found.isEmpty():
            raise ValueError("no eligible evidence; see coverage.csv, the reference range and missing values")
        artifacts.write_csv(found, folder, "evidence", grows=True)
        artifacts.write_csv(ranking.feature_ranking(found), folder, "feature_ranking", grows=True)
        ranked = ranking.entity_ranking(found)
        artifacts.write_csv(ranked, folder, "ranking")
        return ranked
    finally:
        grid.unpersist()


def profiles(grid: DataFrame, is_reference, settings: AnalysisSettings, folder: Path) -> None:
    artifacts.write_csv(profile.distribution(grid, FEATURE_KEY, is_reference), folder, "distribution")
    artifacts.write_csv(profile.contrast(grid, FEATURE_KEY, is_reference), folder, "contrast")
    named = grid.withColumn("feature", F.concat_ws("|", "feature_name", "series_id", "dimensions"))
    # Pairs are quadratic in the features of an entity: only the first ones by name take part.
    order = named.select(*ENTITY, "feature").distinct().withColumn("number", F.row_number().over(_by_entity()))
    used = order.where(F.col("number") <= settings.eda_max_correlation_features)
    artifacts.write_csv(used, folder, "correlation_fields")
    rows = named.join(used, [*ENTITY, "feature"])
    for scope, mask in (("reference", is_reference), ("current", ~is_reference)):
        own = rows.where(mask)
        artifacts.write_csv(profile.pair_counts(own, ENTITY, "feature"), folder, f"{scope}_pair_counts")
        matrix = profile.correlation_matrix(own, ENTITY, "feature")
        artifacts.write_csv(matrix, folder, f"{scope}_correlation")
        if settings.eda_max_visual_entities:
            artifacts.write_csv(plots.heat_map(matrix, plots.chosen(rows, "feature", settings.eda_max_visual_entities, 20), ENTITY, "feature"), folder, f"plots/{scope}_heat_map")
    artifacts.write_csv(profile.histogram(grid, FEATURE_KEY), folder, "histogram")
    if settings.eda_max_visual_entities:
        shown = plots.chosen(named, "feature", settings.eda_max_visual_entities, settings.eda_max_visual_features)
        artifacts.write_csv(plots.timeline(named.join(shown, [*ENTITY, "feature"]), [*ENTITY, "feature", "label"]), folder, "plots/timeline")


def _by_entity():
    from pyspark.sql import Window

    return Window.partitionBy(*ENTITY).orderBy("feature")


def relationship_report(features: DataFrame, config: dict, reference_end: float, window_seconds: int, folder: Path, max_windows: int = 500_000) -> DataFrame:
    """Correlations, their changes and rule decisions of every cohort that isn't ambiguous; the decisions."""
    rules = relate.check_report(config, window_seconds)
    fields = config["fields"]
    rows = features.where(F.col("feature_name").isin(fields))
    if not rows.where(F.col("window_end") % window_seconds != 0).isEmpty():
        raise ValueError("windows are not aligned")
    status = relate.cohort_status(rows, fields).persist()
    artifacts.write_csv(status, folder, "cohorts")
    good = rows.join(status.where("status = 'ok'").select(*COHORT), COHORT, "left_semi")
    grid = windowing.dense_grid(good, window_seconds, max_windows, COHORT).persist()
    artifacts.write_csv(grid, folder, "aligned_features", grows=True)
    pairs = relate.correlation_pairs(grid, fields, reference_end, config.get("min_pairs", 20), config.get("max_lag_windows", 3), window_seconds)
    pairs = artifacts.write_parquet(pairs, folder, "correlations")
    artifacts.write_csv(pairs, folder, "correlations", grows=True)
    artifacts.write_csv(relate.correlation_change(pairs), folder, "correlation_changes")
    artifacts.write_csv(plots.timeline(grid, [*COHORT, "feature_name"]), folder, "plots/timeline")
    period = F.when(F.col("window_end") <= reference_end, "reference").otherwise("current").alias("period")
    if len(fields) > 1:
        artifacts.write_csv(plots.scatter(plots.paired(grid.withColumn("period", period), [*COHORT, "period"], fields), [*COHORT, "period", "left", "right"]), folder, "plots/scatter")
        artifacts.write_csv(plots.lag_curves(pairs, fields), folder, "plots/lag_curves")
    wide = relate.wide_fields(grid, fields)
    decided = [relate.evaluate_rule(wide, r, reference_end, config.get("min_reference_points", 20)) for r in rules]
    out = reduce(DataFrame.unionByName, decided) if decided else None
    if out is not None:
        artifacts.write_csv(out, folder, "decisions", grows=True)
        artifacts.write_csv(plots.thresholds(out), folder, "plots/thresholds")
    status.unpersist()
    grid.unpersist()
    return out


def run_internal(
    spark: SparkSession, config: dict, output: str | Path, runtime: RuntimeSettings, reference_end: float, start: float | None = None, end: float | None = None,
    metric_file: str | None = None, eda_only: bool = False, transport=range_api.get_json,
) -> DataFrame | None:
    settings = AnalysisSettings.of(config.get("analysis", {}))
    for m in (Modality.TRACE, Modality.ALARM):
        if config.get(m.value, {}).get("enabled"):
            raise ValueError(f"{m.value} input is reserved")
    metrics_on, logs_on = config.get("metric", {}).get("enabled", False) or bool(metric_file), config.get("log", {}).get("enabled", False)
    if not metrics_on and not logs_on:
        raise ValueError("no source is enabled")
    folder = artifacts.new_folder(output)
    w, parts = settings.window_seconds, []
    if metrics_on:
        if metric_file:
            (folder / "raw").mkdir()
            shutil.copy2(metric_file, folder / "raw")
            records = files.metric_csv(spark, metric_file, settings.max_rows)
        else:
            if start is None or end is None:
                raise ValueError("an export needs start and end")
            records = range_api.export(spark, config["metric"], runtime.api_url, start, end, runtime.authorization, transport, settings.max_rows, f"{folder}/raw_responses.parquet")
        clean, quality = validate.validate(records)
        clean = artifacts.write_parquet(clean, folder, "metrics")
        artifacts.write_json(folder / "metric_quality.json", quality)
        artifacts.write_csv(profile.distribution(clean, ["system_id", "series_id"], large=True), folder, "raw_distribution")
        rows = windowing.resample(clean, w, settings.min_coverage_ratio)
        if config.get("feature_calculation", {}).get("enabled"):
            spec = config["feature_calculation"].get("recipes") or recipes.shipped()
            calculated, audit = recipes.calculate(clean, spec, w, settings.min_coverage_ratio)
            kept = windowing.trimmed(calculated, start, end, w)
            own = folder / "calculated_features"
            own.mkdir()
            artifacts.write_json(own / "recipes.json", spec)
            kept = artifacts.write_parquet(kept, own, "calculated")
            artifacts.write_csv(recipes.audit_after_trim(audit, kept), own, "calculation_status")
            if not kept.isEmpty():
                analyze(kept, reference_end, settings, own, eda_only=True)
        parts.append(windowing.request_response(rows, config.get("request_response_rules", [])))
    if logs_on:
        own = config["log"]
        root = runtime.log_root
        if root is None:
            raise ValueError("the folder of the logs is not set")
        records = files.log_csv(spark, root, own["sources"], settings.max_rows)
        if records.isEmpty():
            raise ValueError("the log source is empty")
        artifacts.write_parquet(records, folder, "raw_logs")
        artifacts.write_csv(logs.log_coverage(records), folder, "log_coverage")
        artifacts.write_csv(logs.log_quality(records), folder, "log_quality")
        artifacts.write_csv(logs.record_counts(records, w), folder, "log_record_counts")
        parts.append(logs.basic_features(records, w, own.get("error_pattern", "error|exception|fail")))
        if "parser" in own:  # without one, messages stay unparsed
            parser = logs.ParserConfig.of(own["parser"])
            events = artifacts.write_parquet(logs.parse(records, parser), folder, "parsed_log_events")
            artifacts.write_csv(logs.parse_quality(events), folder, "log_parse_quality")
            artifacts.write_csv(events.where("family = 'cdr_raw'"), folder, "cdr_fields", grows=True)
            artifacts.write_json(folder / "log_parser.json", asdict(parser))
            parts.append(logs.message_features(events, w))
    features = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    features = windowing.trimmed(features, start, end, w)
    if config.get("relationships", {}).get("enabled"):
        (folder / "relationships").mkdir()
        relationship_report(features, config["relationships"], reference_end, w, folder / "relationships", settings.max_rows)
    ranked = analyze(features, reference_end, settings, folder, eda_only)
    artifacts.seal(folder, {"flow": "internal", "config": config, "reference_end": reference_end})
    return ranked


def case_features(spark: SparkSession, found: list[corpus.Case], config: dict, settings: AnalysisSettings, folder: Path) -> tuple[DataFrame, list[dict]]:
    """Feature rows of all cases, with a column ``boundary``, written as case_features: one plan for what follows.

    The CSV files of all cases are one scan; cases of a Parquet catalogue are read one by one.
    """
    parts, qualities, w, got = [], [], settings.window_seconds, None
    options = config.get("rcaeval_input", {})
    if own := [c for c in found if c.source_format == "csv"]:
        got = case_scan.scan(spark, own, options, settings.max_rows)
        rows = [r.asDict() for r in got.report.orderBy(*case_scan.KEYS).collect()]  # a row for each case
        if bad := [r for r in rows if r["error"]]:
            raise ValueError("; ".join(f"{r['dataset']} {r['case']}: {r['error']}" for r in bad))
        qualities += [{k: v for k, v in r.items() if k not in ("error", "aligned", "inject_time")} for r in rows]
        if any(r["rejected_rows"] for r in rows):
            artifacts.write_csv(got.rejected, folder, "quarantine", grows=True)
        long = got.long.withColumn("entity_id", F.substring_index("metric", "_", 1))
        windows = cases.case_windows(long, case_scan.KEYS, w).join(got.report.select(*case_scan.KEYS, "inject_time", F.col("end").alias("last_time")), case_scan.KEYS)
        parts.append(_case_rows(cases.without_leakage(windows, F.col("inject_time"), F.col("last_time"), w), F.concat_ws("/", *case_scan.KEYS)))
    for c in (c for c in found if c.source_format != "csv"):
        frame, quality, rejected = corpus.read_metrics(spark, c.metric_file, settings.max_rows, **corpus.read_options(options, c.case))
        qualities.append({"case": c.case, "dataset": c.dataset, **quality})
        if rejected is not None:
            artifacts.write_csv(rejected, folder, f"quarantine/{c.dataset}/{c.case}", grows=True)
        if not quality["start"] < c.inject_time < quality["end"]:
            raise ValueError(f"{c.case}: the injection lies outside the data")
        long = cases.long_case(frame, [n for n in frame.columns if n != "time"], [])
        kept = cases.without_leakage(cases.case_windows(long, [], w), F.lit(float(c.inject_time)), F.lit(float(quality["end"])), w)
        parts.append(_case_rows(kept, F.lit(f"{c.dataset}/{c.case}")))
    features = artifacts.write_parquet(reduce(DataFrame.unionByName, parts), folder, "case_features")
    if got:
        got.release()
    return features, qualities


def _case_rows(windows: DataFrame, system: Column) -> DataFrame:
    metric = F.col("metric")
    return windows.select(system.alias("system_id"), "entity_id", metric.alias("series_id"), metric.alias("feature_name"), F.lit("{}").alias("dimensions"), "window_end", "value", "boundary")


def run_benchmark(
    spark: SparkSession, config: dict, output: str | Path, root: str | Path, expected: dict[str, list[str]], datasets: list[str] | None = None, smoke_cases: int | None = None,
    inventory_only: bool = False, eda_only: bool = False,
) -> DataFrame | None:
    """Every case is a value of ``system_id``; all are scored by the same plan."""
    settings = AnalysisSettings.of(config.get("analysis", {}))
    folder = artifacts.new_folder(output)
    found, report = corpus.inventory(spark, root, expected, datasets, smoke_cases)
    artifacts.write_json(folder / "inventory.json", report)
    artifacts.write_csv(corpus.case_frame(spark, found), folder, "cases")
    if inventory_only:
        return None
    features, quality = case_features(spark, found, config, settings, folder)
    artifacts.write_json(folder / "metric_quality.json", quality)
    artifacts.write_json(folder / "modalities.json", {f"{c.dataset}/{c.case}": {k: corpus.modality_summary(spark, getattr(c, f"{k}_file")) for k in ("logs", "traces")} for c in found})
    boundary = features.groupBy("system_id").agg(F.max("boundary").alias("boundary"))
    # The reference ends at each case's own time.
    ranked = analyze(features.drop("boundary"), boundary, settings, folder, eda_only)
    if ranked is None:
        return None
    labels = spark.createDataFrame([(f"{c.dataset}/{c.case}", c.dataset, c.root_cause_service, c.fault) for c in found], "`case` string, dataset string, root_cause_service string, fault string")
    results = artifacts.write_parquet(ranking.against_labels(ranked.withColumnRenamed("system_id", "case"), labels, list(settings.methods)), folder, "case_results")
    artifacts.write_csv(results, folder, "case_results")
    artifacts.write_csv(ranking.benchmark(results, ["dataset", "method"]), folder, "benchmark_by_dataset")
    overall = ranking.benchmark(results, ["method"])
    artifacts.write_csv(overall, folder, "benchmark_overall")
    artifacts.seal(folder, {"flow": "rcaeval", "methods": [m for m in METHODS if m in settings.methods], "cases": len(found)})
    return overall


def preflight(spark: SparkSession, config: dict, output: str | Path, root: str | Path, expected: dict[str, list[str]], datasets: list[str] | None = None) -> list[dict]:
    """Reads every case and goes on after errors; one status row for each."""
    settings = AnalysisSettings.of(config.get("analysis", {}))
    folder = artifacts.new_folder(output)
    found, _ = corpus.inventory(spark, root, expected, datasets)
    options, rows = config.get("rcaeval_input", {}), []
    if own := [c for c in found if c.source_format == "csv"]:
        got = case_scan.scan(spark, own, options, settings.max_rows)
        found_rows = got.report.collect()  # a row for each case
        got.release()
        for r in found_rows:
            row = r.asDict()
            status = "ERROR" if row["error"] else "READY_WITH_CLOCK_ALIGNMENT" if row["aligned"] else "READY_WITH_QUARANTINE" if row["rejected_rows"] else "READY"
            rows.append({"case": row["case"], "dataset": row["dataset"], "status": status, "error": row["error"] or "", **{k: v for k, v in row.items() if k not in ("case", "dataset", "error", "aligned", "inject_time")}})
    for c in (c for c in found if c.source_format != "csv"):
        own_options = corpus.read_options(options, c.case)
        row = {"case": c.case, "dataset": c.dataset, "status": "READY", "error": ""}
        try:
            _, quality, rejected = corpus.read_metrics(spark, c.metric_file, settings.max_rows, **own_options)
            if not quality["start"] < c.inject_time < quality["end"]:
                raise ValueError("the injection lies outside the data")
            row |= quality
            if own_options.get("duplicate_time_policy") == "align_blocks":
                row["status"] = "READY_WITH_CLOCK_ALIGNMENT"
            elif rejected is not None:
                row["status"] = "READY_WITH_QUARANTINE"
        except Exception as e:  # noqa: BLE001 - every case is reported
            row |= {"status": "ERROR", "error": str(e).splitlines()[0][:300]}
        rows.append(row)
    rows.sort(key=lambda r: (r["dataset"], r["case"]))
    artifacts.write_json(folder / "preflight.json", rows)
    names = list(dict.fromkeys(k for r in rows for k in r))
    with (folder / "preflight.csv").open("w", newline="") as f:
        out = csv.DictWriter(f, names)
        out.writeheader()
        out.writerows(rows)
    summary = {s: sum(r["status"] == s for r in rows) for s in sorted({r["status"] for r in rows})}
    artifacts.write_json(folder / "summary.json", {"cases": len(rows), "statuses": summary})
    return rows
