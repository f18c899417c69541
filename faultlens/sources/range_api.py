"""Range queries of a Prometheus-style API: selectors, chunks, decoding, and a Spark data source."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..operators.validate import within_budget

LABEL = r"[a-zA-Z_][a-zA-Z0-9_]*"
METRIC_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
RESPONSE = (
    "status string, isPartial boolean, warnings array<string>, data struct<resultType: string, result: array<struct<metric: map<string, string>, values: array<array<string>>>>>"
)


def selector(name: str, system_labels: dict[str, str], metric_labels: dict[str, str] | None = None) -> str:
    """``name{a="x",b="y"}`` with the labels sorted; a metric may not change its system's scope."""
    if not re.fullmatch(METRIC_NAME, name):
        raise ValueError(f"not a metric name: {name}")
    own = metric_labels or {}
    if changed := [k for k in own if k in system_labels and own[k] != system_labels[k]]:
        raise ValueError(f"{name}: labels of the system can't be changed: {changed}")
    both = {**system_labels, **own}
    if bad := [k for k in both if not re.fullmatch(LABEL, k)]:
        raise ValueError(f"not a label: {bad}")
    if not system_labels:
        raise ValueError("a selector needs labels of its system")
    return name + "{" + ",".join(f"{k}={json.dumps(v, ensure_ascii=False)}" for k, v in sorted(both.items())) + "}"


def chunks(start: float, end: float, step: int, chunk: int, longest: int = 3600) -> list[tuple[float, float]]:
    """Inclusive ranges of at most ``chunk`` seconds of steps that don't overlap."""
    if step <= 0 or chunk < step or end <= start:
        raise ValueError("a range needs end > start, step > 0 and chunk >= step")
    if end - start > longest:
        raise ValueError(f"the range is longer than {longest} seconds")
    out, at = [], start
    span = (chunk // step - 1) * step
    while at <= end:
        last = min(end, at + span)
        out.append((at, last))
        at = last + step
    return out


def series_id(*parts: Column) -> Column:
    """Of the parts as a JSON list, which tells apart whatever they hold."""
    return F.left(F.sha2(F.to_json(F.array(*parts)), 256), F.lit(24))


def fault(body: str, entity_label: str) -> str | None:
    """What is wrong with a response, or None."""
    try:
        answer = json.loads(body)
        fine = answer["status"] == "success" and not answer.get("isPartial") and not answer.get("warnings") and answer["data"]["resultType"] == "matrix"
        series = answer["data"]["result"]
    except (ValueError, KeyError, TypeError):
        fine = False
    if not fine:
        return "a response failed, is partial, has warnings or is no matrix"
    return f"a series lacks the label {entity_label}" if any(not s["metric"].get(entity_label) for s in series) else None


def _records(bodies: DataFrame) -> DataFrame:
    """body, system, metric, kind, unit, cadence, label, dims (sorted names) of each response -> canonical metric records."""
    own = ["system", "metric", "kind", "unit", "cadence", "label", "dims"]
    series = bodies.select(*own, F.from_json("body", RESPONSE).alias("b")).select(*own, F.explode("b.data.result").alias("s")).select(*own, F.col("s.metric").alias("m"), F.col("s.values").alias("values"))
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")  # noqa: E731 (a JSON string)
    pair = lambda k: F.concat(text(k), F.lit(":"), text(F.coalesce(F.try_element_at("m", k), F.lit(""))))
    dimensions = F.concat(F.lit("{"), F.array_join(F.transform("dims", pair), ","), F.lit("}"))
    labels = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("m"))))
    rows = series.select(*own, F.try_element_at("m", F.col("label")).alias("entity_id"), dimensions.alias("dimensions"), labels.alias("labels"), F.explode("values").alias("p"))
    return rows.select(
        F.col("p")[0].cast("double").alias("timestamp"), finite(F.col("p")[1].cast("double")).alias("value"), F.col("system").alias("system_id"), "entity_id",
        series_id(F.col("system"), F.col("metric"), F.col("labels")).alias("series_id"), "metric", "kind", "unit", F.col("cadence").alias("cadence_seconds"), "dimensions", "labels",
    )


SPEC = "request int, system string, metric string, kind string, unit string, cadence double, label string, dims array<string>"


def _spec(request: int, system: str, metric: dict, entity_label: str, cadence_seconds: float) -> tuple:
    return request, system, metric["name"], metric["kind"], metric.get("unit", ""), float(cadence_seconds), entity_label, sorted(metric.get("comparison_dimensions", []))


def decode(bodies: DataFrame, system: str, metric: dict, entity_label: str, cadence_seconds: float) -> DataFrame:
    """Column ``body`` of response texts to canonical metric records; raises on a failed or partial response."""
    parsed = bodies.select(F.from_json("body", RESPONSE).alias("b")).select("b.*")
    good = (F.col("status") == "success") & ~F.coalesce("isPartial", F.lit(False)) & (F.coalesce(F.size("warnings"), F.lit(0)) <= 0) & (F.col("data.resultType") == "matrix")
    entity = lambda s: F.coalesce(F.try_element_at(s["metric"], F.lit(entity_label)), F.lit(""))
    bare = F.coalesce(F.exists("data.result", lambda s: entity(s) == ""), F.lit(False))
    found = parsed.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"), F.count_if(bare).alias("bare")).first()
    if found["bad"]:
        raise ValueError("a response failed, is partial, has warnings or is no matrix")
    if found["bare"]:
        raise ValueError(f"a series lacks the label {entity_label}")
    names = [c.split()[0] for c in SPEC.split(", ")][1:]
    values = _spec(0, system, metric, entity_label, cadence_seconds)[1:]
    lit = lambda v: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>")
    return _records(bodies.select("body", *[lit(v).alias(n) for n, v in zip(names, values, strict=True)]))


def get_json(url: str, authorization: str | None = None, timeout_seconds: float = 60) -> str:
    request = urllib.request.Request(url, headers={"Authorization": authorization} if authorization else {})
    with urllib.request.urlopen(request, timeout=timeout_seconds) as answer:  # noqa: S310
        return answer.read().decode()


def range_url(base: str, query: str, start: float, end: float, step: int) -> str:
    return base.rstrip("/") + "/api/v1/query_range?" + urllib.parse.urlencode({"query": query, "start": start, "end": end, "step": step, "deny_partial_response": 1})


def requests(config: dict, api_url: str, start: float, end: float) -> tuple[list[tuple[int, str]], list[tuple]]:
    """(spec number, url) of every system, metric and chunk, and the specs; raises on a setting that isn't right."""
    if not api_url:
        raise ValueError("the API's address is not set")
    step, chunk = config.get("step_seconds", 60), config.get("chunk_seconds", 900)
    spans = chunks(start, end, step, chunk, config.get("max_export_seconds", 3600))
    asked, specs = [], []
    for system in config["systems"]:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", system["system_id"]):
            raise ValueError(f"not a system id: {system['system_id']}")
        for metric in config["metrics"]:
            text = selector(metric["name"], system.get("match_labels", {}), metric.get("match_labels"))
            asked += [(len(specs), range_url(api_url, text, a, b, step)) for a, b in spans]
            specs.append(_spec(len(specs), system["system_id"], metric, metric.get("entity_label", config.get("entity_label", "pod_id")), metric.get("cadence_seconds", step)))
    if not asked:
        raise ValueError("the export is empty")
    return asked, specs


class RangeSource(DataSource):
    """``spark.read.format("metric_range")``: a partition for each system, metric and chunk; rows of request, url, body.

    Options: api_url, start, end, config (JSON of systems, metrics and steps), token (for the Authorization header).
    A response that failed, is partial or lacks its label fails its task.
    """

    transport = staticmethod(get_json)

    @classmethod
    def name(cls) -> str:
        return "metric_range"

    def schema(self) -> str:
        return "request int, url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options), type(self).transport)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, transport: Callable[[str, str | None], str]):
        self.transport, self.token = transport, options.get("token")
        self.asked, specs = requests(json.loads(options["config"]), options["api_url"], float(options["start"]), float(options["end"]))
        self.labels = [s[6] for s in specs]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(a) for a in self.asked]

    def read(self, partition: InputPartition):
        request, url = partition.value
        body = self.transport(url, self.token)
        if wrong := fault(body, self.labels[request]):
            raise ValueError(wrong)
        yield request, url, body


def export(
    spark: SparkSession, config: dict, api_url: str, start: float, end: float, authorization: str | None = None, transport: Callable[[str, str | None], str] = get_json,
    max_rows: int = 500_000, raw: str | None = None,
) -> DataFrame:
    """Every system, metric and chunk as canonical records: one scan of the data source, fetched by the executors.

    ``transport(url, authorization)`` returns a response's text. The responses are written to ``raw``
    (a folder that all machines share) and read from there; without it, what reads the result asks anew.
    """
    _, specs = requests(config, api_url, start, end)
    spark.dataSource.register(type("RangeSource", (RangeSource,), {"transport": staticmethod(transport)}))
    options = {"api_url": api_url, "start": str(start), "end": str(end), "config": json.dumps(config), **({"token": authorization} if authorization else {})}
    answers = spark.read.format("metric_range").options(**options).load()
    if raw:
        answers.write.parquet(raw)
        answers = spark.read.parquet(raw)
    out = _records(answers.join(F.broadcast(spark.createDataFrame(specs, SPEC)), "request"))  # as many specs as the configuration names
    out = within_budget(out, max_rows, "the export")
    if out.isEmpty():
        raise ValueError("the export is empty")
    return out
