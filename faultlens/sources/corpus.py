"""A labelled corpus of fault-injection cases: inventory, gate and wide metric files."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import MISSING_TEXTS, finite
from ..operators import cases

SCENARIO = re.compile(r"(?P<service>.+)_(?P<fault>cpu|mem|disk|delay|loss|socket|f[1-5])(?:_(?P<n>\d+))?")
CASE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*(?:/[A-Za-z0-9][A-Za-z0-9_.-]*)*")
# File names by dataset (all others: simple_data.csv in RE1, simple_metrics.csv in RE2 and RE3).
FIRST_FILE = {"RE1-OB": "data.csv"}
RECORD = "__record"
OPTIONS = ("duplicate_time_policy", "expected_time_columns")


# The services, faults and repetitions of the public fault-injection corpus.
_RE1_OB = "adservice cartservice checkoutservice currencyservice productcatalogservice"
_RE2_OB = "checkoutservice currencyservice emailservice productcatalogservice recommendationservice"
_SS = "carts catalogue orders payment user"
_TT = "ts-auth-service ts-order-service ts-route-service ts-train-service ts-travel-service"
_FIVE, _SIX = "cpu delay disk loss mem", "cpu delay disk loss mem socket"
#: dataset: (services, faults, repetitions), ...
_LAYOUT = {
    "RE1-OB": [(_RE1_OB, _FIVE, 5)], "RE1-SS": [(_SS, _FIVE, 5)], "RE1-TT": [(_TT, _FIVE, 5)],
    "RE2-OB": [(_RE2_OB, _SIX, 3)], "RE2-SS": [(_SS, _SIX, 3)], "RE2-TT": [(_TT, _SIX, 3)],
    "RE3-OB": [("adservice", "f3 f4 f5", 3), ("cartservice currencyservice", "f1", 3), ("emailservice", "f1 f2 f3 f4 f5", 3)],
    "RE3-SS": [("carts", "f1 f3 f4", 4), ("front-end", "f1 f2 f3", 3), ("orders", "f1 f3 f4", 3)],
    "RE3-TT": [("ts-auth-service", "f1 f2 f3", 4), ("ts-auth-service", "f4", 3), ("ts-route-service", "f1 f2 f3 f3_1 f4", 3)],
}


def expected_cases() -> dict[str, list[str]]:
    """The cases that a whole corpus has, by dataset."""
    every = lambda parts: [f"{s}_{f}/{n}" for services, faults, times in parts for s in services.split() for f in faults.split() for n in range(1, times + 1)]
    return {dataset: sorted(every(parts)) for dataset, parts in _LAYOUT.items()}


def parse_scenario(name: str) -> tuple[str, str]:
    """(service, fault) of ``service_fault`` or ``service_fault_n``."""
    m = SCENARIO.fullmatch(name)
    if not m:
        raise ValueError(f"not a scenario: {name}")
    return m["service"], m["fault"]


def metric_file(dataset: str) -> str:
    return FIRST_FILE.get(dataset) or ("simple_data.csv" if dataset.startswith("RE1") else "simple_metrics.csv")


@dataclass(frozen=True)
class Case:
    case: str
    dataset: str
    system: str
    fault: str
    root_cause_service: str
    inject_time: float
    metric_file: str
    source_format: str
    logs_file: str | None = None
    traces_file: str | None = None
    label_source: str = ""


def native_cases(root: Path, datasets: list[str]) -> tuple[list[Case], list[str]]:
    """Every folder with an inject_time.txt under ``<dataset>/.../<scenario>/<repetition>``, and what is wrong with others."""
    found, errors = [], []
    for mark in sorted(root.rglob("inject_time.txt")):
        folder = mark.parent
        if not mark.resolve().is_relative_to(root.resolve()):
            errors.append(f"{mark}: outside the root")
            continue
        dataset = next((p for p in reversed(folder.relative_to(root).parts[:-2]) if p in datasets), None)
        if dataset is None or not folder.name.isdigit():
            continue
        case = f"{folder.parent.name}/{folder.name}"
        try:
            service, fault = parse_scenario(folder.parent.name)
            at = float(mark.read_text().split()[0])
            metrics = folder / metric_file(dataset)
            if not math.isfinite(at):
                raise ValueError("the injection time isn't finite")
            if not metrics.is_file():
                raise ValueError(f"no {metrics.name}")
            extra = {k: str(folder / n) if (folder / n).is_file() else None for k, n in (("logs_file", "logs.csv"), ("traces_file", "traces.csv"))}
            found.append(Case(case, dataset, dataset.partition("-")[2], fault, service, at, str(metrics), "csv", label_source=str(mark), **extra))
        except (ValueError, IndexError) as e:
            errors.append(f"{dataset} {case}: {e}")
    return found, errors


def catalogue_cases(spark: SparkSession, root: Path) -> list[Case]:
    """Cases of ``cases.parquet``: a folder for each case with metrics.parquet, and logs and traces if they are there."""
    out = []
    for r in spark.read.parquet(str(root / "cases.parquet")).collect():  # a row for each case
        if not CASE_ID.fullmatch(r["case"]) or not (root / r["case"]).resolve().is_relative_to(root.resolve()):
            raise ValueError(f"not a case id: {r['case']}")
        folder = root / r["case"]
        extra = {k: str(folder / n) if (folder / n).exists() else None for k, n in (("logs_file", "logs.parquet"), ("traces_file", "traces.parquet"))}
        out.append(Case(r["case"], r["dataset"], r["system"], r["fault"], r["root_cause_service"], float(r["inject_time"]), str(folder / "metrics.parquet"), "parquet", label_source="cases.parquet", **extra))
    return out


def inventory(spark: SparkSession, root: str | Path, expected: dict[str, list[str]], datasets: list[str] | None = None, smoke_cases: int | None = None) -> tuple[list[Case], dict]:
    """Cases in order and a report; raises if one is missing, unexpected, twice or broken."""
    root = Path(root)
    if not root.is_dir():
        raise ValueError(f"{root} is no folder")
    if smoke_cases is not None and smoke_cases < 1:
        raise ValueError("smoke_cases must be 1 or more")
    wanted = list(datasets or expected)
    if unknown := sorted(set(wanted) - set(expected)):
        raise ValueError(f"unknown datasets: {unknown}")
    if (root / "cases.parquet").exists():
        found, errors = [c for c in catalogue_cases(spark, root) if c.dataset in wanted], []
        errors += [f"{c.dataset} {c.case}: no metrics" for c in found if not Path(c.metric_file).exists()]
    else:
        found, errors = native_cases(root, wanted)
    errors += [f"{c.dataset} {c.case}: the injection time isn't finite" for c in found if not math.isfinite(c.inject_time)]
    have = Counter((c.dataset, c.case) for c in found)
    want = {(d, c) for d in wanted for c in expected[d]}
    report = {
        "mode": "smoke" if smoke_cases else "subset" if datasets and set(datasets) != set(expected) else "full",
        "found": {d: sum(c.dataset == d for c in found) for d in wanted}, "expected": {d: len(expected[d]) for d in wanted},
        "missing": sorted(map("/".join, want - set(have))), "unexpected": sorted(map("/".join, set(have) - want)), "duplicate": sorted("/".join(k) for k, n in have.items() if n > 1),
        "errors": errors,
    }
    ordered = sorted(found, key=lambda c: (c.dataset, c.case))
    if smoke_cases:
        ordered = ordered[:smoke_cases]
        bad = errors or report["duplicate"] or report["unexpected"]
    else:
        bad = errors or report["missing"] or report["unexpected"] or report["duplicate"]
    if bad:
        raise ValueError(f"the corpus is not as expected: {report}")
    return ordered, report


def case_frame(spark: SparkSession, found: list[Case]) -> DataFrame:
    fields = "`case` string, dataset string, system string, fault string, root_cause_service string, inject_time double, metric_file string, source_format string, logs_file string, traces_file string, label_source string"
    return spark.createDataFrame([tuple(asdict(c).values()) for c in found], fields)


def read_options(config: dict, case_id: str) -> dict:
    """Options of one case; only the known ones."""
    own = config.get("case_overrides", {}).get(case_id, {})
    if bad := sorted(set(own) - set(OPTIONS)):
        raise ValueError(f"{case_id}: unknown options {bad}")
    return {"missing_time_policy": config.get("missing_time_policy", "error"), **own}


def read_metrics(
    spark: SparkSession, path: str, max_rows: int = 500_000, missing_time_policy: str = "error", duplicate_time_policy: str = "strict", expected_time_columns: list[int] | None = None
) -> tuple[DataFrame, dict, DataFrame | None]:
    """(wide frame with ``time``, quality, rejected rows or None) of one case's metrics."""
    if missing_time_policy not in ("error", "quarantine"):
        raise ValueError("missing_time_policy must be error or quarantine")
    if duplicate_time_policy not in ("strict", "align_blocks"):
        raise ValueError("duplicate_time_policy must be strict or align_blocks")
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path)
        if (n := raw.count()) > max_rows:  # from the files' footers
            raise ValueError(f"{path} has {n} rows, more than {max_rows}")
        header = raw.columns
    else:
        from .files import header_of

        header = header_of(spark, path)
        schema = ", ".join(f"`p{i}` string" for i in range(len(header)))
        raw = spark.read.options(header=True, enforceSchema=True).schema(schema).csv(path)
        if raw.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"{path} has more than {max_rows} rows")
    # Positional names keep repeated headers apart.
    raw = _with_record(raw.toDF(*[f"p{i}" for i in range(len(header))]), path)
    clocks = [i for i, n in enumerate(header) if n == "time"]
    names = {i: n for i, n in enumerate(header) if n.strip() and not n.startswith("Unnamed:") and i not in clocks}
    if len(set(names.values())) != len(names):
        raise ValueError("duplicate metric names")
    if not clocks:
        raise ValueError("no time column")
    if expected_time_columns is not None and [i + 1 for i in clocks] != list(expected_time_columns):
        raise ValueError(f"time columns at {[i + 1 for i in clocks]}, not {expected_time_columns}")
    number = lambda i: F.when(~F.trim(F.col(f"p{i}").cast("string")).isin(*MISSING_TEXTS), F.col(f"p{i}")).cast("double")
    typed = raw.select(RECORD, *[number(i).alias(f"t{i}") for i in clocks], *[number(i).alias(n) for i, n in names.items()])
    rejected, recovered = None, 0
    if duplicate_time_policy == "align_blocks":
        blocks = [(f"t{c}", [n for i, n in names.items() if c < i < nxt]) for c, nxt in zip(clocks, [*clocks[1:], len(header)], strict=True)]
        if clocks[0] != 0 or not all(own for _, own in blocks):
            raise ValueError("clock blocks begin in column 1, each with a metric behind its time")
        frame, rejected = cases.align_clock_blocks(typed, blocks, RECORD, missing_time_policy)
    else:
        if len(clocks) > 1:
            first = finite(F.col(f"t{clocks[0]}"))
            recovered = typed.where(first.isNull() & F.coalesce(*[F.col(f"t{c}") for c in clocks[1:]]).isNotNull()).count()
        frame = cases.merge_equal_clocks(typed, [f"t{c}" for c in clocks], record=RECORD)
        frame, bad = cases.quarantined(frame)
        if missing_time_policy == "error" and not bad.isEmpty():
            raise ValueError("rows without a time")
        rejected = bad.select(F.col(RECORD).alias("source_record_number"), F.lit(1).alias("clock_occurrence"), "reason", *names.values())
        frame = frame.drop(RECORD)
    frame = frame.select("time", *names.values())
    cases.check_frame(frame, list(names.values()))
    quality = cases.frame_quality(frame, list(names.values())).first().asDict()
    lost = rejected.count()
    quality |= {"recovered_clocks": recovered, "rejected_rows": lost, "clock_columns": len(clocks), "rejected_fraction": lost / max(1, lost + quality["rows"])}
    clean = frame.select("time", *[finite(F.col(n)).alias(n) for n in names.values()])
    return clean, quality, rejected if lost else None


def _with_record(raw: DataFrame, path: str) -> DataFrame:
    """``raw`` with its record numbers: places in the file, whatever its splits."""
    from . import records

    if not path.endswith(".parquet"):
        return records.numbered(records.placed(raw), RECORD).drop("__file")
    rows = raw.select(*raw.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    order = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__file").count().select("__file", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("__before"))  # a row for each file of the case
    return rows.join(F.broadcast(before), "__file").withColumn(RECORD, F.col("__before") + F.col("__row") + 1).drop("__file", "__row", "__before")


def modality_summary(spark: SparkSession, path: str | None) -> dict:
    """Columns, rows and hash of a log or trace file; these are never ranked."""
    from ..artifacts import file_sha256

    if not path:
        return {"present": False}
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return {"present": True, "columns": df.columns, "rows": df.count(), "sha256": file_sha256(path) if Path(path).is_file() else None}
