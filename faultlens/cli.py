"""Command line: ``python -m faultlens.cli FLOW --config FILE --output FOLDER ...``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .settings import RuntimeSettings, load_config

FLOWS = ("internal", "rcaeval", "preflight", "relationships", "recipes")
INTERNAL_ONLY = ("metric_file", "reference_end", "start", "end")
CORPUS_ONLY = ("data", "smoke_cases", "datasets", "inventory_only", "expected")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="faultlens")
    p.add_argument("flow", choices=FLOWS)
    p.add_argument("--config", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--data", help="folder of the corpus")
    p.add_argument("--expected", help="JSON of datasets and their cases, instead of the public corpus")
    p.add_argument("--datasets", nargs="*")
    p.add_argument("--smoke-cases", type=int)
    p.add_argument("--inventory-only", action="store_true")
    p.add_argument("--metric-file")
    p.add_argument("--features", help="feature table of the relationships flow")
    p.add_argument("--reference-end", type=float)
    p.add_argument("--start", type=float)
    p.add_argument("--end", type=float)
    p.add_argument("--eda-only", action="store_true")
    return p


def check(args: argparse.Namespace) -> argparse.Namespace:
    given = lambda names: [n for n in names if getattr(args, n) not in (None, False)]
    if args.flow in ("rcaeval", "preflight") and (bad := given(INTERNAL_ONLY)):
        raise SystemExit(f"{args.flow} doesn't take {bad}")
    if args.flow == "internal" and (bad := given(CORPUS_ONLY)):
        raise SystemExit(f"internal doesn't take {bad}")
    if args.flow in ("internal", "relationships") and args.reference_end is None:
        raise SystemExit("--reference-end is required")
    return args


def main(argv: list[str] | None = None, spark=None) -> int:
    args = check(parser().parse_args(argv))
    config, runtime = load_config(args.config), RuntimeSettings.from_env()
    from . import artifacts, flows
    from .operators import recipes, validate
    from .sources import corpus, files

    if spark is None:
        from .session import session

        spark = session()
    if args.flow == "internal":
        flows.run_internal(spark, config, args.output, runtime, args.reference_end, args.start, args.end, args.metric_file, args.eda_only)
    elif args.flow == "relationships":
        table = spark.read.parquet(args.features) if args.features.endswith(".parquet") else spark.read.options(header=True, inferSchema=True).csv(args.features)
        folder = artifacts.new_folder(args.output)
        flows.relationship_report(table, config["relationships"], args.reference_end, config.get("analysis", {}).get("window_seconds", 300), folder)
        artifacts.seal(folder, {"flow": args.flow})
    elif args.flow == "recipes":
        folder = artifacts.new_folder(args.output)
        clean, quality = validate.validate(files.metric_csv(spark, args.metric_file))
        w = config.get("analysis", {}).get("window_seconds", 300)
        features, audit = recipes.calculate(clean, config.get("recipes") or recipes.shipped(), w)
        artifacts.write_parquet(features, folder, "features")
        artifacts.write_csv(audit, folder, "calculation_status")
        artifacts.write_json(folder / "metric_quality.json", quality)
        artifacts.seal(folder, {"flow": args.flow})
    else:
        root = args.data or runtime.data_root
        if not root:
            raise SystemExit("--data or RCA_DATA_ROOT is required")
        expected = json.loads(Path(args.expected).read_text(encoding="utf-8-sig")) if args.expected else corpus.expected_cases()
        if args.flow == "preflight":
            rows = flows.preflight(spark, config, args.output, root, expected, args.datasets)
            return int(any(r["status"] == "ERROR" for r in rows))
        flows.run_benchmark(spark, config, args.output, root, expected, args.datasets, args.smoke_cases, args.inventory_only, args.eda_only)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
