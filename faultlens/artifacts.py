"""Run folders: strict JSON, small CSV and Parquet results, hashes and the manifest."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def write_json(path: str | Path, value) -> Path:
    """Strict JSON (no NaN), written beside and then put in place."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False, default=str)
    beside = path.with_name(f".{path.name}.tmp")
    beside.write_text(text + "\n", encoding="utf-8")
    os.replace(beside, path)
    return path


def new_folder(path: str | Path) -> Path:
    path = Path(path)
    path.mkdir(parents=True, exist_ok=False)
    return path


def write_csv(df: DataFrame, folder: str | Path, name: str, grows: bool = False) -> str:
    """A result as CSV in a folder of its own; one file, unless it ``grows`` with the data."""
    out = f"{folder}/{name}.csv"
    (df if grows else df.coalesce(1)).write.options(header=True, escape='"').csv(out)
    return out


def write_parquet(df: DataFrame, folder: str | Path, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes and rereads, so that what follows starts from the files."""
    out = f"{folder}/{name}.parquet"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def seal(folder: str | Path, details: dict) -> Path:
    """manifest.json with the SHA-256 of every file of the run."""
    folder = Path(folder)
    files = sorted(p for p in folder.rglob("*") if p.is_file() and p.name not in ("manifest.json",) and not p.name.startswith("."))
    return write_json(folder / "manifest.json", details | {"files": {str(p.relative_to(folder)): file_sha256(p) for p in files}})
