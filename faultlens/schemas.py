"""The fixed record types."""

from __future__ import annotations

from enum import StrEnum

METRIC = (
    "timestamp double, value double, system_id string, entity_id string, series_id string, metric string, kind string, "
    "unit string, cadence_seconds double, dimensions string, labels string"
)
METRIC_REQUIRED = ["timestamp", "value", "system_id", "entity_id", "series_id", "metric", "kind", "unit", "cadence_seconds", "dimensions"]
LOG = (
    "timestamp double, text string, system_id string, entity_id string, source_file string, source_record long, source_timezone string, "
    "expected_cdr_service_id string"
)
FEATURE = "system_id string, entity_id string, series_id string, feature_name string, dimensions string, window_end long, value double"
SERIES = ["system_id", "series_id"]
ENTITY = ["system_id", "entity_id"]
COHORT = ["system_id", "entity_id", "dimensions"]
FEATURE_KEY = ["system_id", "entity_id", "series_id", "feature_name", "dimensions"]


class Modality(StrEnum):
    METRIC = "metric"
    LOG = "log"
    TRACE = "trace"
    ALARM = "alarm"


def require(df, columns: list[str]):
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
