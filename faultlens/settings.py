"""Analysis settings, the runtime environment and JSON configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Names of methods, configuration keys, their defaults, and the environment variables below.
METHODS = ("mad", "nsigma", "iqr", "pca", "isolation_forest")


@dataclass(frozen=True)
class AnalysisSettings:
    window_seconds: int = 300
    min_reference_points: int = 20
    min_coverage_ratio: float = 0.8
    max_rows: int = 500_000
    random_seed: int = 42
    pca_components: int = 5
    forest_trees: int = 32
    forest_samples: int = 256
    eda_max_visual_entities: int = 2
    eda_max_visual_features: int = 16
    eda_max_correlation_features: int = 128
    methods: tuple[str, ...] = METHODS

    def __post_init__(self):
        object.__setattr__(self, "methods", tuple(self.methods))
        checks = [
            (self.window_seconds > 0, "window_seconds must be positive"),
            (self.min_reference_points >= 5, "min_reference_points must be 5 or more"),
            (0 < self.min_coverage_ratio <= 1, "min_coverage_ratio must be above 0 and at most 1"),
            (self.max_rows > 0, "max_rows must be positive"),
            (min(self.pca_components, self.forest_trees, self.forest_samples) >= 1, "model parameters must be 1 or more"),
            (min(self.eda_max_visual_entities, self.eda_max_visual_features, self.eda_max_correlation_features) >= 0, "limits must not be negative"),
            (bool(self.methods) and set(self.methods) <= set(METHODS), f"methods must be some of {METHODS}"),
        ]
        for good, why in checks:
            if not good:
                raise ValueError(why)

    @classmethod
    def of(cls, config: Mapping) -> AnalysisSettings:
        return cls(**{f.name: config[f.name] for f in fields(cls) if f.name in config})


@dataclass(frozen=True)
class RuntimeSettings:
    data_root: Path | None = None
    log_root: Path | None = None
    api_url: str | None = None
    authorization: str | None = field(default=None, repr=False)

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> RuntimeSettings:
        folder = lambda k: Path(env[k]).expanduser() if env.get(k) else None
        return cls(folder("RCA_DATA_ROOT"), folder("RCA_LOG_ROOT"), env.get("RCA_VM_API_URL") or None, env.get("RCA_VM_AUTHORIZATION") or None)


def load_config(path: str | Path) -> dict:
    found = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(found, dict):
        raise ValueError(f"{path}: an object is expected")
    return found


def load_recipes(path: str | Path) -> list[dict]:
    config = load_config(path)
    if config.get("version") != 1 or not isinstance(config.get("recipes"), list):
        raise ValueError("a recipe file has version 1 and a list of recipes")
    return config["recipes"]
