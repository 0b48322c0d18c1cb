"""Thresholds and severities from a TOML file; what is absent has its default."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

SEVERITIES = ("error", "warning", "info")


@dataclass(frozen=True)
class Thresholds:
    instability: float = 0.8
    god_percentile: int = 90
    max_inheritance_depth: int = 5
    max_children: int = 10


@dataclass(frozen=True)
class Severity:
    cycles: str = "error"
    god_modules: str = "warning"
    instability: str = "warning"
    inheritance: str = "info"


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = field(default_factory=Thresholds)
    severity: Severity = field(default_factory=Severity)


def load_config(path: str | Path) -> Config:
    """Tables ``[metrics.thresholds]`` and ``[metrics.severity]``; a missing file is all
    defaults, an unknown severity a ValueError."""
    path = Path(path)
    metrics = tomllib.loads(path.read_text()).get("metrics", {}) if path.exists() else {}

    def pick(kind, values):
        return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})

    severity = pick(Severity, metrics.get("severity", {}))
    for f in fields(severity):
        if getattr(severity, f.name) not in SEVERITIES:
            raise ValueError(f"severity of {f.name}: {getattr(severity, f.name)!r} is none of {', '.join(SEVERITIES)}")
    return Config(pick(Thresholds, metrics.get("thresholds", {})), severity)
