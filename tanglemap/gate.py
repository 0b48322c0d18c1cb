"""Baseline files and the gate that compares the current graph with one."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanglemap.config import Severity
from tanglemap.operators import coupling, graph, snapshot

BASELINE = "saved_at string, modules array<struct<file_path: string, fan_in: double, fan_out: double, instability: double>>, cycles array<array<string>>, god_modules array<string>"


@dataclass
class State:
    """Metrics, cycles and hubs of one graph."""

    metrics: DataFrame
    cycles: DataFrame
    gods: DataFrame


def state_of(nodes: DataFrame, edges: DataFrame, percentile: int = 90, resolve: bool = False) -> State:
    """``resolve``: cycles run over resolved imports rather than raw targets."""
    files = nodes.filter("kind = 'File'").select("file_path")
    resolved = coupling.resolve_imports(edges.filter("kind = 'IMPORTS_FROM'").select("kind", "src", "dst"), files)
    uses = edges.filter("kind = 'USES_TYPE'").select("kind", "src", "dst", F.col("dst").alias("resolved"))
    metrics = coupling.module_metrics(files, resolved.unionByName(uses), "resolved")
    raw = edges.filter(F.col("kind").isin("IMPORTS_FROM", "CALLS")).select("src", "dst")
    links = resolved.filter("resolved is not null").select("src", F.col("resolved").alias("dst")) if resolve else raw
    inside = graph.induced_edges(links, files.select(F.col("file_path").alias("node")))
    return State(metrics, graph.scc_cycles(inside), coupling.god_modules(metrics, percentile))


def save_baseline(state: State, path: str | Path) -> None:
    """Modules go to the file one by one; it takes its place when it is whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(f"{path.name}.new")
    with new.open("w") as out:
        out.write('{"saved_at": ' + json.dumps(datetime.now(UTC).isoformat()) + ', "modules": [')
        for i, r in enumerate(state.metrics.orderBy("file_path").toLocalIterator()):
            module = {"file_path": r["file_path"], "fan_in": round(r["fan_in"], 3), "fan_out": round(r["fan_out"], 3), "instability": round(r["instability"], 4)}
            out.write((", " if i else "") + json.dumps(module))
        out.write('], "cycles": ' + json.dumps([list(r["members"]) for r in state.cycles.orderBy("component").toLocalIterator()]))
        out.write(', "god_modules": ' + json.dumps([r["file_path"] for r in state.gods.orderBy("file_path").toLocalIterator()]) + "}")
    new.replace(path)


def read_baseline(spark: SparkSession, path: str) -> State:
    rows = spark.read.schema(BASELINE).option("multiLine", True).json(path)
    metrics = rows.select(F.explode("modules").alias("m")).select("m.*")
    cycles = rows.select(F.explode("cycles").alias("members")).select(F.array_min("members").alias("component"), F.array_sort("members").alias("members"))
    return State(metrics, cycles, rows.select(F.explode("god_modules").alias("file_path")))


@dataclass
class Findings:
    cycles: list[list[str]]
    gods: list[str]
    regressions: list[dict]

    def blocking(self, severity: Severity) -> bool:
        """Whether anything of severity error is new."""
        return any(rows and level == "error" for rows, level in ((self.cycles, severity.cycles), (self.gods, severity.god_modules), (self.regressions, severity.instability)))


def compare(before: State, now: State, tolerance: float = snapshot.TOLERANCE) -> Findings:
    cycles = snapshot.new_rows(before.cycles, now.cycles, "members")
    gods = snapshot.new_rows(before.gods, now.gods, "file_path")
    worse = snapshot.instability_regressions(before.metrics, now.metrics, tolerance)
    return Findings([list(r[0]) for r in cycles.collect()], sorted(r[0] for r in gods.collect()), [r.asDict() for r in worse.orderBy("file_path").collect()])


def messages(found: Findings, severity: Severity) -> list[tuple[str, str, str]]:
    """(severity, file, text) of each finding that is to be shown."""
    out = [(severity.cycles, c[0], "new cycle: " + ", ".join(c)) for c in found.cycles]
    out += [(severity.god_modules, g, "new hub") for g in found.gods]
    out += [(severity.instability, r["file_path"], f"instability {r['before']} to {r['after']}") for r in found.regressions]
    return [m for m in out if m[0] != "info"]


def github_lines(found: Findings, severity: Severity) -> list[str]:
    return [f"::{level} file={path.replace('::', '/')},line=1::{text}" for level, path, text in messages(found, severity)]


def gitlab_lines(found: Findings, severity: Severity, now: int = 0) -> list[str]:
    body = [f"{level}: {path}: {text}" for level, path, text in messages(found, severity)]
    return [f"\x1b[0Ksection_start:{now}:coupling[collapsed=true]\r\x1b[0KCoupling", *body, f"\x1b[0Ksection_end:{now}:coupling\r\x1b[0K"] if body else []
