"""Rows that an extractor gathers for one file, and the Spark job that runs extractors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = (
    "record string, kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, "
    "signature string, docstring string, decorators array<string>, src string, dst string, line int, extra string, error string"
)
NODE_KINDS = ("File", "Class", "Function", "Method")
EDGE_KINDS = ("CONTAINS", "HAS_METHOD", "IMPORTS_FROM", "INHERITS", "CALLS", "USES_TYPE", "COVERS")
ARROW = pa.schema([(n, {"int": pa.int32(), "string": pa.string()}.get(t, pa.list_(pa.string()))) for n, t in (part.split(" ") for part in SCHEMA.split(", "))])


@dataclass
class Extract:
    path: str
    language: str
    rows: list[dict] = field(default_factory=list)
    calls: list[tuple[str, str | None, str, int]] = field(default_factory=list)
    types: set[str] = field(default_factory=set)
    error: str | None = None

    def node(self, kind: str, name: str, start: int, end: int, parent: str | None = None, signature: str | None = None, docstring: str | None = None, decorators: list[str] | None = None) -> None:
        qualified = self.path if kind == "File" else f"{self.path}::{parent}.{name}" if parent else f"{self.path}::{name}"
        self.rows.append({"record": "node", "kind": kind, "name": name, "qualified_name": qualified, "line_start": start, "line_end": end, "parent_name": parent, "signature": signature, "docstring": docstring, "decorators": decorators or []})

    def edge(self, kind: str, src: str, dst: str, line: int, extra: dict | None = None) -> None:
        self.rows.append({"record": "edge", "kind": kind, "src": src, "dst": dst, "line": line, "extra": json.dumps(extra) if extra else None})

    def uses(self, name: str, line: int) -> None:
        """A type that the file uses; the first use counts."""
        if name not in self.types:
            self.types.add(name)
            self.edge("USES_TYPE", self.path, name, line)

    def call(self, caller: str, parent: str | None, callee: str, line: int) -> None:
        self.calls.append((caller, parent, callee, line))

    def resolve(self) -> None:
        """Calls to edges: the method of the caller's class first, else the file's only symbol of
        the name; a test file keeps unresolved bare names, marked as such."""
        by_name: dict[str, list[str]] = {}
        for row in self.rows:
            if row["record"] == "node" and row["kind"] != "File":
                names = [row["name"], *([f"{row['parent_name']}.{row['name']}"] if row["parent_name"] else [])]
                for name in names:
                    by_name.setdefault(name, []).append(row["qualified_name"])
        base = self.path.rsplit("/", 1)[-1]
        test = base.startswith("test_") or base.endswith(("_test.py", ".test.ts", ".test.js", ".spec.ts", ".spec.js"))
        for caller, parent, callee, line in self.calls:
            owner, _, bare = callee.rpartition(".")
            if owner in ("self", "this"):
                found = by_name.get(f"{parent}.{bare}", [])[:1]
            elif owner:
                found = by_name.get(callee, [])[:1]
            else:
                found = by_name.get(f"{parent}.{callee}", [])[:1] or (by_name[callee] if len(by_name.get(callee, [])) == 1 else [])
            if found and found[0] != caller:
                self.edge("CALLS", caller, found[0], line)
            elif not found and test:
                self.edge("CALLS", caller, bare, line, {"unresolved": True})


ROWS_HELD = 5_000  # rows, and those of one file more, that a task gathers before it hands them on


def extract_sources(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """``files(path, text)`` to node and edge rows (``record`` tells which). Each file is parsed
    alone, so this is one pass without a shuffle; files without a parser give no row.
    ``partitions``: deals the files out first, for a table that lies in few."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tanglemap.extract.python_source import extract_python
        from tanglemap.extract.script_source import extract_script

        rows: list[dict] = []
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                suffix = path.rsplit(".", 1)[-1] if path and "." in path else ""
                parser = extract_python if suffix == "py" else extract_script if suffix in ("js", "jsx", "ts", "tsx") else None
                if parser:
                    found = parser(path, text or "")
                    rows.extend(row | {"file_path": path, "language": found.language, "error": found.error} for row in found.rows)
                if len(rows) >= ROWS_HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    files = files.select("path", "text")
    return (files if partitions is None else files.repartition(partitions, "path")).mapInArrow(parse, SCHEMA)


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.filter("record = 'node'").select("kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "parent_name", "signature", "docstring", "decorators", "error")


def edges_of(rows: DataFrame) -> DataFrame:
    return rows.filter("record = 'edge'").select("kind", "src", "dst", "file_path", "line", "extra", F.coalesce(F.get_json_object("extra", "$.unresolved") == "true", F.lit(False)).alias("unresolved"))
