"""Versioned snapshots of the graph tables in a folder.

What a write changes is written beside what is there, and becomes current by a small
pointer file of the next number, put in place by one rename; of the pointers the highest
counts. It names the folders of each table, so tables that do not change stay where they
are, and rows can be added to one without writing the rest anew. Readers see either the old
or the new state at any moment, a failed write changes nothing, and of two writers at once
the second fails, on a store whose rename does not overwrite.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanglemap.extract.rows import edges_of, extract_sources, nodes_of
from tanglemap.functions.paths import is_test_path
from tanglemap.operators.coverage import derive_covers
from tanglemap.operators.search import Embedder, embedded, rich_text
from tanglemap.operators.search_index import BLOCKS, POSTINGS, SearchIndex, compacted, drop_files, updated
from tanglemap.operators.snapshot import incremental_diff, latest_by, overwrite_files
from tanglemap.scratch import cut

SCHEMA_VERSION = 3
POINTER = "current-"
NODES = "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, signature string, docstring string, decorators array<string>, error string"
EDGES = "kind string, src string, dst string, file_path string, line int, extra string, unresolved boolean"
FILES = "file_path string, file_hash string"
EMBEDDINGS = "qualified_name string, file_path string, embedding array<float>"
TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "embeddings": EMBEDDINGS, "postings": POSTINGS, "blocks": BLOCKS}
PARTITIONED = {"postings": "part"}
FOLDERS = 8  # so many folders of a table before its postings are written anew

#: What brings a table of an older version to the next: by the version it leaves, a function of
#: (spark, table name, the table or None). They are applied one after the other on reading.
MIGRATIONS: dict[int, Callable[[SparkSession, str, DataFrame | None], DataFrame]] = {
    1: lambda spark, name, df: spark.createDataFrame([], EMBEDDINGS) if name == "embeddings" else df,
    2: lambda spark, name, df: spark.createDataFrame([], TABLES[name]) if name in ("postings", "blocks") else df,
}


class SchemaTooNew(RuntimeError):
    """The stored snapshot was written by a later version of this library."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _pointers(self) -> list[tuple[int, str]]:
        """Numbers and names of the pointer files, lowest first."""
        fs, path = self._path(f"{POINTER}*")
        names = [found.getPath().getName() for found in fs.globStatus(path) or []]
        return sorted((int(n.removeprefix(POINTER)), n) for n in names if n.removeprefix(POINTER).isdigit())

    def _target(self, pointer: str) -> tuple[int, dict[str, list[str]]]:
        """Schema version, and the folders of each table."""
        version, rest = self.spark.read.text(f"{self.root}/{pointer}").first()[0].split(" ", 1)
        if int(version) > SCHEMA_VERSION:
            raise SchemaTooNew(f"schema {version} is newer than {SCHEMA_VERSION}")
        if int(version) < 3:  # one folder held all tables
            return int(version), {name: [f"{rest}/{name}"] for name in TABLES}
        return int(version), json.loads(rest)

    def current(self) -> str | None:
        """The folder that the last write made; None before the first."""
        pointers = self._pointers()
        if not pointers:
            return None
        return max((folder.split("/")[0] for folders in self._target(pointers[-1][1])[1].values() for folder in folders), key=lambda f: f.split("-")[1:])

    def folders(self, table: str) -> list[str]:
        """Where the rows of a table are, below the root."""
        pointers = self._pointers()
        return self._target(pointers[-1][1])[1].get(table, []) if pointers else []

    def read(self, table: str) -> DataFrame:
        pointers = self._pointers()
        if not pointers:
            return self.spark.createDataFrame([], TABLES[table])
        version, folders = self._target(pointers[-1][1])
        paths = [f"{self.root}/{folder}" for folder in folders.get(table, []) if version >= 3 or self._exists(folder)]
        parts = [self.spark.read.schema(TABLES[table]).parquet(path) for path in paths]  # each is the root of its own partitions
        out = reduce(DataFrame.unionByName, parts) if parts else None
        for step in range(version, SCHEMA_VERSION):
            out = MIGRATIONS[step](self.spark, table, out)
        return self.spark.createDataFrame([], TABLES[table]) if out is None else out

    def _exists(self, folder: str) -> bool:
        fs, path = self._path(folder)
        return fs.exists(path)

    def write(self, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """A new state: ``tables`` replace what was, ``append`` adds rows, all others stay where they
        are. Readers of the state before are left in peace; what only older ones need goes."""
        pointers = self._pointers()
        version, folders = self._target(pointers[-1][1]) if pointers else (SCHEMA_VERSION, {})
        number = pointers[-1][0] + 1 if pointers else 1
        folder = f"snapshot-{number:012d}-{uuid.uuid4().hex}"
        if version < SCHEMA_VERSION:
            tables = {name: self.read(name) for name in TABLES} | tables
        state = {}
        for name in TABLES:
            added = tables[name] if name in tables else (append or {}).get(name)
            state[name] = [] if name in tables else list(folders.get(name, []))
            if added is not None:
                by = [PARTITIONED[name]] if name in PARTITIONED else []
                added.write.partitionBy(*by).parquet(f"{self.root}/{folder}/{name}")
                state[name].append(f"{folder}/{name}")
        fs, new = self._path(f"new-{folder}")
        out = fs.create(new, True)
        out.write(bytearray(f"{SCHEMA_VERSION} {json.dumps(state)}".encode()))
        out.close()
        _, pointer = self._path(f"{POINTER}{number:012d}")
        if fs.exists(pointer) or not fs.rename(new, pointer):
            fs.delete(new, False)
            fs.delete(self._path(folder)[1], True)
            raise RuntimeError("another writer was first")
        used = {f for kept in (state, folders) for names in kept.values() for f in names}
        for _, old in pointers[:-1]:
            for gone in {f for names in self._target(old)[1].values() for f in names} - used:
                fs.delete(self._path(gone)[1], True)
            fs.delete(self._path(old)[1], False)

    def search_index(self) -> SearchIndex:
        """Of all nodes, by qualified name; see :mod:`tanglemap.operators.search_index`."""
        return SearchIndex(self.read("postings"), self.read("blocks"))

    def index(self, sources: DataFrame, embed: Embedder | None = None) -> dict[str, int]:
        """Brings the graph up to date with ``sources(path, text, file_hash)``: only new and
        changed files are parsed and embedded, vanished ones go, coverage edges are derived
        anew. ``embed``: see :func:`tanglemap.operators.search.embedded`."""
        found = cut(sources.select(F.col("path").alias("file_path"), "text", "file_hash"))  # read by several steps
        status = cut(incremental_diff(self.read("files"), found.select("file_path", "file_hash")))
        todo = status.filter(F.col("status").isin("new", "changed")).select("file_path")
        parsed = extract_sources(found.join(todo, "file_path", "left_semi").withColumnRenamed("file_path", "path"))
        gone = status.filter(F.col("status") != "unchanged").select("file_path")
        nodes = overwrite_files(self.read("nodes"), nodes_of(parsed), gone)
        nodes = cut(latest_by(nodes, ["qualified_name"], ["file_path", "line_start"]))
        edges = cut(overwrite_files(self.read("edges").filter("kind <> 'COVERS'"), edges_of(parsed), gone))
        open_calls = edges.filter("kind = 'CALLS' and unresolved").filter(is_test_path(F.col("file_path"))).select("src", "dst", "file_path", "line").distinct()
        covers = derive_covers(open_calls, nodes).select(F.lit("COVERS").alias("kind"), "src", "dst", "file_path", "line", F.lit(None).cast("string").alias("extra"), F.lit(False).alias("unresolved"))
        texts = rich_text(nodes, edges.filter("kind = 'IMPORTS_FROM'"), edges.filter("kind = 'CALLS'")).join(todo, "file_path", "left_semi")
        vectors = overwrite_files(self.read("embeddings"), embedded(texts.select("qualified_name", "file_path", "text"), embed), gone)
        counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        index, postings = self._searchable(nodes, gone, todo)
        anew = len(self.folders("postings")) >= FOLDERS
        replaced = {"postings": compacted(index)} if anew else {}
        added = {} if anew else {"postings": postings}
        self.write(append=added, nodes=nodes, edges=edges.unionByName(covers), files=found.select("file_path", "file_hash"), embeddings=vectors, blocks=index.blocks, **replaced)
        errors = self.read("nodes").filter("kind = 'File' and error is not null").count()
        return {"scanned": sum(counts.values()) - counts.get("removed", 0), "indexed": counts.get("new", 0) + counts.get("changed", 0), "skipped": counts.get("unchanged", 0), "removed": counts.get("removed", 0), "errors": errors, "covers": self.read("edges").filter("kind = 'COVERS'").count()}

    def _searchable(self, nodes: DataFrame, gone: DataFrame, todo: DataFrame) -> tuple[SearchIndex, DataFrame]:
        """The index without the files ``gone`` and with the nodes of ``todo``, and the new postings; of
        all nodes where nothing was indexed before. A write's number is that of its generation."""
        before = self.search_index()
        fresh = nodes if before.blocks.isEmpty() else nodes.join(todo, "file_path", "left_semi")
        docs = fresh.select(F.col("qualified_name").alias("node_id"), "kind", "name", F.concat_ws(" ", "qualified_name", "signature", "docstring").alias("body"), "file_path")
        pointers = self._pointers()
        return updated(before, gone, docs, pointers[-1][0] + 1 if pointers else 1)

    def remove(self, files: DataFrame) -> None:
        """Drops the rows of ``files(file_path)`` from all tables; postings go with their blocks."""
        by_file = {name: self.read(name) for name in TABLES if name not in ("postings", "blocks")}
        kept = {name: df.join(files.select("file_path"), "file_path", "left_anti").select(*df.columns) for name, df in by_file.items()}
        self.write(**kept, blocks=drop_files(self.read("blocks"), files))
