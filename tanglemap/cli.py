"""Command line over a snapshot folder: ``python -m tanglemap.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanglemap import gate
from tanglemap.config import load_config
from tanglemap.operators import coupling, coverage, graph, history, search, search_index
from tanglemap.sources import files, gitlog
from tanglemap.sources.catalog import Catalog

log = logging.getLogger("tanglemap")
IMPACT_SHOWN = 20  # nodes that the text form of ``impact`` lists


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tanglemap")
    top.add_argument("--project", default=".")
    top.add_argument("--store", default=".tanglemap")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> None:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a, nargs="+" if a == "files" else "?" if a == "path" else None)
        for flag, default in options.items():
            if default is False:
                p.add_argument(f"--{flag}", action="store_true")
            else:
                p.add_argument(f"--{flag.replace('_', '-')}", default=default, type=type(default) if default is not None else str)

    add("index", "path")
    add("search", "query", kind=None, limit=20, like=False)
    add("semantic", "query", limit=10)
    add("summary", "file")
    add("impact", "files", depth=2)
    add("imports", "module")
    add("status")
    add("callers", "name")
    add("untested", "path")
    for name in ("coupling", "metrics"):
        add(name, sort="fan_in", limit=20)
    add("baseline", "action", file="baseline.json", reporter="")
    add("hotspots", limit=20, since=None, min_coupling=0.0)
    add("temporal-coupling", limit=20, since=None, min_shared=5, min_ratio=0.3)
    add("bus-factor", limit=20)
    add("git-coupling", limit=10, since=None, min_shared=5, min_ratio=0.3)
    add("report", sort="fan_in", limit=10, since=None, min_shared=5, min_ratio=0.3)
    return top


INDEXED_FIRST = frozenset("summary impact imports callers untested coupling metrics hotspots bus-factor git-coupling report".split())


def prepare_store(store: str) -> None:
    """A folder that version control ignores but for the baseline; a remote store is left alone."""
    if "://" not in store:
        folder = Path(store)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / ".gitignore").write_text("*\n!.gitignore\n!baseline.json\n")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tanglemap").getOrCreate()
    config = load_config(f"{args.project}/tanglemap.toml")
    prepare_store(args.store)
    catalog = Catalog(spark, args.store)

    def scan(root: str) -> DataFrame:
        ignore = Path(root) / ".tanglemapignore"
        return files.scan_files(spark, root, files.read_patterns(ignore.read_text()) if ignore.is_file() else ())

    if args.command in INDEXED_FIRST:
        try:
            catalog.index(scan(args.project))
        except Exception as failed:  # the command goes on with what is stored, if anything is
            log.warning("could not index %s", args.project, exc_info=True)
            print(f"could not index {args.project}: {failed}", file=sys.stderr)
            if catalog.current() is None:
                return 1
    nodes, edges = catalog.read("nodes"), catalog.read("edges")

    def show(limit: int | None = None, **tables: DataFrame) -> int:
        """All rows as JSON, or as text, then of each table ``limit`` at most."""
        if args.json:
            print("{", end="")
            for i, (name, df) in enumerate(tables.items()):
                print(f"{', ' if i else ''}{json.dumps(name)}: [", end="")
                for j, row in enumerate(df.toJSON().toLocalIterator()):
                    print(f"{', ' if j else ''}{row}", end="")
                print("]", end="")
            print("}")
            return 0
        for name, df in tables.items():
            print(f"{name}: {df.count()}")
            for row in (df if limit is None else df.limit(limit)).toJSON().toLocalIterator():
                print("  " + ", ".join(f"{k}={v}" for k, v in json.loads(row).items()))
        return 0

    def state() -> gate.State:
        return gate.state_of(nodes, edges, config.thresholds.god_percentile)

    def changes() -> DataFrame:
        return gitlog.parse_numstat(gitlog.log_lines(spark, args.project, "--numstat", args.since))

    def pairs() -> DataFrame:
        return history.temporal_coupling(changes().select("commit_id", "file_path"), args.min_shared, args.min_ratio).orderBy(F.desc("shared_commits"), "file_a", "file_b")

    def authors() -> DataFrame:
        known = nodes.filter("kind = 'File'").select("file_path")
        return history.bus_factor(gitlog.blame(spark, args.project, known)).orderBy("bus_factor", F.desc("top_author_pct"), "file_path")

    def hot(limit: int) -> DataFrame:
        return history.hotspots(state().metrics, history.churn(changes()), limit)

    def ranked(metrics: DataFrame) -> DataFrame:
        return metrics.orderBy(F.desc(args.sort), "file_path")

    match args.command:
        case "index":
            print(json.dumps(catalog.index(scan(args.path or args.project))))
            return 0
        case "search":
            if args.like:
                return show(results=search.like_search(nodes, args.query, args.limit, args.kind))
            index = catalog.search_index()
            if index.blocks.isEmpty():  # written by an older version
                docs = nodes.select(F.col("qualified_name").alias("node_id"), "kind", "name", F.concat_ws(" ", "qualified_name", "signature", "docstring").alias("body"))
                found = search.bm25_search(docs, args.query, args.limit, args.kind)
            else:
                found = search_index.search_index(index, args.query, args.limit, args.kind)
            return show(results=found.join(nodes, found.node_id == nodes.qualified_name).select("kind", "qualified_name", "signature", "file_path", "line_start", "score").orderBy("score", "qualified_name"))
        case "semantic":
            found = search.semantic_search(catalog.read("embeddings"), args.query, args.limit)
            return show(results=found.join(nodes, "qualified_name").select("kind", "qualified_name", "signature", "distance").orderBy("distance", "qualified_name"))
        case "summary":
            row = search.file_summary(nodes, edges, spark.createDataFrame([(args.file,)], "file_path string"))
            if row.filter("nodes is not null").isEmpty():
                print(json.dumps({"error": f"file not found: {args.file}"}) if args.json else f"file not found: {args.file}")
                return 1
            return show(summary=row)
        case "impact":
            seeds = spark.createDataFrame([(f,) for f in args.files], "file_path string")
            found = graph.impact_of_files(nodes, edges, seeds, args.depth)
            names = lambda df: df.select("kind", "qualified_name", "file_path").orderBy("qualified_name")
            return show(IMPACT_SHOWN, changed_nodes=names(found.changed), impacted_nodes=names(found.impacted), impacted_files=found.files.orderBy("file_path"))
        case "imports":
            return show(imports=edges.filter((F.col("kind") == "IMPORTS_FROM") & F.col("dst").ilike(f"%{args.module}%")).orderBy("file_path", "line"))
        case "status":
            return show(status=graph.index_stats(nodes, edges, catalog.read("embeddings")), nodes_by_kind=graph.kind_counts(nodes).orderBy("kind"), edges_by_kind=graph.kind_counts(edges).orderBy("kind"))
        case "callers":
            return show(callers=graph.callers_of(edges, nodes, args.name))
        case "untested":
            return show(untested=coverage.uncovered_symbols(nodes, edges.filter("kind = 'COVERS'"), args.path).select("kind", "qualified_name", "file_path", "line_start").orderBy("qualified_name"))
        case "coupling" | "metrics":
            now = state()
            flagged = coupling.flagged_modules(now.metrics, config.thresholds.instability, config.thresholds.god_percentile)
            return show(args.limit, modules=ranked(now.metrics), cycles=now.cycles, flagged=flagged)
        case "baseline":
            path = Path(args.store) / args.file
            if args.action == "save":
                gate.save_baseline(state(), path)
                return 0
            if not path.is_file():
                print(json.dumps({"error": "no baseline"}) if args.json else "no baseline")
                return 0
            found = gate.compare(gate.read_baseline(spark, str(path)), state())
            lines = {"github": gate.github_lines, "gitlab": gate.gitlab_lines}.get(args.reporter)
            print("\n".join(lines(found, config.severity)) if lines else json.dumps(found.__dict__))
            return int(found.blocking(config.severity))
        case "hotspots":
            return show(hotspots=hot(args.limit).filter(F.col("coupling") >= args.min_coupling))
        case "temporal-coupling":
            return show(args.limit, pairs=pairs())
        case "bus-factor":
            return show(files=authors().limit(args.limit) if args.limit else authors())
        case "git-coupling":
            return show(args.limit, hotspots=hot(args.limit), pairs=pairs(), files=authors().limit(args.limit))
        case "report":
            now = state()
            return show(args.limit, modules=ranked(now.metrics), cycles=now.cycles, hubs=now.gods, hotspots=hot(args.limit).filter("hotspot_score > 0"), pairs=pairs(), single_author=authors().filter("bus_factor = 1"))
    return 2


if __name__ == "__main__":
    sys.exit(main())
