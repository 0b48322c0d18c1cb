import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F
from tanglemap import gate
from tanglemap.config import Severity, load_config
from tanglemap.extract.python_source import extract_python
from tanglemap.extract.script_source import extract_script
from tanglemap.functions import paths
from tanglemap.operators import coupling, coverage, graph, history, search, snapshot
from tanglemap.operators.components import connected_components
from tanglemap.sources import gitlog
from tanglemap.sources.catalog import Catalog, SchemaTooNew
from tanglemap.sources.files import scan_files
from tanglemap.streaming.history import append_changes, windowed_churn

EDGE = "kind string, src string, dst string"


def files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def imports(spark, *pairs, kind="IMPORTS_FROM"):
    return spark.createDataFrame([(kind, a, b) for a, b in pairs], EDGE)


def metrics(spark, names, edges):
    return {r["file_path"]: r for r in coupling.module_metrics(files(spark, *names), edges).collect()}


def test_metrics(spark):
    got = metrics(spark, ["a", "b", "c", "d"], imports(spark, ("a", "c"), ("b", "c"), ("c", "flask"), ("a", "x"), ("a", "y")).union(imports(spark, ("a", "T"), kind="USES_TYPE")))
    assert (got["c"]["fan_in"], got["c"]["fan_out"], got["c"]["instability"]) == (2.0, 1.0, pytest.approx(1 / 3))
    assert got["a"]["fan_out"] == 4.0 and got["d"]["instability"] == 0.0


def test_import_resolution(spark):
    known = files(spark, "pkg/models.py", "pkg/cli.py", "pkg/parser/__init__.py", "top.py")
    edges = imports(spark, ("pkg/cli.py", "pkg.models"), ("pkg/cli.py", ".models"), ("pkg/cli.py", "models"), ("pkg/cli.py", ".parser"), ("pkg/parser/__init__.py", "..models"), ("pkg/cli.py", "networkx"), ("top.py", "pkg/models.py"), ("top.py", "pkg"))
    got = [r["resolved"] for r in coupling.resolve_imports(edges, known).collect()]
    assert sorted(map(str, got)) == sorted(["pkg/models.py"] * 5 + ["pkg/parser/__init__.py", "None", "None"])


def test_god_modules_match_exclusive_quantile(spark):
    rng = random.Random(1)
    for n in (2, 5, 9, 10, 37):
        for p in (10, 90):
            values = [float(rng.randrange(12)) for _ in range(n)]
            rows = spark.createDataFrame([(str(i), v, 0.0, 0.0) for i, v in enumerate(values)], "file_path string, fan_in double, fan_out double, instability double")
            limit = statistics.quantiles(values, n=100)[p - 1]
            assert {r[0] for r in coupling.god_modules(rows, p).collect()} == {str(i) for i, v in enumerate(values) if v > limit}
    assert coupling.god_modules(rows.limit(1)).count() == 0
    with pytest.raises(ValueError):
        coupling.god_modules(rows, 100)


def test_inheritance(spark):
    classes = spark.createDataFrame([(c,) for c in "ABCDXY"], "qualified_name string")
    inherits = spark.createDataFrame([("B", "A", 1), ("C", "B", 2), ("D", "ext", 3), ("X", "Y", 4), ("Y", "X", 5)], "src string, dst string, id int")
    got = {r["qualified_name"]: (r["depth"], r["children"]) for r in coupling.inheritance_metrics(classes, inherits).collect()}
    assert got == {"A": (0, 1), "B": (1, 1), "C": (2, 0), "D": (1, 0), "X": (2, 1), "Y": (2, 1)}


def test_inheritance_has_no_depth_limit(spark):
    chain = [(f"a{i}", f"a{i - 1}", i) for i in range(1, 200)]
    ring = [(f"r{i}", f"r{(i + 1) % 100}", 1_000 + i) for i in range(100)]
    tail = [(f"t{i}", f"t{i - 1}" if i else "r7", 2_000 + i) for i in range(30)] + [("s", "s", 3_000), ("u", "s", 3_001), ("twice", "a5", 1), ("twice", "a9", 2)]
    inherits = spark.createDataFrame(chain + ring + tail, "src string, dst string, id int")
    classes = inherits.select(F.col("src").alias("qualified_name")).union(inherits.select("dst")).distinct()
    got = {r["qualified_name"]: r["depth"] for r in coupling.inheritance_metrics(classes, inherits).collect()}
    want = {f"a{i}": i for i in range(200)} | {f"r{i}": 100 for i in range(100)} | {f"t{i}": 101 + i for i in range(30)} | {"s": 1, "u": 2, "twice": 10}
    assert got == want


def test_scc_and_components_on_random_graphs(spark):
    rng = random.Random(4)
    for _ in range(3):
        n = 14
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(22)})
        reach = {a: {a} for a in range(n)}
        both = {a: {a} for a in range(n)}
        for _ in range(n):
            for a, b in edges:
                for x in range(n):
                    if a in reach[x]:
                        reach[x].add(b)
                    if a in both[x] or b in both[x]:
                        both[x] |= {a, b}
        want = {tuple(sorted(b for b in reach[a] if a in reach[b])) for a in range(n)}
        frame = spark.createDataFrame(edges, "src int, dst int")
        assert {tuple(r["members"]) for r in graph.scc_cycles(frame).collect()} == {w for w in want if len(w) > 1}
        linked = {a for e in edges for a in e if e[0] != e[1]}
        assert {(r["node"], r["component"]) for r in connected_components(frame).collect()} == {(a, min(both[a])) for a in linked}
    assert graph.scc_cycles(frame.limit(0)).count() == 0 and connected_components(frame.limit(0)).count() == 0


def test_traversal(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "src string, dst string")
    seed = spark.createDataFrame([("0",)], "node string")
    assert graph.impact_radius(chain, seed, 10, 3).count() == 4
    assert graph.impact_radius(chain, seed).count() == 3
    assert [r["chain"] for r in graph.dependency_chain(chain, "0", 2).orderBy("depth").collect()] == [["0", "1"], ["0", "1", "2"]]
    assert graph.dependency_chain(chain, "none", 5).count() == 0 and graph.dependency_chain(chain, "0", 0).count() == 0


def test_history(spark):
    text = ["a" * 40, "3\t1\tauth.py", "10\t5\tmodels.py", "-\t-\timage.png"], ["b" * 40, "1\t0\tauth.py", "2\t2\tutils.py"]
    lines = spark.createDataFrame([(c, i, line) for c, commit in enumerate(text) for i, line in enumerate(commit)], "file_no long, line_no int, line string")
    churned = history.churn(gitlog.parse_numstat(lines))
    got = {r["file_path"]: (r["commits"], r["lines_added"], r["lines_deleted"]) for r in churned.collect()}
    assert got == {"auth.py": (2, 4, 1), "models.py": (1, 10, 5), "utils.py": (1, 2, 2), "image.png": (1, 0, 0)}
    m = spark.createDataFrame([("auth.py", 0.0, 1.0)], "file_path string, fan_in double, fan_out double")
    assert history.hotspots(m, churned).first()["hotspot_score"] == 2.0
    names = spark.createDataFrame([("A", "auth"), ("A", "models"), ("B", "auth"), ("B", "utils"), ("C", "models"), ("C", "utils")], "commit_id string, file_path string")
    pairs = history.temporal_coupling(names, 1, 0.3).collect()
    assert len(pairs) == 3 and {r["coupling_ratio"] for r in pairs} == {0.5}
    direct = spark.createDataFrame([("models", "auth")], "file_a string, file_b string")
    assert history.temporal_coupling(names, 1, 0.3, direct).count() == 2
    blame = spark.createDataFrame([("f", i, "Alice" if i <= 3 else "Bob") for i in range(1, 6)] + [("g", 1, "Eve")], "file_path string, line_no int, author string")
    got = {r["file_path"]: (r["top_author"], r["top_author_pct"], r["bus_factor"]) for r in history.bus_factor(blame).collect()}
    assert got == {"f": ("Alice", 60.0, 2), "g": ("Eve", 100.0, 1)}


def test_coverage(spark):
    symbols = spark.createDataFrame([("Function", n, f"src/math.py::{n}", "src/math.py", None) for n in ("add", "subtract", "multiply")] + [("Function", "test_add", "tests/test_math.py::test_add", "tests/test_math.py", None)], "kind string, name string, qualified_name string, file_path string, parent_name string")
    calls = spark.createDataFrame([("t::test_add", "add"), ("t::test_subtract", "subtract")], "src string, dst string")
    covers = coverage.derive_covers(calls, symbols)
    assert covers.count() == 2
    assert [r["name"] for r in coverage.uncovered_symbols(symbols, covers).collect()] == ["multiply"]
    assert {(r["dst"], r["tests"]) for r in coverage.cover_counts(calls.union(calls), symbols).collect()} == {("src/math.py::add", 2), ("src/math.py::subtract", 2)}


def test_path_predicates(spark):
    names = ["test_a.py", "a_test.py", "x/test_b.js", "a.spec.ts", "a.spec.tsx", "latest.py", "tests/a.py", "src/testing.py", "contest.py"]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r[0]: (r[1], r[2], r[3]) for r in rows.select("path", paths.is_test_file(F.col("path")), paths.is_test_path(F.col("path")), paths.is_test_path(F.col("path"), strict=True)).collect()}
    assert [n for n in names if got[n][0]] == ["test_a.py", "a_test.py", "x/test_b.js", "a.spec.ts"]
    assert got["src/testing.py"][1] and not got["src/testing.py"][2] and got["latest.py"][1] and not got["latest.py"][2]
    table = {"secret.py": (["secret.py", "a/secret.py"], ["secret.pyx"]), "*.generated.py": (["a/b.generated.py"], ["generated.py"]), "tests/": (["tests/a.py", "x/tests/a/b.py"], ["tests.py"]), "vendor": (["vendor/a.py"], ["vendors/a.py"]), "src/*/generated.py": (["src/auth/generated.py"], ["src/generated.py"])}
    for pattern, (yes, no) in table.items():
        rows = spark.createDataFrame([(n,) for n in yes + no], "path string")
        assert {r[0] for r in rows.filter(paths.ignored(F.col("path"), [pattern])).collect()} == set(yes), pattern


def test_search(spark):
    docs = spark.createDataFrame([(1, "Class", "AuthService", "Handles user authentication"), (2, "Method", "validateEmail", ""), (3, "Method", "create_user", "Creates a new user account"), (4, "Function", "health_check", None)], "node_id int, kind string, name string, body string")

    def found(query, **more):
        return [r["node_id"] for r in search.bm25_search(docs, query, **more).collect()]

    assert found("auth") == [1] and found("authservice") == [1] and found("email") == [2] and set(found("user")) == {1, 3}
    assert found("user account") == [3] and found("heal") == [4] and found("user", kind="Method") == [3]
    assert found("") == [] and found("?!") == [] and found("nothing") == []
    assert found("create_us") == [3] and found("user_create") == [3] and found("health_check") == [4]
    accents = docs.union(spark.createDataFrame([(5, "Class", "Café", "Ärger über Öl")], docs.schema))
    for word in ("cafe", "CAFÉ", "ÜBER", "arger"):
        assert [r["node_id"] for r in search.bm25_search(accents, word).collect()] == [5]
    assert search.query_terms("auth") == [("auth",)] * 2 and search.query_terms("a_b") == [("a", "b")] * 2
    unit = docs.select(search.hashing_embedding(F.col("name"), 16).alias("v")).first()["v"]
    assert len(unit) == 16 and abs(sum(x * x for x in unit) - 1) < 1e-5


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", ""), ("d", "4")], "file_path string, file_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", ""), ("e", "5")], "file_path string, file_hash string")
    got = {r[0]: r[1] for r in snapshot.incremental_diff(old, new).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "changed", "d": "removed", "e": "new"}
    assert snapshot.overwrite_files(old, new.filter("file_path = 'b'"), new.filter("file_path in ('b', 'a')")).count() == 3


def test_extractors():
    source = '"""Doc."""\nimport a, b\nfrom ..x.y import z\n@deco\nclass C(Base, metaclass=M):\n    """Cdoc."""\n    def run(self, q: Item = None) -> Out:\n        self.stop()\n        def inner():\n            helper()\n    def stop(self): ...\ndef helper(): ...\nif True:\n    def hidden(): ...\n'
    out = extract_python("p/c.py", source)
    nodes = [(r["kind"], r["name"]) for r in out.rows if r["record"] == "node"]
    assert nodes == [("File", "c.py"), ("Class", "C"), ("Method", "run"), ("Method", "stop"), ("Function", "helper")]
    edges = {(r["kind"], r["dst"]) for r in out.rows if r["record"] == "edge"}
    assert {("IMPORTS_FROM", "a"), ("IMPORTS_FROM", "x.y"), ("INHERITS", "Base"), ("USES_TYPE", "Item"), ("USES_TYPE", "Out"), ("CALLS", "p/c.py::C.stop"), ("CALLS", "p/c.py::helper")} <= edges
    assert ("INHERITS", "M") not in edges and extract_python("x.py", "def (").error
    tests = extract_python("tests/test_x.py", "def test_a():\n    thing()\n")
    assert [r["extra"] for r in tests.rows if r.get("kind") == "CALLS"] == ['{"unresolved": true}']
    script = extract_script("w.ts", '/** Hi\n * there */\nimport { q } from "./q";\nconst p = require("path");\nexport class W extends V {\n  constructor() { super(); }\n  run(x: Item): Out { this.stop(); }\n  stop() {}\n}\nexport const f = (a) => { g(); };\nfunction g() {}\n// class No {}\n')
    nodes = [(r["kind"], r["name"]) for r in script.rows if r["record"] == "node"]
    assert nodes == [("File", "w.ts"), ("Class", "W"), ("Method", "constructor"), ("Method", "run"), ("Method", "stop"), ("Function", "f"), ("Function", "g")]
    edges = {(r["kind"], r["dst"]) for r in script.rows if r["record"] == "edge"}
    assert {("IMPORTS_FROM", "./q"), ("IMPORTS_FROM", "path"), ("INHERITS", "V"), ("USES_TYPE", "Item"), ("CALLS", "w.ts::W.stop"), ("CALLS", "w.ts::g")} <= edges
    assert script.rows[0]["docstring"] == "Hi there"


def test_script_scanner_on_hard_cases():
    source = """const re = /["'{(]/g;
export class Box<T> extends Base<T> {
  open(size = max(1, (2)), then: Then<Item> = (a) => a): Promise<Out> {
    const seen: Seen = { kind: Wrong, other: Wrong2 };
    return this.close(/}/.test(x) ? Odd : Even);
  }
  close(p) { if (p) { help(p); } }
}
export const run = async (a = f(1), b: Kind = {}) => { help(a); };
const value = (1 + 2) * 3;
const other = call((x) => x);
function help({ a, b }, ...rest: Rest[]) { return `${"}"}`; }
"""
    out = extract_script("m.ts", source)
    nodes = [(r["kind"], r["name"], r["line_start"], r["line_end"]) for r in out.rows if r["record"] == "node"]
    assert nodes == [("File", "m.ts", 1, 12), ("Class", "Box", 2, 8), ("Method", "open", 3, 6), ("Method", "close", 7, 7), ("Function", "run", 9, 9), ("Function", "help", 12, 12)]
    types = {r["dst"] for r in out.rows if r.get("kind") == "USES_TYPE"}
    assert types == {"Then", "Item", "Promise", "Out", "Seen", "Rest"}
    calls = {(r["src"], r["dst"]) for r in out.rows if r.get("kind") == "CALLS"}
    assert calls == {("m.ts::Box.open", "m.ts::Box.close"), ("m.ts::Box.close", "m.ts::help"), ("m.ts::run", "m.ts::help")}


def test_python_texts_are_raw():
    out = extract_python("a.py", 'class A:\n    r"""raw"""\n    @deco(x,  1)\n    def f(self,\n          b: "T" = {1: 2}[1]):\n        "doc é"\n')
    rows = {r["name"]: r for r in out.rows if r["record"] == "node"}
    assert rows["A"]["docstring"] is None and rows["f"]["docstring"] == "doc é"
    assert rows["f"]["decorators"] == ["@deco(x,  1)"] and rows["f"]["signature"] == 'def f(self,\n          b: "T" = {1: 2}[1])'


def test_scan_finds_every_file(spark, tmp_path):
    root = tmp_path / "_tree"
    names = ["pkg/__init__.py", "pkg/_core.py", "_priv/b.py", "pkg/a.py", "vendor/c.py", "target/d.ts", "deep/er/x=1/e.js"]
    skipped = ["coverage/d.py", "node_modules/x.js", ".hidden/y.py", "a/dist/z.py", "a/notes.txt", "a/no.PY", "gen/out.py", "build/q.py"]
    for name in names + skipped:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}")
    (root / "pkg" / "bad.py").write_bytes(b"x = '\xff'")
    got = {r["path"]: r for r in scan_files(spark, str(root), ["gen/"]).collect()}
    assert set(got) == {*names, "pkg/bad.py"}
    assert got["pkg/a.py"]["text"] == "# pkg/a.py" and got["pkg/bad.py"]["text"] == "x = '\ufffd'"
    assert got["pkg/a.py"]["file_hash"] == hashlib.sha256(b"# pkg/a.py").hexdigest()
    assert scan_files(spark, str(tmp_path / "none")).count() == 0


def test_covers_of_an_index_keep_file_and_line(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "m.py").write_text("def f(): ...\ndef g(): ...\ndef h(): ...\n")
    (root / "test_m.py").write_text("def test_a():\n    f()\n    g()\n    h()\n")
    catalog = Catalog(spark, str(tmp_path / "store"))
    for _ in range(2):  # deriving again changes nothing
        assert catalog.index(scan_files(spark, str(root)))["covers"] == 3
        got = {(r["src"], r["dst"], r["file_path"], r["line"]) for r in catalog.read("edges").filter("kind = 'COVERS'").collect()}
        assert got == {("test_m.py::test_a", f"m.py::{name}", "test_m.py", line) for name, line in (("f", 2), ("g", 3), ("h", 4))}


def test_snapshots_swap_atomically(spark, tmp_path):
    store = tmp_path / "store"
    catalog, rows = Catalog(spark, str(store)), lambda *names: spark.createDataFrame([(n, n) for n in names], "file_path string, file_hash string")
    assert catalog.current() is None
    catalog.write(files=rows("a"))
    reader = catalog.read("files")
    catalog.write(files=rows("a", "b"))
    assert reader.count() == 1 and catalog.read("files").count() == 2  # a reader of the one before is left in peace
    before = catalog.current()
    broken = Catalog(spark, str(store))
    with pytest.raises(Exception):
        broken.write(files=rows("c").select("file_path", F.raise_error(F.lit("stop")).cast("string").alias("file_hash")))
    assert catalog.current() == before and catalog.read("files").count() == 2
    late = Catalog(spark, str(store))
    late._pointers = lambda found=late._pointers(): found  # has not seen the next write
    catalog.write(files=rows("x", "y", "z"))
    with pytest.raises(RuntimeError):
        late.write(files=rows("lost"))
    assert catalog.read("files").count() == 3
    assert len([p for p in store.iterdir() if p.name.startswith("current-")]) == 2
    (store / "current-000000000099").write_text("9 snapshot-x")
    with pytest.raises(SchemaTooNew):
        catalog.read("files")


def test_embeddings_follow_their_files(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.py").write_text("def alpha(): ...\n")
    (root / "b.py").write_text("def beta(): ...\n")
    catalog = Catalog(spark, str(tmp_path / "store"))
    lengths = lambda texts: [[len(t) / 1000, float("beta" in t)] for t in texts]
    catalog.index(scan_files(spark, str(root)), embed=lengths)
    vectors = lambda: {r["qualified_name"]: list(r["embedding"]) for r in catalog.read("embeddings").collect()}
    before = vectors()
    assert set(before) == {"a.py", "a.py::alpha", "b.py", "b.py::beta"} and before["b.py::beta"][1] == 1.0
    found = search.semantic_search(catalog.read("embeddings"), "beta in b", 2, lengths).collect()
    assert {r["qualified_name"] for r in found} == {"b.py", "b.py::beta"} and found[0]["distance"] <= found[1]["distance"]
    (root / "b.py").write_text("def gamma(): ...\n")
    (root / "a.py").unlink()
    catalog.index(scan_files(spark, str(root)), embed=lambda texts: [[0.0, 9.0] for _ in texts])
    assert vectors() == {"b.py": [0.0, 9.0], "b.py::gamma": [0.0, 9.0]}
    catalog.remove(catalog.read("files"))
    assert vectors() == {} and search.semantic_search(catalog.read("embeddings"), "x", 3).count() == 0


def test_older_snapshots_are_migrated(spark, tmp_path):
    store = tmp_path / "store"
    catalog = Catalog(spark, str(store))
    catalog.write(files=spark.createDataFrame([("a.py", "1")], "file_path string, file_hash string"))
    folder = catalog.current()
    assert not (store / folder / "embeddings").exists()  # a write stores what it is given
    (store / "current-000000000001").write_text(f"1 {folder}")
    (store / ".current-000000000001.crc").unlink(missing_ok=True)
    assert catalog.read("embeddings").count() == 0 and catalog.read("files").count() == 1
    catalog.write(nodes=catalog.read("nodes"))
    assert (store / catalog.current() / "embeddings").exists()


def test_index_and_gate(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function no() {}")
    (root / "pkg" / "a.py").write_text("import pkg.b\n")
    (root / "pkg" / "b.py").write_text("def f(): ...\n")
    (root / "test_a.py").write_text("def test_f():\n    f()\n")
    catalog = Catalog(spark, str(tmp_path / "store"))
    assert catalog.index(scan_files(spark, str(root))) == {"scanned": 3, "indexed": 3, "skipped": 0, "removed": 0, "errors": 0, "covers": 1}
    before = gate.state_of(catalog.read("nodes"), catalog.read("edges"), resolve=True)
    gate.save_baseline(before, tmp_path / "b.json")
    (root / "pkg" / "b.py").write_text("import pkg.a\ndef f(): ...\n")
    (root / "test_a.py").unlink()
    told = catalog.index(scan_files(spark, str(root)))
    assert (told["indexed"], told["skipped"], told["removed"], told["covers"]) == (1, 1, 1, 0)
    now = gate.state_of(catalog.read("nodes"), catalog.read("edges"), resolve=True)
    found = gate.compare(gate.read_baseline(spark, str(tmp_path / "b.json")), now)
    assert found.cycles == [["pkg/a.py", "pkg/b.py"]] and found.blocking(Severity()) and not found.blocking(Severity(cycles="warning", instability="warning"))
    assert gate.github_lines(found, Severity())[0].startswith("::error file=pkg/a.py,line=1::")
    assert gate.gitlab_lines(found, Severity(cycles="info", instability="info")) == []


def test_config(tmp_path):
    assert load_config(tmp_path / "none.toml").thresholds.god_percentile == 90
    (tmp_path / "c.toml").write_text("[metrics.thresholds]\ngod_percentile = 80\n[metrics.severity]\ncycles = 'warning'\n")
    assert load_config(tmp_path / "c.toml").severity.cycles == "warning"
    (tmp_path / "c.toml").write_text("[metrics.severity]\ncycles = 'fatal'\n")
    with pytest.raises(ValueError):
        load_config(tmp_path / "c.toml")


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "2024-01-01 00:00:00", "a", 1, 0), ("c1", "2024-01-01 00:00:00", "a", 1, 0), ("c2", "2024-01-02 00:00:00", "a", 2, 1), ("c3", "2024-03-01 00:00:00", "a", 2, 1)], "commit_id string, ts string, file_path string, added long, deleted long")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = windowed_churn(stream).writeStream.format("memory").queryName("churned").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sum(r["commits"] for r in spark.sql("select * from churned").collect()) == 2
    append_changes(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
