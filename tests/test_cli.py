"""Every command of the command line, on a small repository."""

import json
import subprocess

import pytest
from tanglemap import cli
from tanglemap.sources import gitlog


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "pkg").mkdir()
    git = lambda *args: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)
    git("init", "-q")
    for i in range(5):
        (root / "pkg" / "__init__.py").write_text("")
        (root / "pkg" / "a.py").write_text(f"import pkg.b\n\nclass Alpha(Base):\n    def run_all(self):\n        self.stop()\n    def stop(self):\n        return {i}\n")
        (root / "pkg" / "b.py").write_text(f"def helper():\n    return {i}\ndef unused():\n    return {i}\n")
        (root / "test_a.py").write_text("from pkg.b import helper\ndef test_it():\n    helper()\n    helper()\n")
        git("add", "-A")
        git("commit", "-qm", f"change {i}")
    return root


@pytest.fixture
def run(project, capsys):
    def run(*argv, ok=0):
        assert cli.main(["--project", str(project), "--store", str(project / "store"), *argv]) == ok
        return capsys.readouterr().out

    return run


def told(run, *argv, **more):
    return json.loads(run("--json", *argv, **more))


def test_index_and_status(run, project):
    assert json.loads(run("index", str(project)))["scanned"] == 4
    assert json.loads(run("index", str(project)))["skipped"] == 4
    found = told(run, "status")
    assert found["status"] == [{"files": 4, "total_nodes": 10, "languages": ["python"], "total_edges": found["status"][0]["total_edges"], "embeddings": 10}]
    assert {r["kind"]: r["n"] for r in found["nodes_by_kind"]} == {"File": 4, "Class": 1, "Method": 2, "Function": 3}
    assert "nodes_by_kind: 4" in run("status")
    assert (project / "store" / ".gitignore").read_text().startswith("*")


def test_search_and_semantic(run):
    assert [r["qualified_name"] for r in told(run, "search", "run_all")["results"]] == ["pkg/a.py::Alpha.run_all"]
    assert [r["qualified_name"] for r in told(run, "search", "helper", "--kind", "Function")["results"]] == ["pkg/b.py::helper"]
    assert {r["qualified_name"] for r in told(run, "search", "--like", "ELP")["results"]} == {"pkg/b.py::helper"}
    assert told(run, "search", "?!") == {"results": []}
    assert told(run, "semantic", "Function helper", "--limit", "1")["results"][0]["qualified_name"] == "pkg/b.py::helper"


def test_summary_impact_imports(run):
    found = told(run, "summary", "pkg/b.py")["summary"][0]
    assert [n["name"] for n in found["nodes"]] == ["helper", "unused"] and found["language"] == "python"
    assert told(run, "summary", "none.py", ok=1) == {"error": "file not found: none.py"}
    found = told(run, "impact", "pkg/b.py", "--depth", "1")
    assert {r["qualified_name"] for r in found["changed_nodes"]} == {"pkg/b.py", "pkg/b.py::helper", "pkg/b.py::unused"}
    assert [r["file_path"] for r in found["impacted_files"]] == ["test_a.py"]
    assert [r["file_path"] for r in told(run, "imports", "PKG.b")["imports"]] == ["pkg/a.py", "test_a.py"]


def test_callers_and_untested(run):
    assert [r["qualified_name"] for r in told(run, "callers", "pkg/a.py::Alpha.stop")["callers"]] == ["pkg/a.py::Alpha.run_all"]
    assert [r["qualified_name"] for r in told(run, "untested")["untested"]] == ["pkg/a.py::Alpha.run_all", "pkg/a.py::Alpha.stop", "pkg/b.py::unused"]
    assert [r["qualified_name"] for r in told(run, "untested", "pkg/b")["untested"]] == ["pkg/b.py::unused"]


def test_coupling_and_history(run):
    for name in ("coupling", "metrics"):
        assert told(run, name, "--limit", "1")["modules"][0]["file_path"] == "pkg/b.py" and len(told(run, name, "--limit", "1")["modules"]) == 4
    assert len([line for line in run("coupling", "--limit", "1").split("flagged")[0].splitlines() if "fan_in" in line]) == 1
    assert {(r["file_path"], r["churn"]) for r in told(run, "hotspots")["hotspots"]} == {("pkg/a.py", 5), ("pkg/b.py", 5), ("pkg/__init__.py", 1), ("test_a.py", 1)}
    assert [(r["file_a"], r["file_b"], r["shared_commits"]) for r in told(run, "temporal-coupling")["pairs"]] == [("pkg/a.py", "pkg/b.py", 5)]
    assert {(r["file_path"], r["top_author"], r["bus_factor"]) for r in told(run, "bus-factor", "--limit", "0")["files"]} == {(f, "Ann", 1) for f in ("pkg/a.py", "pkg/b.py", "test_a.py")}
    assert set(told(run, "git-coupling")) == {"hotspots", "pairs", "files"}
    assert len(told(run, "report")["single_author"]) == 3


def test_baseline(run, project):
    assert told(run, "baseline", "status") == {"error": "no baseline"}
    run("baseline", "save")
    assert told(run, "baseline", "status") == {"cycles": [], "gods": [], "regressions": []}
    (project / "store" / "baseline.json").write_text('{"saved_at": "x", "modules": [], "cycles": [], "god_modules": []}')
    assert run("baseline", "status", "--reporter", "github").startswith(("\n", "::"))


def test_log_and_errors(spark, project, tmp_path):
    names = gitlog.parse_name_only(gitlog.log_lines(spark, str(project), "--name-only"))
    assert names.count() == 12 and names.select("commit_id").distinct().count() == 5
    assert gitlog.is_work_tree(str(project)) and not gitlog.is_work_tree(str(tmp_path))
    with pytest.raises(RuntimeError):
        gitlog.log_lines(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        gitlog.run_git(str(tmp_path), "log")
