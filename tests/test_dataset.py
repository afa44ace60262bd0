"""The build job: what it writes, takes over, and does after a failure."""

import csv
import os

import pytest

from pkgatlas.operators import lookup
from pkgatlas.plans import dataset
from pkgatlas.plans.dataset import Stage, build_dataset, run_stages

ALL = {
    "dependents": [["package_name", "dependent_count"], ["Flask", 9], ["flask", 4], ["lone", 2], ["bad", "x"]],
    "bridge": [["package_name", "repo"], ["flask", "p/flask"], ["FLASK", "p/fork"]],
    "repos": [["repo", "stars", "forks", "open_issues", "description"], ["p/flask", 10, 1, 2, 'says "hi"\nand more'], ["p/fork", 3, 1, 2, "f"]],
    "prior": [["package_name", "dependent_count"], ["flask", 3]],
    "deps": [
        ["project_name", "dependency_name", "dependency_kind", "dependency_requirements", "platform"],
        ["a", "Flask", "runtime", "*", "Pypi"], ["b", "flask", "runtime", "*", "Pypi"], ["c", "flask", "runtime", "*", "NPM"],
    ],
}


def _write(folder, names):
    paths = {}
    for name in names:
        path = folder / f"{name}.csv"
        if not path.exists():
            with path.open("w", newline="") as f:
                csv.writer(f, lineterminator="\n").writerows(ALL[name])
        paths[name] = str(path)
    return paths


def _files(path):
    return sorted(os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs)


def test_build_writes_once(spark, tmp_path):
    exports, path = _write(tmp_path, ALL), str(tmp_path / "out")
    first = build_dataset(spark, exports, path, "Pypi")
    assert first.written == (
        "staged_dependents", "staged_bridge", "staged_repos", "staged_prior", "packages", "deps",
        "edges_by_dependency_name", "edges_by_project_name",
    )
    rows = {r["name_key"]: r for r in first.table("packages").collect()}
    assert set(rows) == {"flask", "lone"} and rows["flask"]["dependent_count"] == 9
    assert rows["flask"]["repo"] == "p/flask" and rows["flask"]["growth_pct"] == 200.0
    assert rows["flask"]["description"] == 'says "hi"\nand more'
    assert {r["stage"]: r["row_count"] for r in first.ledger.collect()} == {
        "staged_dependents": 3, "staged_bridge": 2, "staged_repos": 2, "staged_prior": 1, "packages": 2, "deps": 2,
        "edges_by_dependency_name": 2, "edges_by_project_name": 2,
    }
    names = lookup.asked(lookup.name_list(spark, ["FLASK"]))
    assert [r["project_name"] for r in first.edge_index().listed(names, 0).orderBy("pos").collect()] == ["a", "b"]
    assert first.layers().versions is None and first.table("projects") is None

    before = _files(path)
    again = build_dataset(spark, exports, path, "Pypi")
    assert again.written == () and _files(path) == before
    assert again.table("packages").count() == 2


def test_new_export_redoes_what_reads_it(spark, tmp_path):
    exports, path = _write(tmp_path, ("dependents", "bridge", "repos", "deps")), str(tmp_path / "out")
    first = build_dataset(spark, exports, path, "Pypi")
    assert {r["growth_pct"] for r in first.table("packages").collect()} == {None}
    with open(exports["bridge"], "a") as f:
        f.write("lone,p/fork\n")
    second = build_dataset(spark, {**exports, **_write(tmp_path, ("prior",))}, path, "Pypi")
    assert second.written == ("staged_bridge", "staged_prior", "packages")
    rows = {r["name_key"]: (r["repo"], r["growth_pct"]) for r in second.table("packages").collect()}
    assert rows == {"flask": ("p/flask", 200.0), "lone": ("p/fork", None)}
    other = build_dataset(spark, exports, path, "NPM")
    assert "deps" in other.written and other.table("deps").count() == 1


def test_goes_on_behind_the_last_finished_stage(spark, tmp_path):
    runs, broken = [], [True]

    def stage(name, *reads):
        def write(paths, folder):
            runs.append(name)
            if name == "second" and broken[0]:
                spark.range(3).write.parquet(folder)  # half of the work is there
                raise OSError("lost")
            spark.range(5).write.parquet(folder)

        return Stage(name, reads, {}, write)

    export = {"in": str(tmp_path / "in.csv")}
    (tmp_path / "in.csv").write_text("x\n1\n")
    stages = [stage("first", "in"), stage("second", "first"), stage("third", "second")]
    with pytest.raises(OSError):
        run_stages(spark, stages, export, str(tmp_path / "out"))
    broken[0] = False
    done = run_stages(spark, stages, export, str(tmp_path / "out"))
    assert runs == ["first", "second", "second", "third"] and done.written == ("second", "third")
    assert done.table("second").count() == 5
    assert {r["row_count"] for r in done.ledger.collect()} == {5}


def test_refuses_unknown_and_missing_exports(spark, tmp_path):
    with pytest.raises(ValueError, match="missing exports"):
        build_dataset(spark, _write(tmp_path, ("bridge",)), str(tmp_path / "out"), "Pypi")
    with pytest.raises(ValueError, match="unknown exports"):
        build_dataset(spark, {**_write(tmp_path, ("dependents", "bridge", "repos")), "typo": "x"}, str(tmp_path / "out"), "Pypi")


def test_empty_exports(spark, tmp_path):
    for name, rows in ALL.items():
        (tmp_path / f"{name}.csv").write_text(",".join(rows[0]) + "\n")
    out = build_dataset(spark, _write(tmp_path, ALL), str(tmp_path / "out"), "Pypi")
    assert {r["row_count"] for r in out.ledger.collect()} == {0}
    assert out.table("packages").count() == 0
    assert build_dataset(spark, _write(tmp_path, ALL), str(tmp_path / "out"), "Pypi").written == ()
    assert dataset.RECIPE >= 1
