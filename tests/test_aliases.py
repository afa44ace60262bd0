"""Spellings of one package meet in build, requirement edges and lookups."""

import json

from pkgatlas.operators.aliases import alias_table, resolve_names
from pkgatlas.operators.build import build_packages
from pkgatlas.operators.lookup import name_list, reverse_dependencies
from pkgatlas.sources.documents import requirement_edges

SPELLED = ["scikit_learn", "Scikit.Learn", "scikit-learn"]


def names(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, weight long")


def test_collisions_and_nulls(spark):
    table = alias_table(
        names(spark, ("a_b", 3), ("A-B", 2), ("a.b", None), ("c", 0), (None, 9)), names(spark, ("A-B", 5), ("C", 0), ("x--y", 1), ("x_.y", 1)),
        names(spark, ("d", 1)).drop("weight"),
    )
    got = {tuple(r) for r in table.collect()}
    assert got == {("a-b", "A-B", 3), ("c", "C", 2), ("x-y", "x--y", 2), ("d", "d", 1)}
    assert alias_table(names(spark)).count() == 0


def test_every_row_stays_once(spark):
    aliases = alias_table(names(spark, ("a_b", 3), ("A-B", 5)))
    df = spark.createDataFrame([("a.b", 1), ("a.b", 1), ("A-B", 2), ("other_name", 3), (None, 4)], "name string, _v int")
    got = sorted(map(tuple, resolve_names(df, "name", aliases).collect()), key=str)
    assert got == sorted([("A-B", 1), ("A-B", 1), ("A-B", 2), ("other_name", 3), (None, 4)], key=str)


def test_spellings_meet_everywhere(spark):
    dependents = spark.createDataFrame([(SPELLED[0], 10), (SPELLED[2], 7), ("flask", 3)], "package_name string, dependent_count long")
    bridge = spark.createDataFrame([(SPELLED[1], "org/repo"), ("Flask", "org/flask")], "package_name string, repo string")
    repos = spark.createDataFrame(
        [("org/repo", "d", 5, 1, 1), ("org/flask", "d", 4, 1, 1)], "repo string, description string, stars long, forks long, open_issues long"
    )
    meta = spark.createDataFrame(
        [("p", json.dumps([f"{SPELLED[1]} (>=1.0)", "flask"])), ("q", json.dumps([SPELLED[2]])), ("r", json.dumps(["scikit__learn"]))],
        "name string, requires_dist string",
    )
    aliases = alias_table(
        dependents.selectExpr("package_name AS name", "dependent_count AS weight"), bridge.selectExpr("package_name AS name"),
    )
    built = build_packages(resolve_names(dependents, "package_name", aliases), resolve_names(bridge, "package_name", aliases), repos)
    assert {(r["package_name"], r["dependent_count"], r["repo"]) for r in built.collect()} == {
        (SPELLED[0], 10, "org/repo"), ("flask", 3, "org/flask"),
    }
    edges = resolve_names(requirement_edges(meta), "dependency_name", aliases).selectExpr(
        "project_name", "dependency_name", "'runtime' AS dependency_kind", "dependency_requirements"
    )
    asked = resolve_names(name_list(spark, ["SCIKIT-LEARN"]), "name", aliases)
    assert {r["project_name"] for r in reverse_dependencies(edges, asked).collect()} == {"p", "q", "r"}
