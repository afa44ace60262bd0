"""The edge index against brute force, and its plans."""

import random

import pytest
from pyspark.sql import functions as F

from pkgatlas import schemas
from pkgatlas.operators import lookup
from pkgatlas.sources.edge_index import write_edge_index


def _edges(spark, n=4000):
    """A hot name, a hot edge of more copies than one step carries, mixed spellings, nulls."""
    r = random.Random(5)
    rows = [(f"p{r.randrange(900)}", r.choice(["Hot", "hot"]), r.choice(["runtime", "dev", None]), r.choice(["*", ">=1"]), "x") for _ in range(n // 2)]
    rows += [(f"p{r.randrange(50)}", f"D{r.randrange(200)}", "runtime", None, "x") for _ in range(n // 2)]
    rows += [("same", "copied", "runtime", "*", "x")] * 70_000
    rows += [(None, "hot", "runtime", "*", "x"), ("nobody", None, "dev", "*", "x")]
    return rows, spark.createDataFrame(rows, schemas.EDGES)


def _first(v):
    return (v is not None, v or "")


def _brute(rows, asked, limit):
    out = []
    for name in asked:
        mine = sorted(
            ((p, k, q) for p, d, k, q, _ in rows if d is not None and d.lower() == name.lower()),
            key=lambda e: tuple(map(_first, e)),
        )
        out += [(name, i + 1, *e) for i, e in enumerate(mine[: limit or None])]
    return sorted(out, key=repr)


def _rows(df):
    return sorted(
        ((r["name"], r["pos"], r["project_name"], r["dependency_kind"], r["dependency_requirements"]) for r in df.collect()),
        key=repr,
    )


ASKED = ["HOT", "hot", "copied", "d7", "none"]


@pytest.mark.parametrize("limit", [0, 3, 1500])
def test_index_lists_as_brute_force(spark, tmp_path, limit):
    rows, edges = _edges(spark)
    index = write_edge_index(edges, str(tmp_path / "index"), parts=7)
    names = lookup.name_list(spark, ASKED)
    assert _rows(index.listed(lookup.asked(names), limit)) == _brute(rows, ASKED, limit)
    held = {r["name_key"]: r["edge_count"] for r in index.counts().collect()}
    assert held["copied"] == 70_000 and held["hot"] == 2001 and None not in held
    # neither the hot name nor the hot edge fills one part
    parts = {r["name_key"]: r["n"] for r in index.offsets().groupBy("name_key").agg(F.count("*").alias("n")).collect()}
    assert parts["hot"] > 1 and parts["copied"] > 1


@pytest.mark.parametrize("limit", [0, 3, 60])
@pytest.mark.parametrize("broadcasts", [True, False])
def test_lookup_lists_as_brute_force(spark, limit, broadcasts):
    rows, edges = _edges(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold if broadcasts else "-1")
    try:
        got = lookup.reverse_dependencies(edges, lookup.name_list(spark, ASKED), limit)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == broadcasts
        assert ("_piece" in plan) == (not broadcasts and limit > 0)
        assert "Window" not in plan or limit > 0
        assert _rows(got) == _brute(rows, ASKED, limit)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_short_list_prunes_parts(spark, tmp_path):
    _, edges = _edges(spark)
    index = write_edge_index(edges, str(tmp_path / "index"), parts=7)
    plan = index.listed(lookup.asked(lookup.name_list(spark, ["d7"])), 5)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "Window" not in plan and "Sort " not in plan


def test_index_of_nothing_and_clashing_columns(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.EDGES)
    index = write_edge_index(empty, str(tmp_path / "empty"))
    assert index.listed(lookup.asked(lookup.name_list(spark, ["x"])), 0).count() == 0
    assert index.counts().count() == 0
    clash = spark.createDataFrame([("a", "B", "k", "*", 1, 2, 3)], "project_name string, dependency_name string, dependency_kind string, dependency_requirements string, part int, row int, name_key int")
    back = write_edge_index(clash, str(tmp_path / "clash"), on="project_name").listed(lookup.asked(lookup.name_list(spark, ["A"])), 0)
    assert [tuple(r) for r in back.collect()] == [("A", "a", 1, "B", "k", "*")]


def test_long_list_travels_once(spark):
    """Names are not copied to the pieces that edges are cut in, and a hot name is cut before the shuffle."""
    rows, edges = _edges(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lookup.reverse_dependencies(edges, lookup.name_list(spark, ASKED * 2), 5)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence" not in plan and plan.count("_piece") > 0
        assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
        assert _rows(got) == _brute(rows, ASKED, 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
