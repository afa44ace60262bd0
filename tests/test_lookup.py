"""Layer semantics on small tables."""

import pytest
from pyspark.sql import functions as F

from pkgatlas import schemas
from pkgatlas.operators import build, health, lookup, rank
from pkgatlas.operators.lookup import Layers

AS_OF = "2024-01-01"


@pytest.fixture(scope="module")
def layers(spark):
    fresh = spark.createDataFrame(
        [
            ("Flask", "flask", "web", 10, 2, 1, 0, 0, 12.5, "p/flask"),
            ("nostars", "nostars", None, None, None, None, 7, None, None, None),
            ("zero", "zero", "z", 1, 1, 1, 0, 1, None, "z/z"),
        ],
        schemas.PACKAGES,
    )
    projects = spark.createDataFrame(
        [
            ("flask", "old web", 99, 9, 55, "u/flask", "BSD", "2023-12-31 12:00:00", "Pypi"),
            ("nostars", "old", 77, 7, 66, "u/ns", "MIT", None, "Pypi"),
            ("OldOnly", "relic", 3, 4, 5, "u/old", "GPL", "bad date", "Pypi"),
        ],
        schemas.PROJECTS,
    )
    deps = spark.createDataFrame(
        [(f"p{i}", "FLASK", "runtime", ">=1", "Pypi") for i in range(60)]
        + [("p1", "flask", "dev", "*", "Pypi"), ("x", "oldonly", "runtime", "*", "Pypi")],
        schemas.EDGES,
    )
    versions = spark.createDataFrame([("flask", "Pypi"), ("Flask", "Pypi")], schemas.VERSIONS)
    meta = spark.createDataFrame(
        [
            ("flask", "s", "```python\nimport flask\n```", "", "[]", "3.0", "a", "BSD-3", "[]", "", 40, "2023-12-01", "", ""),
            ("RegOnly", "r", "text", "", "[]", "1.0", "b", "", "[]", "", 4, None, "", ""),
            ("zero", "z", "", "", "[]", "0.1", "c", "", "[]", "", 9, "", "", ""),
        ],
        schemas.METADATA,
    )
    return Layers(fresh, projects, deps, versions, meta)


def rows(df, key="name"):
    return {r[key]: r.asDict() for r in df.collect()}


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_fresh_row_wins_whole(spark, layers):
    got = rows(lookup.health_metrics(layers, names(spark, "FLASK", "NoStars", "oldonly", "nope")))
    assert got["FLASK"]["stars"] == 10 and got["FLASK"]["license"] == "BSD"
    assert got["FLASK"]["total_versions"] == 2
    assert got["NoStars"]["stars"] is None and got["NoStars"]["dependents_count"] == 7
    assert got["oldonly"]["stars"] == 3 and got["oldonly"]["package_name"] == "OldOnly"
    assert not got["nope"]["found_in_db"]


def test_lookup_one_row_per_spelling(spark, layers):
    got = rows(lookup.lookup(layers, names(spark, "flask", "FLASK", "OLDONLY", "nope")))
    assert set(got) == {"flask", "FLASK", "OLDONLY"}
    assert got["flask"]["layer"] == "fresh" and got["OLDONLY"]["layer"] == "historical"


def test_dependents_fall_through(spark, layers):
    asked = names(spark, "flask", "nostars", "zero", "oldonly", "nope")
    got = {k: r["dependents_count"] for k, r in rows(lookup.dependents_count(layers, asked)).items()}
    # a zero fresh count falls to the edges, whose rows are counted, even when there are none
    assert got == {"flask": 61, "nostars": 7, "zero": 0, "oldonly": 1, "nope": 0}
    without = Layers(layers.fresh, layers.projects)
    got = {k: r["dependents_count"] for k, r in rows(lookup.dependents_count(without, asked)).items()}
    assert got == {"flask": 55, "nostars": 7, "zero": 0, "oldonly": 5, "nope": 0}


def test_stats(spark, layers):
    got = rows(health.package_stats(layers, names(spark, "flask", "RegOnly", "zero", "oldonly", "nope"), AS_OF))
    f = got["flask"]
    assert f["days_since_last_release"] == 31 and f["total_versions"] == 2
    assert f["code_snippet"] == "import flask" and f["code_source"] == "README"
    assert got["zero"]["total_versions"] == 9 and got["zero"]["days_since_last_release"] == 9999
    assert not got["RegOnly"]["found_in_db"] and got["RegOnly"]["found_in_registry"]
    assert got["RegOnly"]["error"] is None and got["RegOnly"]["stars"] == 0
    assert got["oldonly"]["days_since_last_release"] == 9999 and got["oldonly"]["license"] == "GPL"
    assert "nope" in got["nope"]["error"] and got["nope"]["health_score"] is not None
    assert "nope" not in rows(health.health_check(layers, names(spark, "nope", "flask"), AS_OF))


def test_missing_layers(spark, layers):
    only_meta = Layers(metadata=layers.metadata)
    got = rows(health.package_stats(only_meta, names(spark, "flask", "nope"), AS_OF))
    assert got["flask"]["total_versions"] == 40 and got["nope"]["error"]
    no_meta = Layers(fresh=layers.fresh)
    got = rows(health.package_stats(no_meta, names(spark, "flask"), AS_OF))
    assert not got["flask"]["found_in_registry"] and got["flask"]["license"] == ""
    stats = lookup.dataset_stats(Layers(fresh=layers.fresh)).first()
    assert tuple(stats) == (3, 0)
    detail = health.package_detail(no_meta, names(spark, "flask"), AS_OF).first()
    assert detail["dependencies"] == []


def test_edges_are_cut_per_name(spark, layers):
    got = lookup.reverse_dependencies(layers.deps, names(spark, "Flask", "oldonly"), 50)
    counts = {r["name"]: r["count"] for r in got.groupBy("name").count().collect()}
    assert counts == {"Flask": 50, "oldonly": 1}
    full = lookup.reverse_dependencies(layers.deps, names(spark, "Flask"), 1000).orderBy("pos").collect()
    cut = got.filter("name = 'Flask'").orderBy("pos").collect()
    assert [r["project_name"] for r in cut] == [r["project_name"] for r in full][:50]
    assert lookup.dependencies(layers.deps, names(spark, "P1")).count() == 2


def test_first_non_empty(spark):
    a, b = (spark.createDataFrame(v, "k int, v int") for v in ([(1, 1)], [(1, 9), (2, 2)]))
    assert sorted(map(tuple, lookup.first_non_empty(a, b).collect())) == [(1, 1)]
    assert sorted(map(tuple, lookup.first_non_empty(a.filter("k > 5"), b).collect())) == [(1, 9), (2, 2)]
    assert sorted(map(tuple, lookup.first_non_empty(a, b, ["k"]).collect())) == [(1, 1), (2, 2)]


def test_layers_from_catalog(spark, layers):
    layers.fresh.createOrReplaceTempView("fresh_packages")
    got = Layers.from_catalog(spark, fresh="fresh_packages", deps="no_such_table")
    assert got.fresh is not None and got.deps is None
    with pytest.raises(ValueError):
        Layers.from_catalog(spark, other="x")


def test_build_packages(spark):
    dependents = spark.createDataFrame([("A", 30), ("b", 5), ("c", 4)], "package_name string, dependent_count long")
    bridge = spark.createDataFrame(
        [("a", "r1"), ("A", "r2"), ("a", "r3"), ("b", "gone")], "package_name string, repo string"
    )
    repos = spark.createDataFrame(
        [("r1", 5, 1, 1, "one"), ("r2", 9, 2, 2, "two"), ("r3", 9, 3, 3, "three")],
        "repo string, stars long, forks long, open_issues long, description string",
    )
    prior = spark.createDataFrame([("a", 20), ("b", 0)], "package_name string, dependent_count long")
    got = rows(build.build_packages(dependents, bridge, repos, prior), "package_name")
    assert got["A"]["repo"] == "r2" and got["A"]["growth_pct"] == 50.0
    assert got["b"]["repo"] == "gone" and got["b"]["stars"] is None and got["b"]["growth_pct"] is None
    assert got["c"]["repo"] is None
    plain = build.build_packages(dependents, bridge, repos)
    assert plain.filter("growth_pct is not null").count() == 0
    filled = build.fill_defaults(plain).filter("package_name = 'c'").first()
    assert (filled["stars"], filled["repo"], filled["growth_pct"]) == (0, "", 0.0)
    assert build.canonical(plain).columns == [
        "name", "description", "stars", "forks", "dependents_count", "repository_url",
    ]


def test_growth_thresholds_and_tiebreaks(spark):
    packages = spark.createDataFrame(
        [
            ("a", "a", "", 0, 0, 0, 500, 1, 60.0, ""), ("b", "b", "", 0, 0, 0, 499, 1, 60.0, ""),
            ("c", "c", "", 1, 0, 0, 50, 1, 51.0, ""), ("d", "d", "", 1, 0, 0, 50, 1, 50.0, ""),
            ("e", "e", "", 1, 0, 0, 49, 1, 90.0, ""), ("B2", "b2", "", None, 0, 0, 500, 1, 60.0, ""),
        ],
        schemas.PACKAGES,
    )
    assert [r["name"] for r in rank.top_growth(packages).collect()] == ["a", "B2", "c"]
    top = [r["name_key"] for r in rank.top_by_dependents(packages).collect()]
    assert top == ["a", "b2", "b", "c", "d", "e"]
    assert [r["name_key"] for r in rank.top_by_dependents(packages, 2).collect()] == top[:2]
    got = rank.metric_filter(packages, {"stars": (1, None), "dependent_count": (None, 49)})
    assert [r["name_key"] for r in got.collect()] == ["e"]


def test_shortlist_branches(spark):
    results = spark.createDataFrame(
        [(1, i, f"n{i}", 300, 600, float(i)) for i in range(10)]
        + [(2, 0, "big", 300, 600, 1.0), (2, 1, "small", 0, 0, 90.0), (2, 2, "mid", 40, 0, 80.0)]
        + [(1, 10, "N9", 300, 600, 50.0)],
        "query_id int, pos int, name string, dependents_count long, stars long, growth_pct double",
    )
    done = spark.createDataFrame([("N8",)], "name string")
    got = rank.growth_shortlist(results, None, done).orderBy("query_id", "shortlist_pos").collect()
    first = [(r["name"], r["branch"]) for r in got if r["query_id"] == 1]
    assert first == [(n, "quality") for n in ("N9", "n7", "n6", "n5", "n4")]
    second = [(r["name"], r["branch"]) for r in got if r["query_id"] == 2]
    assert second == [("mid", "fallback"), ("small", "fallback"), ("big", "fallback")]


def test_download_candidates(spark):
    packages = spark.createDataFrame(
        [(n, n, "", 1, 0, 0, 10, 1, g, "") for n, g in
         (("a", 60.0), ("b", 300.0), ("c", 250.0), ("d", 199.0), ("e", 400.0))],
        schemas.PACKAGES,
    )
    meta = spark.createDataFrame(
        [(n, s, "", "", "[]", "", "", "", "[]", "", 1, "", "", "") for n, s in
         (("a", "LLM agent"), ("b", "a Vector db"), ("c", None), ("d", "web"))],
        schemas.METADATA,
    )
    done = spark.createDataFrame([("E",)], "package_name string")
    got = {r["package_name"]: r["tier"] for r in rank.download_candidates(packages, meta, done).collect()}
    assert got == {"a": 1, "b": 1, "c": 2}
