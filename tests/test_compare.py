"""Ties, missing downloads and display rows of a comparison."""

import pytest
from pyspark.sql import functions as F

from pkgatlas import schemas
from pkgatlas.operators import compare, trends
from pkgatlas.operators.lookup import Layers

AS_OF = "2024-01-01"


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        [
            (1, 0, "a", "a", 60, 10, 5, 1.0, 3, 2, 0, None),
            (1, 1, "b", "b", 60, 10, 9, 1.0, 3, 2, 5, 70),
            (1, 2, "c", "c", 50, 10, 9, 2.0, 1, 9, 0, None),
            (2, 0, "a", "a", 60, 10, 5, None, 3, 2, None, None),
        ],
        "request_id int, pos int, name string, name_key string, health_score int, stars long, "
        "dependents_count long, growth_pct double, forks long, total_versions long, "
        "days_since_last_release int, latest_downloads long",
    )


def test_first_row_wins_ties(results):
    best = {
        (r["request_id"], r["metric"]): r["name"] for r in compare.best_per_metric(results).collect()
    }
    assert best[1, "health"] == "a" and best[1, "stars"] == "a" and best[1, "dependents"] == "b"
    assert best[1, "growth"] == "c" and best[1, "versions"] == "c"
    assert best[1, "release"] == "a"  # zero days is the best age, first of two
    assert best[1, "downloads"] == "b" and (2, "downloads") not in best
    assert best[2, "release"] == "a"


def test_best_rows_without_sorted_aggregation(spark, results):
    plan = compare.best_per_metric(results, order=compare.answer_order())._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_best_rows_of_long_and_null_comparisons(spark):
    """Against a plain loop: many pieces, ties, nulls, negative ages and a comparison without an id."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 5 < 3, 1).when(F.col("id") % 5 == 3, 2).alias("request_id"),
        F.col("id").alias("pos"), F.concat(F.lit("p"), F.col("id")).alias("name"),
        *[
            F.when(F.col("id") % (7 + i) != 0, (F.xxhash64("id", F.lit(i)) % 40).cast(kind)).alias(c)
            for i, (c, kind) in enumerate([
                ("health_score", "int"), ("stars", "long"), ("dependents_count", "long"), ("growth_pct", "double"),
                ("forks", "long"), ("total_versions", "long"), ("days_since_last_release", "int"),
            ])
        ],
    )
    want = {}
    for r in rows.collect():
        for metric, (column, higher) in compare.METRICS.items():
            value = r[column] if r[column] is not None else (9999 if metric == "release" else 0)
            key = (-value if higher else value, -(r["dependents_count"] or 0), r["pos"])
            at = (r["request_id"], metric)
            want[at] = min(want.get(at, (key, "", 0.0)), (key, r["name"], float(value)))
    got = compare.best_per_metric(rows, order=compare.answer_order()).collect()
    assert {(r["request_id"], r["metric"]): (r["name"], r["value"]) for r in got} == {
        k: v[1:] for k, v in want.items()
    }
    assert len(got) == len(want) == 21


def test_banner(results):
    one = compare.banner(results).filter("request_id = 1").first()
    assert (one["packages_analyzed"], one["total_dependents"]) == (3, 23)
    assert (one["most_popular"], one["most_depended_on"], one["fastest_growing"]) == ("a", "b", "c")
    by_answer = compare.banner(results, ("request_id",), compare.answer_order())
    assert by_answer.filter("request_id = 1").first()["most_popular"] == "b"


def test_report_and_detail(spark):
    fresh = spark.createDataFrame(
        [("A-b", "a-b", "d", 1500, 20, 0, 1_250_000, 1, 7.25, "o/r"), ("c", "c", "d", 5, 0, 0, 3, 1, -6.0, "")],
        schemas.PACKAGES,
    )
    requests = spark.createDataFrame([(1, 0, "c"), (1, 1, "a-b"), (1, 2, "c")], "request_id int, pos int, name string")
    latest = spark.createDataFrame([("A-B", "2024-01", 2500)], "package_name string, month string, downloads long")
    rows = compare.comparison_report(Layers(fresh=fresh), requests, AS_OF, latest).orderBy("pos").collect()
    assert [r["comparison_count"] for r in rows] == [3, 3, 3]
    ab = rows[1]
    assert ab["initials"] == "AB" and ab["stars_text"] == "1.5k" and ab["dependents_text"] == "1.3M"
    assert ab["downloads_text"] == "2.5k" and ab["downloads_axis"] == "3k"
    assert ab["growth_text"] == "7.3%" and ab["trend_direction"] == "up"
    assert rows[0]["downloads_text"] == "—" and rows[0]["trend_direction"] == "down"
    # equal age and versions: the answer is sorted by dependents, so a-b comes first
    assert ab["best_in"] == "dependents,downloads,forks,growth,health,release,stars,versions"
    detail = compare.deep_dive(Layers(fresh=fresh), requests.select("name"), AS_OF)
    got = {(r["name"], r["metric"]): (r["value"], r["status"], r["snippet"]) for r in detail.collect()}
    assert got["a-b", "Stars"] == ("1,500", "green", "pip install a-b")
    assert got["c", "Last Release"][:2] == ("27yr ago", "red")
    ordered = compare.sorted_comparison(compare.compare(Layers(fresh=fresh), requests, AS_OF)).collect()
    assert [(r["name"], r["pos"]) for r in ordered] == [("a-b", 1), ("c", 0), ("c", 2)]


def test_trends(spark):
    rows = spark.createDataFrame(
        [("A", "2024-01-05", 10), ("A", "2024-01-20", 5), ("a", "2024-01-01", 1), ("A", "2024-02-01", 30),
         ("b", "2024-01-09", 0), ("b", "2024-02-09", 0), ("c", "2024-01-09", 4)],
        schemas.DOWNLOADS,
    )
    names = spark.createDataFrame([("a",), ("B",), ("c",)], "name string")
    monthly = trends.monthly_downloads(rows, names)
    got = {(r[0], r[1]): r[2] for r in monthly.collect()}
    assert got["A", "2024-01"] == 15 and got["a", "2024-01"] == 1  # spelled as written
    wide = {r["month"]: r for r in trends.pivot_downloads(monthly, ["A", "c"]).collect()}
    assert wide["2024-02"]["A"] == 30 and wide["2024-02"]["c"] is None
    assert [r["package_name"] for r in trends.latest_downloads(monthly).collect()] == ["A"]
    growth = {(r[0], r[1]): r["growth_from_start"] for r in trends.normalized_trend(monthly).collect()}
    assert growth["A", "2024-02"] == 100.0 and growth["b", "2024-02"] is None


def test_explore_series(spark):
    from pkgatlas.plans.reports import explore_series

    rows = spark.createDataFrame(
        [(1, 1, "Flask"), (1, 2, "django"), (1, 3, "none"), (2, 1, "django"), (3, 1, "gone")], "query_id long, pos int, name string"
    )
    downloads = spark.createDataFrame(
        [("flask", "2024-01-03", 5), ("FLASK", "2024-01-09", 2), ("django", "2024-01-01", 4), ("django", "2024-02-01", 6),
         ("django", "no date", 9), ("other", "2024-01-01", 8), (None, "2024-01-01", 1), ("none", "2024-02-01", None)],
        "package_name string, month string, downloads long",
    )
    got = {(r["query_id"], r["month"]): [tuple(p) for p in r["points"]] for r in explore_series(rows, downloads).collect()}
    assert got == {
        (1, "2024-01"): [(1, "Flask", 7), (2, "django", 4)],
        (1, "2024-02"): [(2, "django", 6), (3, "none", None)],
        (2, "2024-01"): [(1, "django", 4)],
        (2, "2024-02"): [(1, "django", 6)],
    }
    assert explore_series(rows.limit(0), downloads).count() == 0
