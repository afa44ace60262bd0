"""Scalar functions at their edges."""

from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.functions import display, names, scoring, text, vectors


def test_maintenance_bands_change_the_score_at_their_edges(value):
    def score(days):
        return scoring.health_score(F.lit(0), F.lit(0), days, F.lit(0))

    got = value(score, [30, 31, 90, 91, 180, 181, 365, 366, 730, 731, None], "int")
    # 25 log10(2) * 0.4 + 30 log10(2) * 0.2 = 4.816 plus 0.3 of the band
    want = [int(4.8165 + 0.3 * b) for b in (100, 80, 80, 60, 60, 40, 40, 20, 20, 5, 5)]
    assert got == want


def test_score_is_truncated_and_clamped(value):
    top = value(lambda v: scoring.health_score(v, v, F.lit(0), v), [10**9], "long")
    assert top == [100]
    zero = value(
        lambda v: scoring.health_score(v, v, v, v, {k: 0.0 for k in fixed.SCORE_WEIGHTS}), [0], "long"
    )
    assert zero == [0]


def test_labels_colors_and_risk_levels(value):
    s = [39, 40, 59, 60, 69, 70, 79, 80]
    assert value(scoring.score_label, s, "int") == ["caution"] * 3 + ["moderate"] * 4 + ["healthy"]
    assert value(scoring.score_color, s, "int") == ["#ef4444"] * 3 + ["#eab308"] * 4 + ["#22c55e"]
    assert value(scoring.risk_level, s, "int") == ["high"] + ["moderate"] * 4 + ["low"] * 3


def test_both_age_risks_fire(value):
    def count(days):
        return F.size(scoring.risk_flags(days, F.lit(10), F.lit(50), F.lit(3)))

    assert value(count, [365, 366, 730, 731, None], "int") == [0, 1, 1, 2, 2]
    assert value(
        lambda v: F.size(scoring.risk_flags(F.lit(1), v, v, v)), [None], "int"
    ) == [3]


def test_days_since(value):
    got = value(
        lambda v: scoring.days_since(v, "2024-03-10"),
        ["2024-03-09T23:00:00", "2024-03-09", "2024-03-11", "2024-03-08T12:00:00Z",
         "2024-03-09T00:00:00.000001", "", None, "soon", "2024", "2024-13-40"],
    )
    assert got == [0, 1, -1, 1, 0, 9999, 9999, 9999, 9999, 9999]


def test_growth(value):
    assert value(lambda v: scoring.growth_pct(F.lit(15), v), [10, 0, None], "int") == [50.0, None, None]
    assert value(lambda v: scoring.growth_score(F.lit(2.0), v, 1), [0], "int")[0] > 1.38
    assert value(lambda v: scoring.growth_score(F.lit(2.0), v), [0], "int") == [0.0]


def test_names(value):
    assert value(names.normalize_name, ["a_b", "A.-_b", "a--b", None]) == ["a-b", "a-b", "a-b", None]
    assert value(lambda v: names.parse_name_list(v, 2), [" a ,,b\t, c", ""]) == [["a", "b"], []]
    got = value(
        names.repo_parts,
        ["https://host/a/b/", "https://host/a", "a/b/c", "https://host/a/b?x=1#y", "", None, "http://h//x/y"],
    )
    assert [tuple(r) if r else None for r in got] == [
        ("a", "b"), None, ("a", "b"), ("a", "b"), None, None, ("x", "y"),
    ]
    assert value(names.repository_link, ["https://x/y", "o/r", ""]) == [
        "https://x/y", "https://github.com/o/r", None,
    ]


def test_query_keys_and_words(value):
    assert value(lambda v: text.query_key(v, F.lit("explore"), 80), ["  A b  c ", "x" * 100]) == [
        "a_b__c__explore", "x" * 80 + "__explore",
    ]
    # the whole question unless the original's short key is asked for
    assert value(lambda v: text.query_key(v, F.lit("explore")), ["x" * 100]) == ["x" * 100 + "__explore"]
    assert value(lambda v: F.array_sort(text.significant_words(v)), ["The best ORM orm a x for Django"]) == [
        ["django", "orm"]
    ]


def test_intent(value):
    q = ["Fastest growing ORM", "popular libs", "trending web-scraping", "web scraper for logs", "catalog"]
    assert value(text.growth_intent, q) == [True, False, True, False, False]
    assert value(text.specific_domain, q) == [True, False, False, False, False]
    assert value(text.specific_domain, ["web scrap", "éapi", "an API!", "api_x"]) == [
        True, False, True, False,
    ]


def test_embedding_text_is_whole_unless_cut(spark):
    row = spark.createDataFrame(
        [("n", "", "r" * 9000, None, '["A","B"]')],
        "name string, summary string, readme string, keywords string, classifiers string",
    )
    cols = [F.col(c) for c in row.columns]
    whole, cut = row.select(
        text.embedding_text(*cols), text.embedding_text(*cols, readme_chars=8000)
    ).first()
    assert whole == "n\n" + "r" * 9000 + "\nA, B"
    assert cut == "n\n" + "r" * 8000 + "\nA, B"
    assert row.select(text.preview(F.col("readme"), 500)).first()[0] == "r" * 500


def test_recency(value):
    d = [1, 2, 7, 8, 30, 31, 180, 181, 365, 366, 730]
    assert value(lambda v: display.recency_text(v), d, "int") == [
        "This week", "This week", "This week", "1 weeks ago", "4 weeks ago", "1 months ago",
        "6 months ago", "6 months ago", "12 months ago", "1 years ago", "2 years ago",
    ]
    assert value(lambda v: display.recency_text(v, "comparison"), d, "int") == [
        "Today", "2d ago", "7d ago", "1w ago", "4w ago", "1mo ago", "6mo ago", "6mo ago",
        "12mo ago", "1.0yr ago", "2.0yr ago",
    ]
    assert value(lambda v: display.recency_text(v, "deep_dive"), d, "int")[4:8] == [
        "Recent", "1mo ago", "6mo ago", "0yr ago",
    ]
    assert value(display.recency_status, [90, 91, 365, 366], "int") == ["green", "amber", "amber", "red"]


def test_numbers(value):
    n = [999, 1000, 1150, 1250, 1499, 1500, 999_999, 1_000_000, 2_250_000]
    assert value(display.abbreviate, n, "long") == [
        "999", "1.0k", "1.1k", "1.3k", "1.5k", "1.5k", "1000.0k", "1.0M", "2.3M",
    ]
    assert value(lambda v: display.abbreviate(v, 0), n, "long")[1:6] == ["1k", "1k", "1k", "1k", "2k"]
    assert value(display.grouped_number, [1234567, None], "long") == ["1,234,567", "0"]
    assert value(display.trend_direction, [5.0, 5.1, -5.0, -5.1, None], "double") == [
        "neutral", "up", "neutral", "down", "neutral",
    ]
    assert value(lambda v: display.band_status(v, (10, 3)), [10, 11, 3, 4, None], "int") == [
        "amber", "green", "red", "amber", "red",
    ]
    assert value(display.initials, ["scikit-learn", "flask", "a__b", "x_y_z"]) == ["SL", "FL", "A", "XY"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(vectors.cosine(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [0.707107, None]
    assert abs(df.select(vectors.unit(F.col("b"))).first()[0][0] - 0.5**0.5) < 1e-12
