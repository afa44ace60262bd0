"""Side-by-side comparison and presentation tables.

Many comparisons run at once: ``requests(request_id, pos, name)``, with the list length as
``listed`` when it is known. Order inside a request is a sort key, never a window over the
request, so a request of any size is split freely.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.functions import display
from pkgatlas.functions.names import registry_link, repository_link
from pkgatlas.operators.health import package_stats
from pkgatlas.operators.lookup import Layers
from pkgatlas.session import materialize

# metric -> (column, higher is better)
METRICS = {
    "health": ("health_score", True),
    "stars": ("stars", True),
    "dependents": ("dependents_count", True),
    "growth": ("growth_pct", True),
    "forks": ("forks", True),
    "versions": ("total_versions", True),
    "release": ("days_since_last_release", False),
}

#: Positions of one comparison that are met in one task.
PIECE_ROWS = 4096


def compare(
    layers: Layers, requests: DataFrame, as_of: str, per: str = "request_id", **options
) -> DataFrame:
    """Statistics of every requested package with the size of its comparison.

    Statistics are computed once per distinct name, then joined to the requests.
    """
    stats = package_stats(layers, requests, as_of, **options)
    if "listed" in requests.columns:
        asked = requests.select(per, "pos", "name", F.col("listed").alias("comparison_count"))
    else:
        sizes = requests.groupBy(per).agg(F.count("*").alias("comparison_count"))
        asked = requests.select(per, "pos", "name").join(sizes, per)
    return asked.join(stats, "name")


def sorted_comparison(rows: DataFrame, per: str = "request_id") -> DataFrame:
    """Rows in answer order: most dependents first, ties in request order."""
    return rows.orderBy(per, F.col("dependents_count").desc(), "pos")


def answer_order() -> list[Column]:
    """Ascending sort key of a comparison answer."""
    return [-F.coalesce("dependents_count", F.lit(0)), F.col("pos")]


def _first_best(value: Column, order: Sequence[Column]) -> Column:
    """Ordering value: higher wins, ties go to the earlier row."""
    return F.struct(value.alias("v"), *[(-c).alias(f"o{i}") for i, c in enumerate(order)])


def banner(
    results: DataFrame, per: Sequence[str] = ("request_id",), order: Sequence[Column] | None = None
) -> DataFrame:
    """Count, total dependents, and the leaders by stars, dependents and growth."""
    order = [F.col("pos")] if order is None else order

    def value(column: str, zero: Column) -> Column:
        return F.coalesce(F.col(column), zero)

    stars = value("stars", F.lit(0))
    deps = value("dependents_count", F.lit(0))
    growth = value("growth_pct", F.lit(0.0))
    return results.groupBy(*per).agg(
        F.count("*").alias("packages_analyzed"),
        F.sum(deps).alias("total_dependents"),
        F.max_by("name", _first_best(stars, order)).alias("most_popular"),
        F.max(stars).alias("most_popular_stars"),
        F.max_by("name", _first_best(deps, order)).alias("most_depended_on"),
        F.max(deps).alias("most_dependents"),
        F.max_by("name", _first_best(growth, order)).alias("fastest_growing"),
        F.max(growth).alias("fastest_growth_pct"),
    )


def with_latest_downloads(results: DataFrame, latest: DataFrame) -> DataFrame:
    """Attach ``latest_downloads`` (null when the package has none in the last month)."""
    by_key = latest.groupBy(F.lower("package_name").alias("name_key")).agg(
        F.sum("downloads").alias("latest_downloads")
    )
    return results.join(by_key, "name_key", "left")


def _order_number(order: Sequence[Column]) -> Column:
    """One or two whole numbers (the second below 5e18 in amount) as one that sorts alike."""
    if not 1 <= len(order) <= 2:
        raise ValueError("the order inside a comparison has one or two numbers")
    first, *rest = [c.cast("long").cast("decimal(19,0)") for c in order]
    return (first * F.lit(Decimal(10**19)) + rest[0] if rest else first).cast("decimal(38,0)")


def _metrics(results: DataFrame) -> dict[str, Column]:
    """The value that leads in each metric, the higher the better."""
    metrics = dict(METRICS)
    if "latest_downloads" in results.columns:
        metrics["downloads"] = ("latest_downloads", True)

    def value(column: str, higher: bool) -> Column:
        missing = fixed.UNKNOWN_DAYS if column == "days_since_last_release" else 0
        found = F.coalesce(F.col(column), F.lit(missing)).cast("double")
        return found if higher else -found

    return {name: value(*of) for name, of in metrics.items()}


def _piece() -> Column:
    """Part of a comparison that a row belongs to: so many positions each, so that a hot one is spread."""
    return F.coalesce(F.floor(F.col("pos") / PIECE_ROWS), F.lit(0))


def _leaders(results: DataFrame, per: str, order: Sequence[Column]) -> DataFrame:
    """(_per, _piece, lead): each metric's best value ``v_`` and the order number ``o_`` of the row that has it first.

    One row per piece of a comparison. Buffers are plain numbers, so both aggregations hash:
    first the best values, then, of the rows that reach them, the lowest order number.
    """
    metrics = _metrics(results)
    rows = results.select(
        F.col(per).alias("_per"), _piece().alias("_piece"), _order_number(order).alias("_order"),
        *[v.alias(f"x_{m}") for m, v in metrics.items()],
    )
    tops = rows.groupBy("_per", "_piece").agg(*[F.max(f"x_{m}").alias(f"v_{m}") for m in metrics])
    best = tops.groupBy(F.col("_per").alias("_of")).agg(*[F.max(f"v_{m}").alias(f"v_{m}") for m in metrics])
    pieces = tops.select("_per", "_piece").join(best, F.col("_per").eqNullSafe(F.col("_of"))).drop("_of")
    known = pieces.withColumnsRenamed({"_per": "_of", "_piece": "_in"})
    met = rows.join(known, F.col("_per").eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_in")))
    firsts = (
        met.groupBy("_per", "_piece")
        .agg(*[F.min(F.when(F.col(f"x_{m}") == F.col(f"v_{m}"), F.col("_order"))).alias(f"o_{m}") for m in metrics])
        .groupBy(F.col("_per").alias("_of")).agg(*[F.min(f"o_{m}").alias(f"o_{m}") for m in metrics])
    )
    lead = F.struct(*[f"{x}_{m}" for m in metrics for x in "vo"]).alias("lead")
    return pieces.join(firsts, F.col("_per").eqNullSafe(F.col("_of"))).select("_per", "_piece", lead)


def _with_leads(results: DataFrame, per: str, order: Sequence[Column]) -> DataFrame:
    """``results`` with ``_leads``: the metrics (name, value) in which a row is the first of the best."""
    metrics = _metrics(results)
    leaders = _leaders(results, per, order)

    def led(name: str) -> Column:
        top = F.col(f"lead.v_{name}")
        first = F.col(f"lead.o_{name}") == F.col("_order")
        value = top if METRICS.get(name, ("", True))[1] else -top
        if name == "downloads":  # only where some package has downloads
            first = first & (top > 0)
        return F.when(first, F.struct(F.lit(name).alias("metric"), value.alias("value")))

    return (
        results.withColumns({"_order": _order_number(order), "_at": _piece()})
        .join(leaders, F.col(per).eqNullSafe(F.col("_per")) & (F.col("_at") == F.col("_piece")))
        .withColumn("_leads", F.array_compact(F.array(*[led(m) for m in metrics])))
        .select(*results.columns, "_leads")
    )


def best_per_metric(
    results: DataFrame, per: str = "request_id", order: Sequence[Column] | None = None
) -> DataFrame:
    """The best package of each metric in each comparison; the earlier row wins ties.

    ``order``: one or two whole numbers, lowest first. Zero days since the release is the best
    age. The ``downloads`` metric appears only in comparisons where some package has downloads.
    ``results`` is read three times; store it first where it is costly.
    """
    rows = _with_leads(results, per, [F.col("pos")] if order is None else order)
    led = rows.select(per, "name", "pos", F.inline("_leads"))
    return led.select(per, "metric", "name", "pos", "value")


def comparison_report(
    layers: Layers,
    requests: DataFrame,
    as_of: str,
    latest: DataFrame | None = None,
    per: str = "request_id",
    **options,
) -> DataFrame:
    """The comparison view: display texts, status bands and the metrics each package leads."""
    rows = compare(layers, requests, as_of, per, **options)
    if latest is not None:
        rows = with_latest_downloads(rows, latest)
    else:
        rows = rows.withColumn("latest_downloads", F.lit(None).cast("long"))
    # stored once: the leaders are found from all rows and joined back to them
    rows = materialize(rows, "comparison")
    rows = _with_leads(rows, per, answer_order()).withColumn(
        "best_in", F.array_join(F.array_sort(F.col("_leads.metric")), ",")
    )
    days, growth = F.col("days_since_last_release"), F.col("growth_pct")
    # one formatter over an array: spelled out four times, the generated method would be
    # too large for the JVM to compile
    counts = F.array("stars", "dependents_count", "forks", "latest_downloads")
    texts = rows.withColumn("_short", F.transform(counts, lambda v: display.abbreviate(v)))
    return texts.select(
        per,
        "pos",
        "name",
        "comparison_count",
        "health_score",
        "score_label",
        display.initials(F.col("name")).alias("initials"),
        F.col("_short")[0].alias("stars_text"),
        F.col("_short")[1].alias("dependents_text"),
        F.col("_short")[2].alias("forks_text"),
        F.when(F.col("latest_downloads") > 0, F.col("_short")[3]).otherwise("—").alias("downloads_text"),
        display.abbreviate(F.col("latest_downloads"), thousand_digits=0).alias("downloads_axis"),
        F.concat(display.one_decimal(growth), F.lit("%")).alias("growth_text"),
        display.trend_direction(growth).alias("trend_direction"),
        display.recency_text(days, "table").alias("last_release"),
        display.recency_text(days, "comparison").alias("last_release_short"),
        display.recency_status(days).alias("last_release_status"),
        F.concat(F.col("total_versions"), F.lit(" releases")).alias("versions_text"),
        F.when(F.col("license") != "", F.col("license")).otherwise("—").alias("license_text"),
        "best_in",
    )


def snippet_or_install(stats: DataFrame) -> DataFrame:
    """Code example with its source, else the install command with the registry label."""
    has = F.coalesce(F.col("code_snippet") != "", F.lit(False))
    return stats.withColumns(
        {
            "snippet": F.when(has, F.col("code_snippet")).otherwise(
                F.concat(F.lit("pip install "), "name")
            ),
            "snippet_source": F.when(has, F.coalesce("code_source", F.lit("README"))).otherwise(
                F.concat(
                    F.lit("PyPI: "), "name", F.lit(" v"), F.coalesce("latest_version", F.lit(""))
                )
            ),
        }
    )


def metric_status(stats: DataFrame) -> DataFrame:
    """Four labelled metrics with value text and traffic light, one row each."""
    days, versions = F.col("days_since_last_release"), F.col("total_versions")

    def metric(pos: int, label: str, value: Column, status: Column) -> Column:
        return F.struct(
            F.lit(pos).alias("metric_pos"), F.lit(label).alias("metric"),
            value.alias("value"), status.alias("status"),
        )

    # FIXED VALUES: labels of the view
    metrics = F.array(
        metric(
            0, "Total Versions", F.concat(F.coalesce(versions, F.lit(0)), F.lit(" releases")),
            display.band_status(versions, fixed.VERSION_BANDS),
        ),
        metric(
            1, "Last Release", display.recency_text(days, "deep_dive"),
            display.recency_status(days),
        ),
        metric(
            2, "Stars", display.grouped_number(F.col("stars")),
            display.band_status(F.col("stars"), fixed.STAR_BANDS),
        ),
        metric(
            3, "Dependents", display.grouped_number(F.col("dependents_count")),
            display.band_status(F.col("dependents_count"), fixed.DEPENDENT_BANDS),
        ),
    )
    keep = [
        c for c in ("name", "latest_version", "summary", "health_score", "snippet", "snippet_source")
        if c in stats.columns
    ]
    return stats.select(*keep, F.inline(metrics))


def deep_dive(layers: Layers, names: DataFrame, as_of: str, **options) -> DataFrame:
    """Detail view: metrics with status, description, and a code example or install command."""
    stats = package_stats(layers, names, as_of, **options).filter(F.col("error").isNull())
    return metric_status(snippet_or_install(stats))


def source_links(stats: DataFrame) -> DataFrame:
    """Registry link of every package, and its repository link when it has one."""
    links = F.array(
        F.struct(
            F.concat(F.lit("PyPI: "), "name").alias("label"),
            registry_link(F.col("name")).alias("url"),
        ),
        F.struct(
            F.concat(F.lit("GitHub: "), "name").alias("label"),
            repository_link(F.col("repository_url")).alias("url"),
        ),
    )
    return stats.select("name", F.inline(links)).filter(F.col("url").isNotNull())
