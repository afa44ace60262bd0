"""Composite answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgatlas.functions.names import name_key
from pkgatlas.operators.compare import banner, with_latest_downloads
from pkgatlas.operators.health import package_stats
from pkgatlas.operators.lookup import Layers
from pkgatlas.operators.rank import growth_shortlist, result_map
from pkgatlas.operators.search import hybrid_search, query_intent
from pkgatlas.operators.trends import monthly_downloads
from pkgatlas.session import materialize


def explore_rows(
    layers: Layers,
    corpus: DataFrame,
    queries: DataFrame,
    as_of: str,
    limit: int = 30,
    shown: int | None = None,
    latest: DataFrame | None = None,
    growth: Mapping[str, float] | None = None,
    semantic: Mapping[str, float] | None = None,
    shortlist: Mapping[str, float] | None = None,
) -> DataFrame:
    """Packages an explore answer looks at, with their statistics, in answer order.

    A growth question that names no concrete field takes the growth shortlist of its hits;
    any other question takes its hits, or the first ``shown`` of them.
    """
    intent = query_intent(queries.select("query_id", "query"))
    # a few rows per question: stored once, read by the shortlist, the list and the statistics
    hits = materialize(
        hybrid_search(layers.fresh, corpus, queries, limit, growth, semantic).join(
            intent.select("query_id", "query", "growth_override"), "query_id"
        ),
        "search-hits",
    )
    listed = growth_shortlist(
        hits.filter("growth_override"), per="query_id", **(shortlist or {})
    ).select("query_id", F.col("shortlist_pos").alias("pos"), "name")
    wanted = ~F.col("growth_override")
    if shown is not None:
        wanted = wanted & (F.col("pos") <= shown)
    first = hits.filter(wanted).select("query_id", "pos", "name")
    asked = hits.select("query_id", "query", "growth_override").distinct()
    chosen = materialize(listed.unionByName(first).join(asked, "query_id"), "search-chosen")
    rows = chosen.join(package_stats(layers, chosen, as_of), "name")
    if latest is None:
        return rows.withColumn("latest_downloads", F.lit(None).cast("long"))
    return with_latest_downloads(rows, latest)


def explore_report(rows: DataFrame) -> DataFrame:
    """One row per question: the banner, downloads of the last month and the result map."""
    per = ["query_id", "query", "growth_override"]
    totals = rows.groupBy("query_id").agg(
        F.sum(F.coalesce("latest_downloads", F.lit(0))).alias("latest_downloads")
    )
    maps = result_map(rows, per=("query_id",))
    return banner(rows, per).join(totals, "query_id").join(maps, "query_id")


def explore_series(rows: DataFrame, downloads: DataFrame) -> DataFrame:
    """Monthly downloads of the packages of each answer: (query_id, month, points).

    ``points`` holds a (pos, name, downloads) per package with downloads in that month, in answer
    order, so a month no package has is no row and a package without history is in no point.
    Spellings of a name are summed; days that are no date have no month and stay out. Downloads
    are filtered by the answered names before they are summed, and summed before any join; an
    array holds at most as many points as the answer has packages.
    """
    chosen = rows.select("query_id", "pos", "name", name_key(F.col("name")).alias("name_key"))
    monthly = monthly_downloads(downloads, chosen.select("name").distinct()).filter(F.col("month").isNotNull())
    by_key = monthly.groupBy(name_key(F.col("package_name")).alias("name_key"), "month").agg(
        F.sum("downloads").alias("downloads")
    )
    point = F.struct("pos", "name", "downloads")
    return chosen.join(by_key, "name_key").groupBy("query_id", "month").agg(F.array_sort(F.collect_list(point)).alias("points"))
