"""Top lists, growth rankings and candidate lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.functions import scoring
from pkgatlas.functions.display import grouped_number
from pkgatlas.functions.names import name_key
from pkgatlas.functions.text import contains_any
from pkgatlas.operators.build import dedupe_best, one_per_name
from pkgatlas.operators.lookup import restrict


def ordered(df: DataFrame, order: Sequence[Column], n: int = 0) -> DataFrame:
    """Sort; with ``n`` keep the first rows (a top-k, no full sort). 0 means all."""
    out = df.orderBy(*order)
    return out.limit(n) if n > 0 else out


def top_by_dependents(packages: DataFrame, n: int = 0) -> DataFrame:
    order = [F.col("dependent_count").desc_nulls_last(), F.col("name_key").asc()]
    return ordered(packages, order, n)


def top_for_names(packages: DataFrame, names: DataFrame) -> DataFrame:
    """The asked packages by dependents; no fallback to another layer."""
    return top_by_dependents(restrict(packages, names))


def metric_filter(
    packages: DataFrame,
    bounds: Mapping[str, tuple[float | None, float | None]],
    order: Sequence[Column] = (),
    n: int = 0,
) -> DataFrame:
    """Rows whose metrics lie within the closed ranges, e.g. many stars but few dependents."""
    out = packages
    for column, (low, high) in bounds.items():
        if low is not None:
            out = out.filter(F.col(column) >= low)
        if high is not None:
            out = out.filter(F.col(column) <= high)
    return ordered(out, [*order, F.col("name_key").asc()], n) if order or n else out


def growth_candidates(
    packages: DataFrame,
    min_growth: float = fixed.GROWTH_MIN_PCT,
    min_dependents: int = fixed.GROWTH_MIN_DEPENDENTS,
    min_dependents_without_stars: int = fixed.GROWTH_MIN_DEPENDENTS_WITHOUT_STARS,
) -> DataFrame:
    """Growing packages with real use: enough dependents, and stars or many dependents."""
    return packages.filter(
        (F.col("growth_pct") > min_growth)
        & (F.col("dependent_count") >= min_dependents)
        & (
            (F.coalesce("stars", F.lit(0)) > 0)
            | (F.col("dependent_count") >= min_dependents_without_stars)
        )
    )


def top_growth(packages: DataFrame, n: int = 20, **thresholds) -> DataFrame:
    """Fastest growing packages, growth damped by the log of the dependents."""
    scored = growth_candidates(packages, **thresholds).withColumn(
        "growth_score", scoring.growth_score(F.col("growth_pct"), F.col("dependent_count"))
    )
    top = ordered(scored, [F.col("growth_score").desc(), F.col("name_key").asc()], n)
    return top.select(
        F.col("package_name").alias("name"),
        "name_key",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("stars", F.lit(0)).alias("stars"),
        F.coalesce("dependent_count", F.lit(0)).alias("dependents_count"),
        F.coalesce("growth_pct", F.lit(0.0)).alias("growth_pct"),
        "growth_score",
    )


def growth_shortlist(
    results: DataFrame,
    stats: DataFrame | None = None,
    done: DataFrame | None = None,
    per: str = "query_id",
    min_dependents: int = fixed.QUALITY_MIN_DEPENDENTS,
    min_stars: int = fixed.QUALITY_MIN_STARS,
    n: int = 7,
    at_least: int = 3,
    fallback_n: int = 5,
) -> DataFrame:
    """Packages to look at for a growth question, per query.

    The ``n`` fastest growing results of real use; if fewer than ``at_least`` are left, the
    ``fallback_n`` best of all by damped growth. Names in ``done`` are dropped, ``stats``
    are attached. ``results`` needs (per, pos, name, dependents_count, stars, growth_pct).
    """
    keyed = results.withColumn("name_key", name_key(F.col("name")))
    real_use = (F.coalesce("dependents_count", F.lit(0)) >= min_dependents) & (
        F.coalesce("stars", F.lit(0)) >= min_stars
    )
    damped = scoring.growth_score(F.col("growth_pct"), F.col("dependents_count"), at_least=1)

    def branch(label: str, limit: int, score: Column) -> Column:
        return F.struct(
            F.lit(label).alias("branch"), F.lit(limit).alias("_limit"), score.alias("_score")
        )

    # both branches in one pass over the results, cut per task before the shuffle
    both = F.array_compact(
        F.array(
            F.when(real_use, branch("quality", n, F.coalesce("growth_pct", F.lit(0.0)))),
            branch("fallback", fallback_n, damped),
        )
    )
    ranked = Window.partitionBy(per, "branch").orderBy(F.col("_score").desc(), F.col("pos").asc())
    short = (
        keyed.select(per, "pos", "name", "name_key", F.inline(both))
        .withColumn("shortlist_pos", F.row_number().over(ranked))
        .filter(F.col("shortlist_pos") <= max(n, fallback_n))
        .filter(F.col("shortlist_pos") <= F.col("_limit"))
    )
    # at most n + fallback_n rows per query are left here
    real = F.count_if(F.col("branch") == "quality").over(Window.partitionBy(per))
    wanted = F.when(F.col("_real") >= at_least, "quality").otherwise("fallback")
    chosen = short.withColumn("_real", real).filter(F.col("branch") == wanted)
    chosen = dedupe_best(
        chosen.filter(F.col("name") != ""), [per, "name_key"], [F.col("shortlist_pos").asc()]
    )
    if done is not None:
        chosen = chosen.join(
            done.select(name_key(F.col("name")).alias("name_key")).distinct(),
            "name_key", "left_anti",
        )
    chosen = chosen.select(per, "shortlist_pos", "branch", "name", "name_key")
    if stats is None:
        return chosen
    known = stats.filter(F.col("error").isNull()).drop("name")
    return chosen.join(known, "name_key")


def download_candidates(
    packages: DataFrame,
    metadata: DataFrame,
    done: DataFrame | None = None,
    terms: Sequence[str] = fixed.TOPIC_TERMS,
    topic_columns: Sequence[str] = ("summary", "keywords", "name"),
    tier1: tuple[float, int] = (fixed.TIER1_GROWTH, fixed.TIER1_LIMIT),
    tier2: tuple[float, int] = (fixed.TIER2_GROWTH, fixed.TIER2_LIMIT),
) -> DataFrame:
    """Packages whose downloads are worth fetching.

    Tier 1: topic packages above the first growth bound; tier 2: any above the second.
    A package in both keeps tier 1; names in ``done(package_name)`` are dropped.
    """
    order = [F.col("growth_pct").desc(), F.col("name_key").asc()]
    meta = one_per_name(metadata, "name").select("name_key", *topic_columns)
    columns = ["package_name", "name_key", "growth_pct", "dependent_count"]
    first = ordered(
        packages.filter(F.col("growth_pct") > tier1[0])
        .join(
            meta.filter(contains_any([F.col(c) for c in topic_columns], terms)), "name_key"
        )
        .select(*columns),
        order,
        tier1[1],
    ).withColumn("tier", F.lit(1))
    second = ordered(
        packages.filter(F.col("growth_pct") > tier2[0]).select(*columns), order, tier2[1]
    ).withColumn("tier", F.lit(2))
    both = dedupe_best(first.unionByName(second), ["name_key"], [F.col("tier").asc()])
    if done is not None:
        both = both.join(
            done.select(name_key(F.col("package_name")).alias("name_key")).distinct(),
            "name_key", "left_anti",
        )
    return both


def result_map(results: DataFrame, n: int = 6, per: Sequence[str] = ("query_id", "query")) -> DataFrame:
    """The question with its first ``n`` results, one row per question.

    Only ``n`` rows per question reach the collected list.
    """
    child = F.struct(
        "pos",
        "name",
        F.coalesce("dependents_count", F.lit(0)).alias("dependents"),
        F.coalesce("health_score", F.lit(0)).alias("health"),
        F.concat(grouped_number(F.col("dependents_count")), F.lit(" dependents")).alias("used_by"),
    )
    first = results.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*per).orderBy("pos"))
    ).filter(F.col("_rn") <= n)
    return first.groupBy(*per).agg(F.array_sort(F.collect_list(child)).alias("children"))
