"""Package statistics, health checks and dependents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.functions import scoring
from pkgatlas.functions.names import with_name_key
from pkgatlas.functions.readme import code_snippet
from pkgatlas.operators.build import one_per_name
from pkgatlas.operators.lookup import (
    Layers,
    dependencies,
    dependents_count,
    edge_counts,
    health_metrics,
    restrict,
    reverse_dependencies,
    stored_names,
)

NOT_FOUND = "not found in database or registry"


def package_stats(
    layers: Layers,
    names: DataFrame,
    as_of: str,
    weights: Mapping[str, float] = fixed.SCORE_WEIGHTS,
    snippets: bool = True,
) -> DataFrame:
    """Metrics, registry data and health score, one row per asked name.

    A name neither side knows gives a row with both found flags false and ``error`` set.
    A zero version count is replaced by the registry's; the registry's release date comes
    before the historical one.
    """
    return _stats(layers, stored_names(names), as_of, weights, snippets)


def _stats(
    layers: Layers, names: DataFrame, as_of: str, weights: Mapping[str, float] = fixed.SCORE_WEIGHTS, snippets: bool = True
) -> DataFrame:
    base = health_metrics(layers, names)
    columns = {
        "version": "string", "summary": "string", "author": "string", "license": "string",
        "total_versions": "long", "latest_release_date": "string", "requires_dist": "string",
        "code_snippet": "string",
    }
    if layers.metadata is not None:
        # the README is reduced to its code example before its row is sorted and joined
        meta = restrict(with_name_key(layers.metadata, "name"), names)
        example = code_snippet(F.col("readme")) if snippets else F.lit(None).cast("string")
        meta = one_per_name(
            meta.withColumn("code_snippet", example).select("name", "name_key", *columns), "name"
        ).select(
            "name_key", *[F.col(c).alias(f"m_{c}") for c in columns], F.lit(True).alias("m_found")
        )
        base = base.join(meta, "name_key", "left")
    else:
        base = base.withColumns(
            {f"m_{c}": F.lit(None).cast(kind) for c, kind in columns.items()}
        ).withColumn("m_found", F.lit(False))

    found_registry = F.coalesce("m_found", F.lit(False))
    release = F.coalesce(
        F.when(F.col("m_latest_release_date") != "", F.col("m_latest_release_date")),
        "last_release_ts",
    )
    zero = F.lit(0).cast("long")
    rows = base.select(
        "name",
        "name_key",
        "found_in_db",
        found_registry.alias("found_in_registry"),
        F.when(
            ~F.col("found_in_db") & ~found_registry,
            F.concat(F.lit("Package '"), "name", F.lit("' " + NOT_FOUND)),
        ).alias("error"),
        F.coalesce("stars", zero).alias("stars"),
        F.coalesce("forks", zero).alias("forks"),
        F.coalesce("dependents_count", zero).alias("dependents_count"),
        F.when(F.col("total_versions") != 0, F.col("total_versions"))
        .otherwise(F.coalesce("m_total_versions", zero))
        .alias("total_versions"),
        F.coalesce("repository_url", F.lit("")).alias("repository_url"),
        F.coalesce("license", F.lit("")).alias("license"),
        F.coalesce("growth_pct", F.lit(0.0)).alias("growth_pct"),
        F.coalesce("m_version", F.lit("")).alias("latest_version"),
        F.coalesce("m_summary", F.lit("")).alias("summary"),
        F.coalesce("m_author", F.lit("")).alias("author"),
        F.coalesce("m_license", F.lit("")).alias("registry_license"),
        F.coalesce("m_total_versions", zero).alias("registry_total_versions"),
        F.coalesce("m_latest_release_date", F.lit("")).alias("latest_release_date"),
        F.coalesce("m_requires_dist", F.lit("[]")).alias("requires_dist"),
        scoring.days_since(release, as_of).alias("days_since_last_release"),
        F.col("m_code_snippet").alias("code_snippet"),
    )
    score = scoring.health_score(
        F.col("dependents_count"), F.col("stars"), F.col("days_since_last_release"),
        F.col("total_versions"), weights,
    )
    return (
        rows.withColumn("health_score", score)
        .withColumn("score_label", scoring.score_label(F.col("health_score")))
        .withColumn("score_color", scoring.score_color(F.col("health_score")))
        .withColumn("code_source", F.when(F.col("code_snippet").isNotNull(), "README"))
    )


def health_check(layers: Layers, names: DataFrame, as_of: str, **options) -> DataFrame:
    """Statistics plus risks and risk level; unknown names are left out."""
    stats = package_stats(layers, names, as_of, **options).filter(F.col("error").isNull())
    return stats.withColumn(
        "risks",
        scoring.risk_flags(
            F.col("days_since_last_release"), F.col("dependents_count"), F.col("stars"),
            F.col("total_versions"),
        ),
    ).withColumn("risk_level", scoring.risk_level(F.col("health_score")))


def package_detail(
    layers: Layers, names: DataFrame, as_of: str, limit: int = 20, **options
) -> DataFrame:
    """Statistics with the first dependencies and reverse dependencies as arrays.

    The arrays hold at most ``limit`` items: the cut is made before they are collected.
    ``..._shown`` counts these, ``..._total`` all edges there are.
    """
    names = stored_names(names)
    stats = _stats(layers, names, as_of, **options)

    def listed(edges: DataFrame, other: str, alias: str) -> DataFrame:
        item = F.struct("pos", other, "dependency_kind", "dependency_requirements")
        rows = edges.groupBy("name").agg(F.array_sort(F.collect_list(item)).alias(alias))
        return rows.select(
            "name",
            F.transform(alias, lambda e: e[other]).alias(alias),
            F.size(alias).cast("long").alias(f"{alias}_shown"),
        )

    if layers.deps is None:
        empty = F.array().cast("array<string>")
        return stats.withColumns(
            {
                "dependencies": empty, "dependencies_shown": F.lit(0).cast("long"),
                "reverse_dependencies": empty, "reverse_dependencies_shown": F.lit(0).cast("long"),
                "dependencies_total": F.lit(0).cast("long"), "reverse_dependencies_total": F.lit(0).cast("long"),
            }
        )
    forward = listed(dependencies(layers.deps, names, limit), "dependency_name", "dependencies")
    backward = listed(
        reverse_dependencies(layers.deps, names, limit), "project_name", "reverse_dependencies"
    )
    none = F.array().cast("array<string>")

    def total(on: str, alias: str) -> DataFrame:
        return restrict(edge_counts(layers.deps, on), names).withColumnRenamed("edge_count", alias)

    return (
        stats.join(forward, "name", "left")
        .join(backward, "name", "left")
        .join(total("project_name", "dependencies_total"), "name_key", "left")
        .join(total("dependency_name", "reverse_dependencies_total"), "name_key", "left")
        .withColumns(
            {
                c: F.coalesce(c, none) for c in ("dependencies", "reverse_dependencies")
            }
        )
        .withColumns(
            {
                c: F.coalesce(c, F.lit(0).cast("long"))
                for c in (
                    "dependencies_shown", "reverse_dependencies_shown",
                    "dependencies_total", "reverse_dependencies_total",
                )
            }
        )
    )


def dependents(layers: Layers, names: DataFrame, limit: int = 50) -> DataFrame:
    """Dependents count and the first ``limit`` dependents, one row per dependent."""
    names = stored_names(names)
    counts = dependents_count(layers, names)
    if layers.deps is None:
        return counts.withColumns(
            {"pos": F.lit(None).cast("int"), "project_name": F.lit(None).cast("string")}
        )
    listed = reverse_dependencies(layers.deps, names, limit).select("name", "pos", "project_name")
    return counts.join(listed, "name", "left")


def score_table(df: DataFrame, weights: Mapping[str, float] = fixed.SCORE_WEIGHTS) -> DataFrame:
    """Score, label and colour for a frame with the four inputs."""
    score = scoring.health_score(
        F.col("dependents_count"), F.col("stars"), F.col("days_since_last_release"),
        F.col("total_versions"), weights,
    )
    return df.withColumn("health_score", score).withColumns(
        {
            "score_label": scoring.score_label(score),
            "score_color": scoring.score_color(score),
        }
    )

