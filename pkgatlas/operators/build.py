"""Build the unified ``packages`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgatlas.functions import scoring
from pkgatlas.functions.names import name_key, with_name_key


def dedupe_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per key. Plans a partial group limit, so at most one row per key and
    input partition is shuffled, however hot the key is."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def yearly_growth(counts: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Growth against the row of the year before, for counts in long form.

    An equi-join on (key, year - 1) instead of ``lag``: a missing year gives no growth
    rather than growth over two years.
    """
    before = counts.select(
        key, (F.col(year) + 1).alias(year), F.col(value).alias("prior")
    )
    joined = counts.select(key, year, value).join(before, [key, year], "left")
    return joined.withColumn("growth_pct", scoring.growth_pct(F.col(value), F.col("prior")))


def best_repository(bridge: DataFrame, repos: DataFrame) -> DataFrame:
    """The repository with most stars per package; ties go to the smaller repository name."""
    linked = bridge.select(name_key(F.col("package_name")).alias("name_key"), "repo").join(
        repos, "repo", "left"
    )
    return dedupe_best(
        linked, ["name_key"], [F.col("stars").desc_nulls_last(), F.col("repo").asc()]
    )


def build_packages(
    dependents: DataFrame,
    bridge: DataFrame,
    repos: DataFrame,
    prior: DataFrame | None = None,
) -> DataFrame:
    """Dependents, best repository and optional prior-year dependents, one row per package.

    ``dependents(package_name, dependent_count)`` drives; without ``prior`` the growth
    columns are null and no join is planned for them.
    """
    base = dedupe_best(
        with_name_key(dependents, "package_name"),
        ["name_key"],
        [F.col("dependent_count").desc_nulls_last(), F.col("package_name").asc()],
    )
    out = base.join(best_repository(bridge, repos), "name_key", "left")
    if prior is None:
        out = out.withColumn("dependent_count_prior", F.lit(None).cast("long"))
    else:
        before = prior.groupBy(name_key(F.col("package_name")).alias("name_key")).agg(
            F.max("dependent_count").alias("dependent_count_prior")
        )
        out = out.join(before, "name_key", "left")
    return out.select(
        "package_name",
        "name_key",
        "description",
        "stars",
        "forks",
        "open_issues",
        "dependent_count",
        "dependent_count_prior",
        scoring.growth_pct(F.col("dependent_count"), F.col("dependent_count_prior")).alias(
            "growth_pct"
        ),
        "repo",
    )


def unify(fresh: DataFrame, historical: DataFrame) -> DataFrame:
    """All names of both layers; per column the fresh value, else the historical one."""
    f = fresh.alias("f")
    h = dedupe_best(
        with_name_key(historical, "name"), ["name_key"], [F.col("name").asc()]
    ).alias("h")
    joined = f.join(h, F.col("f.name_key") == F.col("h.name_key"), "full_outer")
    return joined.select(
        F.coalesce("f.package_name", "h.name").alias("package_name"),
        F.coalesce("f.name_key", "h.name_key").alias("name_key"),
        F.coalesce("f.description", "h.description").alias("description"),
        F.coalesce("f.stars", "h.stars").alias("stars"),
        F.coalesce("f.forks", "h.forks").alias("forks"),
        F.coalesce("f.dependent_count", "h.dependents_count").alias("dependent_count"),
        F.col("f.growth_pct").alias("growth_pct"),
        F.coalesce("f.repo", "h.repository_url").alias("repo"),
        F.when(F.col("h.name_key").isNull(), "fresh")
        .when(F.col("f.name_key").isNull(), "historical")
        .otherwise("both")
        .alias("source"),
    )


def package_full(packages: DataFrame, metadata: DataFrame, how: str = "left") -> DataFrame:
    """Packages with their registry record, every model field with its default."""
    meta = one_per_name(metadata, "name")
    joined = packages.join(meta.drop("name"), "name_key", how)
    text = [
        "summary", "readme", "keywords", "version", "author", "license",
        "requires_python", "latest_release_date", "first_release_date", "home_page",
    ]
    return joined.select(
        "package_name",
        "name_key",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("dependent_count", "stars", "forks", "open_issues")
        ],
        F.coalesce("repo", F.lit("")).alias("repo"),
        F.coalesce("growth_pct", F.lit(0.0)).alias("growth_pct"),
        F.coalesce("dependent_count_prior", F.lit(0)).alias("dependent_count_prior"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        *[F.coalesce(c, F.lit("[]")).alias(c) for c in ("classifiers", "requires_dist")],
        F.coalesce("total_versions", F.lit(0)).alias("total_versions"),
    )


def one_per_name(df: DataFrame, name_col: str) -> DataFrame:
    """One row per case-folded name; the smallest spelling is kept."""
    return dedupe_best(with_name_key(df, name_col), ["name_key"], [F.col(name_col).asc()])


def fill_defaults(df: DataFrame) -> DataFrame:
    """Nulls to 0, 0.0 or "" by column type."""
    filled = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("int", "bigint", "smallint", "tinyint"):
            filled.append(F.coalesce(field.name, F.lit(0).cast(kind)).alias(field.name))
        elif kind in ("double", "float"):
            filled.append(F.coalesce(field.name, F.lit(0.0).cast(kind)).alias(field.name))
        elif kind == "string":
            filled.append(F.coalesce(field.name, F.lit("")).alias(field.name))
        else:
            filled.append(F.col(field.name))
    return df.select(*filled)


CANONICAL = {
    "package_name": "name",
    "description": "description",
    "stars": "stars",
    "forks": "forks",
    "dependent_count": "dependents_count",
    "repo": "repository_url",
}


def canonical(df: DataFrame, columns: dict[str, str] = CANONICAL) -> DataFrame:
    """Rename to the names answers use; columns the frame lacks are left out."""
    return df.select(*[F.col(c).alias(new) for c, new in columns.items() if c in df.columns])
