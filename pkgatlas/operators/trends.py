"""Download history and growth over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgatlas.functions.names import name_key
from pkgatlas.operators.lookup import restrict


def monthly_downloads(downloads: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Downloads per package and month.

    Names are matched ignoring case but grouped as written. Rows are summed map-side
    before the shuffle, so a hot package costs one row per task and month.
    """
    rows = downloads
    if names is not None:
        rows = restrict(rows.withColumn("name_key", name_key(F.col("package_name"))), names)
    day = F.try_to_date(F.col("month"))
    return rows.groupBy("package_name", F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.sum("downloads").alias("downloads")
    )


def pivot_downloads(monthly: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per month, one column per named package; a missing point stays null."""
    return monthly.groupBy("month").pivot("package_name", list(names)).agg(F.first("downloads"))


def latest_downloads(monthly: DataFrame) -> DataFrame:
    """Downloads in the last month of all packages; packages absent from it are left out."""
    last = monthly.agg(F.max("month")).scalar()
    return monthly.filter((F.col("month") == last) & (F.col("downloads") > 0))


def normalized_trend(monthly: DataFrame) -> DataFrame:
    """Each month as percent growth over the package's first month.

    The window holds one row per month of a package, so it stays small.
    """
    w = Window.partitionBy("package_name").orderBy("month")
    first = F.first("downloads").over(w)
    return monthly.withColumn(
        "growth_from_start",
        F.try_divide((F.col("downloads") - first) * F.lit(100.0), first.cast("double")),
    )


def release_summary(releases: DataFrame) -> DataFrame:
    """First and latest release date and number of versions per package."""
    return releases.groupBy("name").agg(
        F.min("release_date").alias("first_release_date"),
        F.max("release_date").alias("latest_release_date"),
        F.count_distinct("version").alias("total_versions"),
    )
