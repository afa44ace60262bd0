"""Saved JSON answers of the registry and the download service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.schemas import DOWNLOAD_DOC, REGISTRY_DOC


def read_download_json(
    raw: DataFrame, json_col: str = "json", category: str = fixed.DOWNLOAD_CATEGORY
) -> DataFrame:
    """Download rows of one category; entries without date or count are dropped.

    ``raw`` needs (package_name, json). Counts are cut to whole numbers.
    """
    entries = raw.select(
        "package_name", F.inline(F.from_json(json_col, DOWNLOAD_DOC)["data"])
    )
    return entries.filter(
        (F.col("category") == category) & (F.col("date") != "") & F.col("downloads").isNotNull()
    ).select(
        "package_name",
        F.col("date").alias("month"),
        F.col("downloads").cast("long").alias("downloads"),
    )


def read_metadata_json(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Registry documents flattened: info fields, number of releases, release dates.

    Dates are compared as text (ISO), null when no file has an upload time.
    """
    doc = F.from_json(json_col, REGISTRY_DOC)
    rows = raw.select(doc.alias("d")).filter(F.col("d.info").isNotNull())
    releases = F.coalesce(
        F.col("d.releases"),
        F.create_map().cast("map<string,array<struct<upload_time:string>>>"),
    )
    files = F.flatten(F.filter(F.map_values(releases), lambda f: f.isNotNull()))
    times = F.filter(
        F.transform(files, lambda f: f["upload_time"]), lambda t: t.isNotNull() & (t != "")
    )
    return rows.select(
        "d.info.name", "d.info.version", "d.info.summary", "d.info.author", "d.info.license",
        "d.info.home_page", "d.info.project_url",
        F.to_json("d.info.requires_dist").alias("requires_dist"),
        F.size(F.map_keys(releases)).cast("long").alias("total_versions"),
        F.array_max(times).alias("latest_release_date"),
        F.array_min(times).alias("first_release_date"),
    )


# FIXED VALUES: parts of a requirement text, e.g. ``name[extra] (>=1.0) ; marker``.
REQUIREMENT_NAME = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)"
REQUIREMENT_EXTRAS = r"^\s*[A-Za-z0-9._-]+\s*\[([^\]]*)\]"
REQUIREMENT_SPECIFIER = r"^\s*[A-Za-z0-9._-]+\s*(?:\[[^\]]*\])?\s*\(?([^;)]*)\)?"
REQUIREMENT_MARKER = r";\s*(.*?)\s*$"


def requirement_edges(metadata: DataFrame) -> DataFrame:
    """Dependency edges from the ``requires_dist`` JSON lists."""
    items = metadata.select(
        "name", F.explode(F.from_json("requires_dist", "array<string>")).alias("r")
    )
    return items.select(
        F.col("name").alias("project_name"),
        F.regexp_extract("r", REQUIREMENT_NAME, 1).alias("dependency_name"),
        F.regexp_extract("r", REQUIREMENT_EXTRAS, 1).alias("extras"),
        F.trim(F.regexp_extract("r", REQUIREMENT_SPECIFIER, 1)).alias("dependency_requirements"),
        F.regexp_extract("r", REQUIREMENT_MARKER, 1).alias("marker"),
    ).filter(F.col("dependency_name") != "")
