"""Package names, name lists, repository URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgatlas import fixed

BLANKS = " \t\n\r\x0b\x0c"


def name_key(name: Column) -> Column:
    """Case-folded join key. Store it with the table: ``lower(x) = y`` is not pushed to a scan."""
    return F.lower(name)


def with_name_key(df: DataFrame, name_col: str, key: str = "name_key") -> DataFrame:
    return df if key in df.columns else df.withColumn(key, name_key(F.col(name_col)))


def normalize_name(name: Column) -> Column:
    """Registry rule for equal names: lower case, runs of ``-``, ``_``, ``.`` become one ``-``."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def parse_name_list(text: Column, max_names: int | None = None) -> Column:
    """Split a comma list, trim, drop blanks, keep the first ``max_names``."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p, F.lit(BLANKS)))
    parts = F.filter(parts, lambda p: p != "")
    return parts if max_names is None else F.slice(parts, 1, max_names)


def explode_name_list(
    df: DataFrame, text_col: str, max_names: int | None = None, min_names: int = 1
) -> DataFrame:
    """One row per listed name with its position and the length of its list.

    Lists shorter than ``min_names`` are dropped.
    """
    names = parse_name_list(F.col(text_col), max_names)
    keep = [c for c in df.columns if c != text_col]
    listed = df.select(*keep, names.alias("_names"))
    # the outer form keeps the optimizer from parsing every list again in extra filters
    rows = listed.select(
        *keep, F.size("_names").cast("long").alias("listed"),
        F.posexplode_outer("_names").alias("pos", "name"),
    )
    return rows.filter(F.col("name").isNotNull() & (F.col("listed") >= min_names))


def repo_parts(url: Column) -> Column:
    """``struct(owner, repo)`` from the first two path parts of a URL, else null."""
    path = F.regexp_replace(F.rtrim(url, F.lit("/")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(path, r"^[^?#]*", 0), r";[^/]*$", "")
    parts = F.split(F.trim(path, F.lit("/")), "/")
    return F.when(
        F.size(parts) >= 2,
        F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("repo")),
    )


def repository_link(repo: Column) -> Column:
    """Absolute repository URL; null when there is none."""
    url = F.when(repo.startswith("http"), repo).otherwise(
        F.concat(F.lit(fixed.REPOSITORY_HOST), repo)
    )
    return F.when(repo != "", url)


def registry_link(name: Column) -> Column:
    return F.concat(F.lit(fixed.REGISTRY_URL), name, F.lit("/"))
