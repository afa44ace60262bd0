"""Layered lookups, dependency edges, counts.

``names`` is a frame with a ``name`` column. Answers keep the spelling that was asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pkgatlas.functions.names import name_key, with_name_key
from pkgatlas.operators.build import one_per_name
from pkgatlas.session import materialize, new_work_path
from pkgatlas.sources.edge_index import write_edge_index

#: Pieces that the edges of one name are dealt to.
EDGE_PIECES = 32


@dataclass(frozen=True)
class Layers:
    """The tables at hand; ``None`` means the table does not exist."""

    fresh: DataFrame | None = None
    projects: DataFrame | None = None
    deps: DataFrame | None = None
    versions: DataFrame | None = None
    metadata: DataFrame | None = None
    downloads: DataFrame | None = None

    @classmethod
    def from_catalog(cls, spark: SparkSession, **tables: str) -> Layers:
        """Bind table names; a table the catalog lacks becomes ``None``."""
        known = {f.name for f in fields(cls)}
        unknown = set(tables) - known
        if unknown:
            raise ValueError(f"unknown layers: {sorted(unknown)}")
        return cls(
            **{k: spark.table(t) for k, t in tables.items() if spark.catalog.tableExists(t)}
        )


def name_list(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """A frame of a few names whose size Spark knows, so that joins with it are broadcast."""
    values = F.array(*[F.lit(n) for n in names])
    return spark.range(1).select(F.explode(values).alias("name"))


def asked(names: DataFrame) -> DataFrame:
    """Distinct requested spellings with their key."""
    return names.select("name").distinct().withColumn("name_key", name_key(F.col("name")))


def stored_names(names: DataFrame) -> DataFrame:
    """The distinct ``names``, written once when they are too many to broadcast: an answer reads them for every layer."""
    distinct = names.select("name").distinct()
    return distinct if _fits_broadcast(distinct) else materialize(distinct, "names")


def restrict(df: DataFrame, names: DataFrame, key: str = "name_key") -> DataFrame:
    """Rows whose name was asked for (any spelling).

    A short list is broadcast by its size, and the filter then sinks through an
    aggregation or window on the key down to the scan; a long one is met after it.
    """
    keys = names.select(name_key(F.col("name")).alias(key)).distinct()
    return df.join(keys, key, "left_semi")


def first_non_empty(
    a: DataFrame, b: DataFrame, per: list[str] | None = None
) -> DataFrame:
    """``a``, and ``b`` where ``a`` is empty: for each ``per`` key, or as a whole."""
    if per:
        return a.unionByName(b.join(a.select(*per).distinct(), per, "left_anti"))
    return a.unionByName(b.filter(~a.exists()))


def _one_each(table: DataFrame | None, name_col: str, names: DataFrame) -> DataFrame | None:
    """One row per asked name key; rows nobody asked for go before anything is sorted."""
    if table is None:
        return None
    return one_per_name(restrict(with_name_key(table, name_col), names), name_col)


def lookup(layers: Layers, names: DataFrame) -> DataFrame:
    """At most one row per asked name: the fresh row whole, else the historical one."""
    found = health_metrics(layers, names).filter("found_in_db")
    return found.select(
        "name", "name_key", "package_name", "description", "stars", "forks",
        "dependents_count", "repository_url", "layer",
    )


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy(name_key(F.col("project_name")).alias("name_key")).agg(
        F.count("*").alias("version_count")
    )


def edge_counts(edges: DataFrame, on: str = "dependency_name") -> DataFrame:
    """Edge rows per dependency (or project). Counted before any join, so a hot key is cut map-side."""
    return edges.groupBy(name_key(F.col(on)).alias("name_key")).agg(F.count("*").alias("edge_count"))


def dependents_count(layers: Layers, names: DataFrame) -> DataFrame:
    """Fresh count if non-zero, else the edges counted, else the stored count, else 0."""
    out = asked(names)
    fresh = edges = stored = F.lit(None).cast("long")
    if layers.fresh is not None:
        out = out.join(
            _one_each(layers.fresh, "package_name", names).select("name_key", F.col("dependent_count").alias("_fresh")),
            "name_key", "left",
        )
        fresh = F.col("_fresh")
    if layers.deps is not None:
        counts = restrict(edge_counts(layers.deps), names)
        out = out.join(counts, "name_key", "left")
        edges = F.coalesce("edge_count", F.lit(0))
    elif layers.projects is not None:
        out = out.join(
            _one_each(layers.projects, "name", names).select("name_key", F.col("dependents_count").alias("_stored")),
            "name_key", "left",
        )
        stored = F.col("_stored")
    count = F.when(fresh != 0, fresh).otherwise(F.coalesce(edges, stored, F.lit(0)))
    return out.select("name", "name_key", count.cast("long").alias("dependents_count"))


def health_metrics(layers: Layers, names: DataFrame) -> DataFrame:
    """Metrics merged over the layers.

    A fresh row that was found wins whole, even where it holds null; the historical row
    only serves names without a fresh one. Licence and last release are always historical.
    """
    out = asked(names)
    f_found = h_found = F.lit(False)
    if layers.fresh is not None:
        f = _one_each(layers.fresh, "package_name", names).select(
            "name_key", *[F.col(c).alias(f"f_{c}") for c in (
                "package_name", "stars", "forks", "dependent_count", "open_issues",
                "repo", "description", "growth_pct",
            )],
        )
        out = out.join(f, "name_key", "left")
        f_found = F.col("f_package_name").isNotNull()
    if layers.projects is not None:
        h = _one_each(layers.projects, "name", names).select(
            "name_key", *[F.col(c).alias(f"h_{c}") for c in (
                "name", "stars", "forks", "dependents_count", "repository_url",
                "description", "licenses", "latest_release_ts",
            )],
        )
        out = out.join(h, "name_key", "left")
        h_found = F.col("h_name").isNotNull()
    versions = F.lit(0).cast("long")
    if layers.versions is not None:
        counts = restrict(version_counts(layers.versions), names)
        out = out.join(counts, "name_key", "left")
        versions = F.coalesce("version_count", F.lit(0))

    have = set(out.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def layered(fresh: str, hist: str, kind: str) -> Column:
        return F.when(f_found, col(fresh, kind)).otherwise(col(hist, kind))

    return out.select(
        "name",
        "name_key",
        (f_found | h_found).alias("found_in_db"),
        F.when(f_found, "fresh").when(h_found, "historical").alias("layer"),
        F.coalesce(layered("f_package_name", "h_name", "string"), "name").alias("package_name"),
        layered("f_stars", "h_stars", "long").alias("stars"),
        layered("f_forks", "h_forks", "long").alias("forks"),
        layered("f_dependent_count", "h_dependents_count", "long").alias("dependents_count"),
        col("f_open_issues", "long").alias("open_issues"),
        layered("f_repo", "h_repository_url", "string").alias("repository_url"),
        layered("f_description", "h_description", "string").alias("description"),
        col("f_growth_pct", "double").alias("growth_pct"),
        col("h_licenses", "string").alias("license"),
        col("h_latest_release_ts", "string").alias("last_release_ts"),
        versions.alias("total_versions"),
    )


def _edge_topk(edges: DataFrame, names: DataFrame, on: str, other: str, limit: int) -> DataFrame:
    """The first ``limit`` edges of each name, by the shown columns; 0 numbers them all.

    A list short enough to broadcast filters the scan, and each task cuts a name before the
    shuffle. For a longer one names are cut in pieces first, so the edges of one popular package
    spread over ``EDGE_PIECES`` tasks; names meet only what is left, so each travels once. All edges
    are numbered through an index in the work folder, so no task holds a whole name.
    """
    if limit <= 0:
        path = new_work_path(edges.sparkSession, "edges")
        wanted = restrict(edges.withColumn("name_key", name_key(F.col(on))), names).drop("name_key")
        return write_edge_index(wanted, path, on).listed(asked(names), 0)
    columns = [other, "dependency_kind", "dependency_requirements"]
    order = [F.col(c).asc() for c in columns]
    top = edges.select(name_key(F.col(on)).alias("name_key"), *columns)
    keys = names.select(name_key(F.col("name")).alias("name_key")).distinct()
    if _fits_broadcast(keys):
        top = top.join(keys, "name_key", "left_semi")
    else:
        top = top.withColumn("_piece", F.pmod(F.xxhash64(*columns), F.lit(EDGE_PIECES)).cast("int"))
        w = Window.partitionBy("name_key", "_piece").orderBy(*order)
        top = top.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    w = Window.partitionBy("name_key").orderBy(*order)
    top = top.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
    return asked(names).join(top.select("name_key", "pos", *columns), "name_key")


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's estimate of ``df`` is below the session's broadcast threshold."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= threshold


def dependencies(edges: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` direct dependencies per asked project; 0 means all."""
    return _edge_topk(edges, names, "project_name", "dependency_name", limit)


def reverse_dependencies(edges: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` projects that depend on each asked package; 0 means all."""
    return _edge_topk(edges, names, "dependency_name", "project_name", limit)


def dataset_stats(layers: Layers) -> DataFrame:
    """One row: packages and dependency edges; an absent table counts 0."""
    counts = {
        name: F.lit(0).cast("long") if table is None else table.agg(F.count("*")).scalar()
        for name, table in (
            ("total_packages", layers.fresh), ("total_dependencies", layers.deps)
        )
    }
    spark = next(t for t in (layers.fresh, layers.deps) if t is not None).sparkSession
    return spark.range(1).select(*[c.alias(name) for name, c in counts.items()])


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table, as a load check."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).cast("long").alias("column_count"),
            F.lit(",".join(df.columns)).alias("columns"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


