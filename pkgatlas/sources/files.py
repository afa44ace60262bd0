"""Readers and writers for exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgatlas.functions.names import name_key, with_name_key


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options: str
) -> DataFrame:
    """CSV with a header; rows that do not fit the schema are skipped (see ``rejected_csv``).

    Quoted fields may hold line breaks and doubled quotes, so a file is one task: convert
    large exports to Parquet once. ``multiLine="false"`` splits files whose fields hold no breaks.
    """
    return _parsed_csv(spark, path, schema, options).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def rejected_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options: str
) -> DataFrame:
    """The rows that ``read_csv`` skips, as they stand in the file: (record)."""
    rows = _parsed_csv(spark, path, schema, options)
    return rows.filter(F.col("_corrupt_record").isNotNull()).select(F.col("_corrupt_record").alias("record"))


def _parsed_csv(spark: SparkSession, path, schema, options) -> DataFrame:
    """The parser only checks the columns a query reads, so the filter reads all of them:
    the same rows are kept whatever is selected."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    checked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = (
        spark.read.schema(checked)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("enforceSchema", "true")
        .option("escape", '"')
        .option("multiLine", "true")
        .options(**options)
        .csv(path)
    )
    reads_all = F.hash(*schema.names) >= -(2**31)  # always true
    return rows.filter(reads_all)


def optional(df: DataFrame | None, columns: Sequence[str], like: DataFrame) -> DataFrame:
    """``like`` with the columns of an absent table as nulls; unchanged when it is there."""
    if df is not None:
        return like
    return like.withColumns({c: F.lit(None).cast("long") for c in columns})


def ingest_platform(df: DataFrame, platform: str, column: str = "platform") -> DataFrame:
    """Keep one platform, so that later scans are smaller."""
    return df.filter(F.col(column) == platform)


def write_edges(edges: DataFrame, path: str, key: str = "dependency_name") -> None:
    """Edges with their case-folded key, sorted by it inside each file.

    Row-group statistics then prune a lookup by key. No repartition by key: a hot
    dependency would end in one task.
    """
    with_name_key(edges, key).sortWithinPartitions("name_key").write.parquet(path)


def write_bucketed(
    df: DataFrame, table: str, name_col: str, buckets: int = 64, path: str | None = None
) -> None:
    """A table bucketed by name key, so joins on it need no shuffle of this side.

    For tables with one row per name; in an edge table a hot name would fill one bucket.
    """
    writer = (
        df.withColumn("name_key", name_key(F.col(name_col)))
        .write.bucketBy(buckets, "name_key")
        .sortBy("name_key")
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)


def not_yet(df: DataFrame, done: DataFrame, key: str = "name", fold: bool = False) -> DataFrame:
    """Rows whose key is not in ``done``; ``fold`` ignores case."""
    if not fold:
        return df.join(done.select(key).distinct(), key, "left_anti")
    keys = done.select(name_key(F.col(key)).alias("_k")).distinct()
    return df.withColumn("_k", name_key(F.col(key))).join(keys, "_k", "left_anti").drop("_k")


def distinct_names(df: DataFrame, name_col: str = "package_name") -> DataFrame:
    return df.select(name_col).distinct()


def merge_downloads(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append download rows; per (name, month) the newest batch wins.

    ``new`` carries ``batch`` (a growing number); stored rows count as oldest. One
    aggregation with map-side combine, no window over a package.
    """
    rows = existing.withColumn("batch", F.lit(-1).cast("long")).unionByName(
        new.withColumn("batch", F.col("batch").cast("long"))
    )
    newest = F.max(F.struct("batch", "downloads"))
    return (
        rows.groupBy("package_name", "month")
        .agg(newest.alias("r"))
        .select("package_name", "month", "r.downloads")
    )
