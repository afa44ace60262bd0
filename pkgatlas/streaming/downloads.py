"""Stream of new download documents to monthly totals that are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pkgatlas.operators.trends import monthly_downloads
from pkgatlas.sources.documents import read_download_json
from pkgatlas.sources.tables import KeyedTable

STORED = "package_name string, month string, downloads long"
#: Deltas after which a table is compacted.
COMPACT_AFTER = 32


def daily_table(spark: SparkSession, target: str) -> KeyedTable:
    """One row per package and date."""
    return KeyedTable(spark, f"{target}/daily", ["package_name", "month"], STORED)


def totals_table(spark: SparkSession, target: str) -> KeyedTable:
    """One row per package and month."""
    return KeyedTable(spark, f"{target}/totals", ["package_name", "month"], STORED)


def start_downloads(raw: DataFrame, target: str, checkpoint: str, compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Keep the newest count per package and date, and monthly totals of them.

    A batch adds to a month what its counts differ from the stored ones, so only the batch's
    packages and dates are looked up and no history is summed again. No row is too late, and a
    corrected number counts in place of the first. The totals are committed before the counts
    that they were computed from: a replay after a stop between the two finds the totals done and
    only stores the counts, so each batch counts once. One stream, with its checkpoint, writes a
    folder.
    """
    daily, totals = daily_table(raw.sparkSession, target), totals_table(raw.sparkSession, target)

    def store(batch: DataFrame, batch_id: int) -> None:
        # a date told twice in one batch: the larger count, whatever the order of arrival
        rows = batch.groupBy("package_name", "month").agg(F.max("downloads").alias("downloads"))
        if totals.manifest().last_batch < batch_id:
            known = daily.read().withColumnRenamed("downloads", "before")
            change = rows.join(known, ["package_name", "month"], "left").select(
                "package_name", "month", (F.col("downloads") - F.coalesce("before", F.lit(0))).alias("downloads")
            )
            added = monthly_downloads(change)
            old = totals.read().withColumnRenamed("downloads", "before")
            # a date that cannot be read has no month; its total is kept like any other
            same = added["package_name"].eqNullSafe(old["package_name"]) & added["month"].eqNullSafe(old["month"])
            new = added.join(old, same, "left").select(
                added["package_name"], added["month"],
                (F.col("downloads") + F.coalesce("before", F.lit(0))).alias("downloads"),
            )
            if len(totals.upsert(new, batch_id).deltas) >= compact_after:
                totals.compact()
        if len(daily.upsert(rows, batch_id).deltas) >= compact_after:
            daily.compact()

    return (
        read_download_json(raw)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def current_downloads(spark: SparkSession, target: str) -> DataFrame:
    """One row per package and date: the newest batch wins, as in ``merge_downloads``."""
    return daily_table(spark, target).read()


def monthly_totals(spark: SparkSession, target: str) -> DataFrame:
    """Totals per package and month over all batches, as they are stored."""
    return totals_table(spark, target).read()
