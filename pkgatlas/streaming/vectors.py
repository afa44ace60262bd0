"""Stream of new or changed packages to a kept vector table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pkgatlas.operators.build import dedupe_best
from pkgatlas.operators.embed import hashed_tfidf
from pkgatlas.sources.tables import KeyedTable

SCHEMA = "id long, name string, text_hash long, embedding array<float>, batch_id long"
#: Deltas after which the table is compacted.
COMPACT_AFTER = 32


def vector_table(spark: SparkSession, target: str) -> KeyedTable:
    return KeyedTable(spark, target, ["id"], SCHEMA)


def plain_vectors(df: DataFrame, dim: int = 64) -> DataFrame:
    """Default embedding: no weights that depend on the other rows of a batch."""
    return hashed_tfidf(df, "id", "embedding_text", dim, use_idf=False)


def current_vectors(spark: SparkSession, target: str) -> DataFrame:
    """Newest vector per id."""
    return vector_table(spark, target).read()


def start_vectors(
    packages: DataFrame,
    target: str,
    checkpoint: str,
    embed: Callable[[DataFrame], DataFrame] = plain_vectors,
    compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Embed new and changed rows of a stream (id, name, embedding_text, updated_at).

    Of several rows of one id in a batch the newest by ``updated_at`` counts. Rows whose text is
    stored already are skipped: only the stored rows of the batch's ids are looked at, before
    anything is sorted. Each micro-batch is one commit of the table, so a replay changes nothing;
    after ``compact_after`` deltas they become a new base. One stream, with its checkpoint,
    writes a table.
    """
    table = vector_table(packages.sparkSession, target)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("text_hash", F.xxhash64("embedding_text"))
        rows = dedupe_best(rows, ["id"], [F.col("updated_at").desc_nulls_last(), F.col("text_hash").asc()])
        stored = table.manifest()
        if stored.last_batch >= batch_id:
            return
        if stored.version:
            known = table.read(stored.version).select("id", "text_hash").join(rows.select("id"), "id", "left_semi")
            rows = rows.join(known, ["id", "text_hash"], "left_anti")
        new = rows.select("id", "name", "text_hash").join(embed(rows), "id").withColumn("batch_id", F.lit(batch_id).cast("long"))
        if len(table.upsert(new, batch_id).deltas) >= compact_after:
            table.compact()

    return (
        packages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
