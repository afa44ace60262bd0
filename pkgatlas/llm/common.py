"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgatlas.session import discard, materialize, new_work_path

#: White space of the contracts: space and the control characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words between the contracts' white space; none for an empty text."""
    return F.array_remove(F.split(text, f"{WHITE_CLASS}+", -1), "")


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path."""
    path = new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in the given order.

    Rows are dealt by ranges of the order and stored once; each range then starts where the
    ones before it end. Rows that tie are told apart by their place in the input, so even a
    value held by most rows spreads over tasks. No task sees more than its own range.
    """
    spark = df.sparkSession
    columns = df.columns
    # the place is stored first: a range shuffle reads its input twice
    placed, first = store(df.withColumn("__tie", F.monotonically_increasing_id()), "placed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        placed.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order], "__tie")
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], "__tie")
        .withColumn("__range", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id())
    )
    stored, _ = store(dealt, "ranges")
    discard(spark, first)
    sums = stored.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__at"))
    # a file may be read in pieces, so the running sum is taken inside its range by row number
    inside = Window.partitionBy("__range").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, "__range")
        .select(*columns, (F.col("__at") + F.col("__in")).alias(out))
    )


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, root), root the smallest node.

    Star contraction: every node hangs its larger neighbours, then its smaller ones, under
    the smallest it knows, until nothing changes. Only minima are aggregated (combined before
    the shuffle), so a hub with millions of neighbours never forms one group; the minima are
    stored before they are joined, so each join's stage only joins and skew handling can split a
    hub's rows. Every round is stored in the shared folder, which cuts the lineage. Nodes without an edge to another node do not appear.
    """
    spark = edges.sparkSession
    now, path = store(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .filter("v <> u").distinct(), "edges",
    )
    state = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, least = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # larger neighbours go under the smallest known
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v"), F.col("m").alias("u"))
            .filter("v <> u").distinct()
        )
        large, middle = store(large, "star")
        # then each node and its smaller neighbours
        low, lower = store(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        pairs = large.join(low, "v")
        small = (
            pairs.select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(low.select("v", F.col("m").alias("u")))
            .filter("v <> u").distinct()
        )
        following, after = store(small, "edges")
        for done in (path, middle, least, lower):
            discard(spark, done)
        now, path = following, after
        new_state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )


def place(id_col: str, text_col: str) -> list[Column]:
    """(none, at, mark): what tells rows apart and orders them; the id, nulls last, then the text's hash."""
    key = F.col(id_col).cast("long")
    return [
        key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("at"),
        F.xxhash64(text_or_empty(F.col(text_col))).alias("mark"),
    ]


def keep_first(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the first row of each class, once. ``members``: the rows' places and ``class``."""
    order = ["none", "at", "mark"]
    # stored, so that the join's stage only joins and a large class can be split
    ends, _ = store(
        members.groupBy("class").agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
        .filter("lo <> hi").select("class", "lo"),
        "class-ends",
    )
    # only rows that go are looked up
    gone = members.join(ends, "class").filter(F.struct(*order) != F.col("lo")).select(*order).distinct()
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row_")
    marked = docs.select(whole, *place(id_col, text_col))  # wrapped: the table's own names cannot clash
    kept = marked.join(gone, order, "left_anti")
    same, _ = store(marked.groupBy(*order).count().filter("count > 1").select(*order), "same-rows")
    if same.isEmpty():
        return kept.select("row_.*")
    repeated, _ = store(kept.join(same, order, "left_semi"), "repeated")
    first = repeated.groupBy(*order).agg(F.min_by("row_", F.to_json("row_")).alias("row_"))
    return kept.join(same, order, "left_anti").select("row_.*").unionByName(first.select("row_.*"))


__all__ = [
    "LOWER", "UPPER", "WHITE", "WHITE_CLASS", "WORD_CLASS", "components", "discard", "keep_first",
    "materialize", "new_work_path", "place", "running_total", "store", "text_or_empty", "words_of",
]
