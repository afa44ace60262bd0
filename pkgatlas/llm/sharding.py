"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of slots; a small map says which shard holds each slot.
Rebalancing edits the map and stores it as its next version; records never hash anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pkgatlas.llm.common import new_work_path, store, text_or_empty

SLOTS = 4096
SHARDS = 16
MAX_MOVES = 512
#: A slot above this share of one shard's fair bytes is spread over the other slots.
HOT_SHARE = 0.25
TOLERANCE = 0.001


def slot_of(*keys: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: (version, slot, shard), slots dealt round."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"),
        F.pmod(F.col("id"), F.lit(shards)).cast("int").alias("shard"),
    )


def latest(maps: DataFrame) -> DataFrame:
    """The map of the largest version."""
    newest = maps.agg(F.max("version")).scalar()
    return maps.filter(F.col("version") == newest)


def rebalance(
    current: DataFrame, slot_bytes: DataFrame, shards: int = SHARDS, max_moves: int = MAX_MOVES,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The next version of ``current``: slots moved until the shards' bytes are near equal.

    ``slot_bytes`` is (slot, bytes). One slot moves at a time, from the fullest shard to the
    emptiest: the one whose bytes are nearest to half of their gap and below the gap, so every
    move evens the two out. It ends when no slot helps, the gap is within ``tolerance`` of a
    shard's mean, or after ``max_moves``; few slots move, all others stay. The map has a fixed
    number of rows, so the edit is one row's fold over its arrays.
    """
    state = current.join(slot_bytes, "slot", "left").agg(
        F.array_sort(F.collect_list(F.struct("slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("b")))).alias("m"),
        F.max("version").alias("version"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda k: F.aggregate(
            "m", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == k, x["b"]).otherwise(F.lit(0))
        ),
    )
    start = state.select(
        "version", F.transform("m", lambda x: x["slot"]).alias("slots"), F.transform("m", lambda x: x["b"]).alias("b"),
        F.struct(F.transform("m", lambda x: x["shard"]).alias("shard"), loads.alias("load"), F.lit(True).alias("on")).alias("s"),
    )

    def move(s: Column, _: Column) -> Column:
        top, low = F.array_max(s["load"]), F.array_min(s["load"])
        giver, taker = F.array_position(s["load"], top) - 1, F.array_position(s["load"], low) - 1
        gap = top - low
        far = F.struct(F.lit(1 << 62).cast("long").alias("miss"), F.lit(-1).alias("at"))
        # the slot of the giver that leaves the two most alike
        best = F.aggregate(
            F.zip_with(s["shard"], "b", lambda k, b: F.when((k == giver) & (b > 0) & (b < gap), F.abs(gap - 2 * b))),
            F.struct(F.lit(0).alias("i"), far.alias("best")),
            lambda a, miss: F.struct(
                (a["i"] + 1).alias("i"),
                F.when(miss < a["best"]["miss"], F.struct(miss.alias("miss"), a["i"].alias("at")))
                .otherwise(a["best"]).alias("best"),
            ),
            lambda a: a["best"]["at"],
        )
        mean = F.aggregate(s["load"], F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(float(shards))
        useful = s["on"] & (gap > mean * tolerance)

        def moved(at: Column) -> Column:
            amount = F.get("b", at)
            return F.when(
                at >= 0,
                F.struct(
                    F.transform(s["shard"], lambda k, i: F.when(i == at, taker.cast("int")).otherwise(k)).alias("shard"),
                    F.transform(
                        s["load"],
                        lambda x, i: x - F.when(i == giver, amount).otherwise(0) + F.when(i == taker, amount).otherwise(0),
                    ).alias("load"),
                    F.lit(True).alias("on"),
                ),
            ).otherwise(F.struct(s["shard"].alias("shard"), s["load"].alias("load"), F.lit(False).alias("on")))

        # one pass over the slots per move: the found place is bound once
        return F.when(useful, F.get(F.transform(F.array(best), moved), F.lit(0))).otherwise(s)

    edited = start.select(
        "version", "slots", F.aggregate(F.sequence(F.lit(1), F.lit(max_moves)), F.col("s"), move, lambda s: s["shard"]).alias("shard")
    )
    return edited.select(
        (F.col("version") + 1).alias("version"), F.explode(F.arrays_zip("slots", "shard")).alias("x")
    ).select("version", F.col("x")["slots"].alias("slot"), F.col("x")["shard"].alias("shard"))


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty. Law ``bytes``: shards
    hold near equal bytes. Rows hash by id into ``slots`` virtual slots; the map at ``map_path``
    (a new folder by default) gets version 0, slots dealt round, and version 1, edited with the
    bytes per slot. A slot that holds more than a quarter of a shard's fair bytes, as a hot id
    makes it, has its rows dealt over all slots by id and place in the input instead. ``slot``
    numbers the rows of a shard without gaps: counts per virtual slot give where each begins.
    grown_shard is null, as only law ``key`` has it.

    Null ids hash alike; repeated rows are placed each. Further columns are ignored; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    text = text_or_empty(F.col(text_col))
    rows, _ = store(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"), slot_of(id_col, slots=slots).alias("home"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "shard-rows",
    )
    by_home = rows.groupBy("home").agg(F.sum("size").alias("bytes"))
    total = by_home.agg(F.sum("bytes"))
    # each hot slot has more than such a share of all bytes, so there are few
    hot = by_home.filter(F.col("bytes") > total.scalar() * (HOT_SHARE / shards)).agg(
        F.coalesce(F.collect_set("home"), F.array().cast("array<int>"))
    ).scalar()
    dealt, _ = store(
        rows.select(
            "id", "size", "crc", "place",
            F.when(F.array_contains(hot, F.col("home")), slot_of("id", "place", slots=slots))
            .otherwise(F.col("home")).alias("vslot"),
        ),
        "shard-dealt",
    )
    weights, _ = store(
        dealt.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "slot-bytes"
    )
    map_path = map_path or new_work_path(spark, "slot-map")
    first_map(spark, shards, slots).coalesce(1).write.parquet(map_path)
    stored = spark.read.schema("version int, slot int, shard int").parquet(map_path)
    rebalance(latest(stored), weights.select(F.col("vslot").alias("slot"), "bytes"), shards).write.mode(
        "append"
    ).parquet(map_path)
    current = latest(spark.read.schema("version int, slot int, shard int").parquet(map_path))
    # a row per slot: where it begins in its shard
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    begins, _ = store(
        current.join(weights, current["slot"] == weights["vslot"]).select(
            "vslot", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
        ),
        "slot-begins",
    )
    inside = Window.partitionBy("vslot").orderBy(F.col("id").asc_nulls_first(), "place")
    # at most a row per slot, a fixed number
    return (
        dealt.withColumn("n", F.row_number().over(inside))
        .join(F.broadcast(begins), "vslot")
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
            "shard", (F.col("begin") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"),
        )
    )
