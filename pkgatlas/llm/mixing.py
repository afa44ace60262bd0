"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each source its target tokens, the ones nearest to "every
document once" in relative entropy are r_i = exp(lambda_source * x_i), x_i the document's
tokens over its source's mean; a rate is held at ``max_copies``. The multipliers solve the
convex dual, source by source, by Newton steps over distributed sums. Rates are then rounded
to whole copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgatlas.llm.common import discard, running_total, store, text_or_empty, words_of

MAX_COPIES = 3
RANK_WEIGHTS = (5.0, 2.0, 1.0)
GROUP_ROWS = 2_000
TOLERANCE = 1e-9
MAX_STEPS = 100


def token_counts(docs: DataFrame, text_col: str = "text") -> Column:
    """Words between the contracts' white space; none for a null text."""
    return F.size(words_of(text_or_empty(F.col(text_col)))).cast("long")


def source_order_weights(sizes: DataFrame, weights: tuple[float, ...] = RANK_WEIGHTS) -> DataFrame:
    """``sizes`` (source, ...) with ``weight`` dealt round in code point order, null last."""
    ranked = running_total(
        sizes.withColumn("__null", F.col("source").isNull().cast("int")).withColumn("__one", F.lit(1)),
        ["__null", "source"], "__one", "__rank",
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.select(
        *sizes.columns, F.get(cycle, F.pmod(F.col("__rank"), F.lit(len(weights))).cast("int")).alias("weight")
    )


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size, weight) with ``target``.

    Targets share the sum of all sizes by weight. One that is above ``max_copies`` times its
    source's size stops there and the excess is shared by the others' weights, again until
    none is above. Every round is one sum; the driver holds two numbers.
    """
    cap = F.col("source_size") * float(max_copies)
    frame = sizes.withColumn("held", F.lit(False))
    total = frame.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        row = frame.agg(
            F.sum(F.when(F.col("held"), cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(~F.col("held"), F.col("weight"))).alias("open"),
            F.count_if("held").alias("n"),
        ).first()
        if not row["open"]:
            break
        level = (total - row["fixed"]) / row["open"]
        # the level only rises, so what is held stays held
        frame = sizes.withColumn("held", F.col("weight") * level > cap)
        if frame.filter("held").count() == row["n"]:
            break
    return frame.withColumn("target", F.when(F.col("held"), cap).otherwise(F.col("weight") * level)).drop("held")


def _rate(tilt: Column, x: Column, max_copies: int) -> Column:
    return F.least(F.lit(float(max_copies)), F.exp(F.least(tilt * x, F.lit(50.0))))


def solve_tilts(sized: DataFrame, wanted: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, tilt, scale): the multipliers that give each source its target.

    ``sized`` has (source, size, n rows), ``wanted`` (source, source_size, target, n_docs). The sums run
    over distinct (source, size) counts. A step that leaves the bracket is halved instead.
    """
    spark = sized.sparkSession
    counts = sized.filter("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
    smallest = counts.groupBy("source").agg(F.min("size").alias("smallest"))
    counts, counts_path = store(counts, "mix-sizes")
    open_ = wanted.join(smallest, wanted["source"].eqNullSafe(smallest["source"])).select(
        wanted["source"], "target", "source_size",
        (F.col("source_size") / F.col("n_docs")).alias("scale"), "smallest",
    )
    up = F.col("target") > F.col("source_size")
    full = F.col("target") >= F.col("source_size") * (max_copies * (1 - 1e-12))
    # here even the smallest document is taken as often as allowed
    top = F.log(F.lit(float(max_copies))) * F.col("scale") / F.col("smallest") * 1.000001
    state = open_.select(
        "source", "target", "scale", F.when(full, top).otherwise(0.0).alias("tilt"),
        F.when(up, F.lit(0.0)).otherwise(F.lit(-1e6)).alias("low"),
        F.when(up, top).otherwise(0.0).alias("high"),
        full.alias("done"),
    )
    state, path = store(state, "mix-state")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("tilt"), x, max_copies)
        sums = (
            counts.join(state, counts["source"].eqNullSafe(state["source"]))
            .groupBy(state["source"], "target", "scale", "tilt", "low", "high", "done")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                # capped documents do not move
                F.sum(F.when(rate < max_copies, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"),
            )
        )
        off = F.col("got") - F.col("target")
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(off, F.col("slope"))
        inside = (newton > low) & (newton < high)
        done = F.col("done") | (F.abs(off) <= TOLERANCE * F.col("target"))
        following, new_path = store(
            sums.select(
                "source", "target", "scale",
                F.when(done, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
                low.alias("low"), high.alias("high"), (done | (high - low < 1e-12)).alias("done"),
            ),
            "mix-state",
        )
        discard(spark, path)
        state, path = following, new_path
        if state.filter("not done").isEmpty():
            break
    discard(spark, counts_path)
    return state.select("source", "tilt", "scale")


def _round(_key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole copies from rates: largest rows first, each takes up what rounding left over."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    words = (table.column("size").to_numpy() * table.column("n").to_numpy()).astype(np.float64)
    rate, most = table.column("rate").to_numpy(), table.column("most").to_numpy()
    ids = table.column("id").to_pylist()
    marks = table.column("mark").to_numpy().tolist()
    order = sorted(range(len(ids)), key=lambda i: (-words[i], ids[i] is None, ids[i] or 0, marks[i]))
    copies = np.zeros(len(ids), np.int64)
    owed = 0.0
    for i in order:
        if words[i] > 0:
            owed += rate[i] * words[i]
            copies[i] = min(most[i], max(0, round(owed / words[i])))
            owed -= copies[i] * words[i]
        else:
            copies[i] = 1
    yield from table.append_column("copies", pa.array(copies)).to_batches()


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_copies: int = MAX_COPIES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Copies per document: id, mark, source, size, n, source_size, target, copies.

    Size is the number of words. ``weights`` (source, weight; one row a source, all positive)
    defaults to 5, 2, 1 dealt round in source order, null last. See ``targets`` for the targets
    and the module for the rates. Copies are rounded inside groups of about ``group_rows`` rows
    of one source, dealt by a hash of id and text, so a source that holds most rows is many
    groups; each group misses its tokens by about its smallest document, and the same rows give
    the same copies in every run.

    ``mark`` is the XXH64 of the text. The ``n`` rows that are alike in id, text and source are
    one row here and take the same number of copies each. A null text or one without words has
    size 0 and one copy. Ids are whole numbers or null; null sources are one source. Further
    columns are ignored. An empty table gives an empty table.
    """
    rows, _ = store(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
            F.xxhash64(text_or_empty(F.col(text_col))).alias("mark"),
            token_counts(docs, text_col).alias("size"),
        ).groupBy("id", "source", "mark", "size").agg(F.count("*").alias("n")),
        "mix-rows",
    )
    sizes, _ = store(
        rows.groupBy("source").agg(
            F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")
        ),
        "mix-sources",
    )
    if weights is None:
        weighed = source_order_weights(sizes)
    else:
        weighed = sizes.join(weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight")),
                             F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    wanted, _ = store(targets(store(weighed, "mix-weights")[0], max_copies), "mix-targets")
    tilts = solve_tilts(
        rows.select("source", "size", "n"), wanted, max_copies
    ).withColumnRenamed("source", "_s")
    # a row per source; its stored size decides how it is joined
    plan, _ = store(
        wanted.join(tilts, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            F.col("source").alias("_s"), "source_size", "target", "n_docs",
            F.coalesce("tilt", F.lit(0.0)).alias("tilt"), F.coalesce("scale", F.lit(1.0)).alias("scale"),
        ),
        "mix-plan",
    )
    rated = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(
        "id", "source", "mark", "size", "n", "source_size", "target",
        _rate(F.col("tilt"), F.col("size") / F.col("scale"), max_copies).alias("rate"),
        F.lit(max_copies).alias("most"),
        F.pmod(F.xxhash64("id", "mark"), F.ceil(F.col("n_docs") / F.lit(group_rows))).alias("bucket"),
    )
    schema = T.StructType([*rated.schema, T.StructField("copies", T.LongType())])
    done = rated.groupBy("source", "bucket").applyInArrow(_round, schema)
    return store(
        done.select("id", "mark", "source", "size", "n", "source_size", "target", "copies"), "mix-copies"
    )[0]


def mixed_documents(
    docs: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` with every row as often as ``mix`` says."""
    held = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("r"), F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(text_or_empty(F.col(text_col))).alias("_mark"), F.col(source_col).alias("_source"),
    )
    match = (
        held["_id"].eqNullSafe(copies["id"]) & (held["_mark"] == copies["mark"])
        & held["_source"].eqNullSafe(copies["source"])
    )
    return (
        held.join(copies.filter("copies > 0"), match)
        .select("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("r.*")
    )
