"""Nearest vectors by cosine, and vector table upkeep."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pkgatlas.functions.names import name_key
from pkgatlas.operators.build import dedupe_best
from pkgatlas.session import materialize

SCORE_DIGITS = 6
MAX_BROADCAST_QUERIES = 1024
BLOCK_ROWS = 50_000
#: Scores held at once in a task.
STEP_SCORES = 4_000_000
#: Rows whose k best bound those of a step.
FIRST_ROWS = 512
#: Numbers of the vectors that a task holds, when it streams queries.
CHUNK_CELLS = 8_000_000


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


class _RunningTopK:
    """Keeps the k best rows per query while batches pass; ties go to the smaller id.

    Rows rank by ``weight`` times their cosine plus a bonus of their own. Pairs that reach neither
    the threshold nor the k best held go after one comparison; only the rest are rounded and sorted.
    """

    def __init__(self, queries: np.ndarray, k: int, threshold: float, weight: float = 1.0) -> None:
        self.queries = _unit_rows(queries)
        self.k, self.threshold, self.weight = k, threshold, weight
        self.floor = np.full(len(queries), -np.inf)
        self.rows: pa.Table | None = None
        self.rank = np.empty(0)
        self.score = np.empty(0)
        self.query = np.empty(0, dtype=np.int64)
        self.id = np.empty(0, dtype=np.int64)

    def add(self, payload: pa.Table, ids: np.ndarray, vectors: np.ndarray, bonus: np.ndarray | None = None) -> None:
        step = max(1, STEP_SCORES // max(1, len(self.queries)))
        for at in range(0, len(ids), step):
            some = slice(at, at + step)
            self._add(
                payload.slice(at, step), ids[some], vectors[some],
                np.zeros(len(ids[some])) if bonus is None else bonus[some],
            )

    def _add(self, payload: pa.Table, ids: np.ndarray, vectors: np.ndarray, bonus: np.ndarray) -> None:
        query, row = self._candidates(_unit_rows(vectors), bonus)
        scores = np.round(self._raw[query, row], SCORE_DIGITS)
        ranks = np.round(self.weight * scores + bonus[row], SCORE_DIGITS)
        kept = (scores >= self.threshold) & (ranks >= self.floor[query])
        query, row, scores, ranks = query[kept], row[kept], scores[kept], ranks[kept]
        if not len(row):
            return
        held = len(self.id)
        rank = np.concatenate([self.rank, ranks])
        score = np.concatenate([self.score, scores])
        all_query = np.concatenate([self.query, query])
        all_id = np.concatenate([self.id, ids[row]])
        order = np.lexsort((all_id, -rank, all_query))
        by_query = all_query[order]
        place = np.arange(len(order)) - np.searchsorted(by_query, by_query, side="left")
        last = place == self.k - 1
        self.floor[by_query[last]] = rank[order][last]
        keep = order[place < self.k]
        self.rank, self.score, self.query, self.id = rank[keep], score[keep], all_query[keep], all_id[keep]
        # payload of the survivors only
        old, new = keep[keep < held], keep[keep >= held]
        taken = payload.take(pa.array(row[new - held]))
        joined = taken if self.rows is None else pa.concat_tables([self.rows.take(pa.array(old)), taken])
        back = np.empty(len(keep), dtype=np.int64)
        back[np.concatenate([np.flatnonzero(keep < held), np.flatnonzero(keep >= held)])] = np.arange(len(keep))
        self.rows = joined.take(pa.array(back))

    def _candidates(self, units: np.ndarray, bonus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs that can be among the k best; rounding may still take some out."""
        slack = (1 + abs(self.weight)) * 10.0**-SCORE_DIGITS
        raw = self._raw = self.queries @ units.T
        plain = self.weight == 1.0 and not bonus.any()
        rank = raw if plain else self.weight * raw + bonus
        low, n, k = self.floor, len(units), self.k
        first = min(n, max(FIRST_ROWS, 16 * k))
        if first > k and (low == -np.inf).any():
            # k of the first rows that surely count are a bound for all
            sure = (raw[:, :first] >= self.threshold + slack) & (rank[:, :first] > -np.inf)
            held = np.where(sure, rank[:, :first], -np.inf)
            low = np.maximum(low, np.partition(held, first - k, axis=1)[:, first - k] - 2 * slack)
        if plain:
            some = raw >= np.maximum(low, self.threshold)[:, None] - slack
        else:
            some = (raw >= self.threshold - slack) & (rank >= low[:, None] - slack)
        if n > k and np.count_nonzero(some) > 32 * k * len(raw):
            held = np.where(some, rank, -np.inf)
            some &= rank >= np.partition(held, n - k, axis=1)[:, n - k, None] - 2 * slack
        return np.nonzero(some)

    def result(self, query_ids: pa.Array) -> pa.Table | None:
        if self.rows is None:
            return None
        return self.rows.append_column("query_id", query_ids.take(pa.array(self.query))).append_column(
            "score", pa.array(self.score)
        )


def _bonus(table: pa.Table) -> np.ndarray | None:
    return table.column("_bonus").to_numpy() if "_bonus" in table.column_names else None


def _topk_task(query_ids: list, queries: np.ndarray, id_type: pa.DataType, id_col: str,
               vec_col: str, payload: list[str], k: int, threshold: float, weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _RunningTopK(queries, k, threshold, weight)
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                ids = table.column(id_col).to_numpy()
                top.add(table.select(payload), ids, _matrix(batch.column(vec_col)), _bonus(table))
        out = top.result(pa.array(query_ids, type=id_type))
        if out is not None:
            yield from out.combine_chunks().to_batches()

    return run


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    threshold: float = -1.0,
    id_col: str = "id",
    vec_col: str = "embedding",
    payload: Sequence[str] = (),
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
    bonus: Column | None = None,
    weight: float = 1.0,
) -> DataFrame:
    """Exact ``k`` nearest corpus rows per query with cosine at least ``threshold``.

    A query batch of checked size goes to every task, which keeps a running top-k while
    it reads its share of the corpus once: only ``k`` rows per query and task are shuffled,
    never the pairs. For a larger batch the corpus is dealt into chunks, once, and every chunk
    meets all queries in a stream. A ``max_broadcast_queries`` of 0 always streams.
    ``queries`` needs (query_id, embedding); ``id_col`` must be a whole number. Scores are
    compared at six digits, ties go to the smaller id. With ``bonus``, a column of the corpus,
    rows rank by ``weight`` times the cosine plus their bonus; ``order_score`` holds that sum.
    """
    corpus = corpus.filter(F.size(vec_col) > 0)
    extra = []
    if bonus is not None:
        corpus, extra = corpus.withColumn("_bonus", bonus.cast("double")), ["_bonus"]
    columns = list(dict.fromkeys([id_col, *payload, *extra]))
    queries = queries.select("query_id", F.col("embedding").alias("_q")).filter(F.size("_q") > 0)
    schema = T.StructType(
        [corpus.schema[c] for c in columns]
        + [queries.schema["query_id"], T.StructField("score", T.DoubleType())]
    )
    rows = queries.limit(max_broadcast_queries + 1).collect()
    if len(rows) <= max_broadcast_queries:
        if rows:
            matrix = np.array([r["_q"] for r in rows], dtype=np.float64)
        else:
            matrix = np.zeros((0, 1))
        task = _topk_task(
            [r["query_id"] for r in rows],
            matrix,
            to_arrow_type(queries.schema["query_id"].dataType),
            id_col, vec_col, columns, k, threshold, weight,
        )
        if not rows:
            empty = T.StructType([f for f in schema if f.name != "_bonus"])
            if bonus is not None:
                empty = empty.add("order_score", T.DoubleType())
            return corpus.sparkSession.createDataFrame([], empty.add("rank", T.IntegerType()))
        partial = corpus.select(*columns, vec_col).mapInArrow(task, schema)
    else:
        partial = _streamed_topk(
            corpus, queries, columns, schema, k, threshold, vec_col,
            min(max_broadcast_queries, MAX_BROADCAST_QUERIES) or MAX_BROADCAST_QUERIES, block_rows, weight,
        )
    if bonus is not None:
        total = F.round(F.col("score") * weight + F.col("_bonus"), SCORE_DIGITS)
        partial = partial.withColumn("order_score", total).drop("_bonus")
    order = F.col("score" if bonus is None else "order_score").desc()
    w = Window.partitionBy("query_id").orderBy(order, F.col(id_col).asc())
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _stream_task(columns: list[str], query_block: int, k: int, threshold: float, weight: float):
    """Each chunk of the corpus comes first and is held; the queries after it pass by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, chunk = None, [], None
        for batch in batches:
            chunks, kinds = batch.column("_chunk").to_numpy(), batch.column("_kind").to_numpy()
            edges = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1
            cuts = [0, *edges.tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if chunks[start] != number:
                    number, held, chunk = chunks[start], [], None
                if kinds[start] == 0:
                    held.append(part)
                    continue
                if chunk is None:
                    if not held:  # a chunk without rows
                        continue
                    table = pa.Table.from_batches(held)
                    payload = pa.table(dict(zip(columns, table.column("_row").combine_chunks().flatten())))
                    chunk, held = (payload, payload.column(columns[0]).to_numpy(), _matrix(table.column("_v"))), []
                payload, ids, vectors = chunk
                for at in range(0, part.num_rows, query_block):
                    some = part.slice(at, query_block)
                    top = _RunningTopK(_matrix(some.column("_v")), k, threshold, weight)
                    top.add(payload, ids, vectors, _bonus(payload))
                    out = top.result(some.column("query_id"))
                    if out is not None:
                        yield from out.combine_chunks().to_batches()

    return run


def _streamed_topk(corpus, queries, columns, schema, k, threshold, vec_col,
                   query_block: int, chunk_rows: int, weight: float) -> DataFrame:
    """The corpus is dealt into chunks and shuffled once; every chunk meets all queries in a stream.

    Only queries are sent to each chunk, and at most ``k`` rows per query and chunk come out. A
    task holds one chunk, of fewer rows the wider the vectors are.
    """
    n, wide = corpus.agg(F.count("*"), F.max(F.size(vec_col))).first()
    chunks = max(1, math.ceil(n / max(1, min(chunk_rows, CHUNK_CELLS // max(1, wide or 1)))))
    spark = corpus.sparkSession
    chunks = max(chunks, min(spark.sparkContext.defaultParallelism, math.ceil(n / 1000)))
    row = F.struct(*columns)
    # columns[0] is the id
    held = corpus.select(
        F.pmod(F.xxhash64(columns[0]), F.lit(chunks)).cast("int").alias("_chunk"), F.lit(0).alias("_kind"),
        row.alias("_row"), F.transform(vec_col, lambda x: x.cast("double")).alias("_v"),
        F.lit(None).cast(schema["query_id"].dataType).alias("query_id"),
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"), F.lit(1).alias("_kind"),
        F.lit(None).cast(held.schema["_row"].dataType).alias("_row"),
        F.transform("_q", lambda x: x.cast("double")).alias("_v"), "query_id",
    )
    return (
        held.unionByName(asked).repartitionById(chunks, "_chunk").sortWithinPartitions("_chunk", "_kind")
        .mapInArrow(_stream_task(columns, query_block, k, threshold, weight), schema)
    )


def upsert_vectors(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` with the rows of ``new`` added or replaced by ``key``."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def browse_vectors(vectors: DataFrame, limit: int = 0, vec_col: str = "embedding") -> DataFrame:
    """Rows without their vector in id order; 0 means all."""
    rows = vectors.drop(vec_col).orderBy("id")
    return rows.limit(limit) if limit > 0 else rows


def vector_stats(vectors: DataFrame, vec_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    return vectors.agg(
        F.count("*").alias("points"),
        F.min(F.size(vec_col)).cast("long").alias("min_dimension"),
        F.max(F.size(vec_col)).cast("long").alias("max_dimension"),
    ).withColumn("metric", F.lit(metric))


def assign_ids(new: DataFrame, start: int | None = None, name_col: str = "name") -> DataFrame:
    """Point ids. Default: a hash of the name, stable over runs and free of any shuffle.

    With ``start``: dense ids from ``start`` in name order. The sorted rows are stored once
    with their place inside their partition; each partition then starts where the one
    before it ends, so no task sees more than its own rows.
    """
    key = name_key(F.col(name_col))
    if start is None:
        return new.withColumn("id", F.xxhash64(key))
    # the generated value holds the partition number above bit 33 and the row below it
    # the hash spreads rows of one name over tasks
    placed = new.orderBy(key, name_col, F.xxhash64(*new.columns)).withColumn("_m", F.monotonically_increasing_id())
    stored = materialize(
        placed.select(
            *new.columns,
            F.shiftright("_m", 33).alias("_part"),
            F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
        ),
        "dense-ids",
    )
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    # one small row per partition of the stored table
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    return stored.join(offsets, "_part").select(
        *new.columns, (F.col("_at") + F.col("_row") + F.lit(start)).alias("id")
    )


def vector_payload(
    packages: DataFrame, metadata: DataFrame, texts: DataFrame | None = None
) -> DataFrame:
    """Payload stored with a vector, defaults filled in."""
    meta = dedupe_best(
        metadata.withColumn("name_key", name_key(F.col("name"))), ["name_key"], [F.col("name").asc()]
    ).select("name_key", "summary", "version")
    rows = packages.select(
        "name_key", "package_name", "stars", "dependent_count", "growth_pct"
    ).join(meta, "name_key", "left")
    if texts is None:
        rows = rows.withColumn("embedding_text", F.lit(""))
    else:
        rows = rows.join(texts.select("name_key", "embedding_text"), "name_key", "left")
    return rows.select(
        F.col("package_name").alias("name"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("stars", F.lit(0)).alias("stars"),
        F.coalesce("dependent_count", F.lit(0)).alias("dependent_count"),
        F.coalesce("growth_pct", F.lit(0.0)).alias("growth_pct"),
        F.coalesce("version", F.lit("")).alias("version"),
        F.coalesce("embedding_text", F.lit("")).alias("embedding_text"),
    )
