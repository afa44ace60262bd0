"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced partitions, and a small classifier
learns them. It files every vector into its most probable partition and sends each query to
its several most probable ones, where all vectors are compared exactly. How many is measured
on part of the sample that the classifier has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgatlas.llm.common import store

#: Vectors that the index is fitted on, those with the smallest hashes of their ids.
SAMPLE = 4096
PARTITIONS = 16
GRAPH_NEIGHBOURS = 10
HIDDEN = 64
TARGET_RECALL = 0.97
TILE_ROWS = 4096
QUERY_ROWS = 512


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest rows of each row of unit vectors, by blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else out[at : at + 1024]
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12) -> np.ndarray:
    """A partition number per row: few graph edges cut, no part above (1 + slack) times its share.

    Starts from spherical centres filled up to the limit, then moves rows to the part that holds
    most of their neighbours while there is room.
    """
    n = len(x)
    limit = int(np.ceil(n / parts * (1 + slack)))
    rnd = np.random.default_rng(0)
    centres = x[rnd.choice(n, parts, replace=False)]
    for _ in range(10):
        near = (x @ centres.T).argmax(axis=1)
        centres = unit(np.stack([
            x[near == p].sum(axis=0) if (near == p).any() else x[rnd.integers(n)] for p in range(parts)
        ]) + 1e-12)
    wish = np.argsort(-(x @ centres.T), axis=1)
    out, load = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-(x @ centres.T).max(axis=1)):
        for p in wish[i]:
            if load[p] < limit:
                out[i], load[p] = p, load[p] + 1
                break
    back = [[] for _ in range(n)]
    for i, near in enumerate(graph):
        for j in near:
            back[j].append(i)
    both = [np.concatenate([graph[i], np.array(back[i], np.int64)]) for i in range(n)]
    for _ in range(rounds):
        moved = 0
        for i in rnd.permutation(n):
            votes = np.bincount(out[both[i]], minlength=parts)
            votes[(load >= limit) & (np.arange(parts) != out[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[out[i]]:
                load[out[i]] -= 1
                load[best] += 1
                out[i], moved = best, moved + 1
        if not moved:
            break
    return out


@dataclass
class Router:
    """A classifier with one hidden layer; ``probes`` partitions are searched per query."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def train_router(x: np.ndarray, labels: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = 40) -> Router:
    """Softmax regression over one hidden layer, by Adam; the same input gives the same weights."""
    rnd = np.random.default_rng(0)
    scale = np.sqrt(2 / x.shape[1])
    weights = [
        rnd.normal(0, scale * 4, (x.shape[1], hidden)), np.zeros(hidden),
        rnd.normal(0, np.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rnd.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            hid = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            out = hid @ weights[2] + weights[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            out[np.arange(len(rows)), labels[rows]] -= 1
            out /= len(rows)
            down = (out @ weights[2].T) * (hid > 0)
            grads = [x[rows].T @ down, down.sum(axis=0), hid.T @ out, out.sum(axis=0)]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second):
                g = g + 1e-4 * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(*weights, probes=parts)


def fit_router(sample: np.ndarray, parts: int, k: int, target_recall: float) -> Router:
    """Graph, partitions and classifier from sample vectors; probes from its unseen fifth."""
    x = unit(sample)
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        d = sample.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    held = max(1, len(x) // 5)
    seen = x[held:]
    labels = balanced_partitions(seen, neighbour_graph(seen, GRAPH_NEIGHBOURS), parts)
    router = train_router(seen, labels, parts)
    filed = router.order(seen)[:, 0]
    near = np.argsort(-(x[:held] @ seen.T), axis=1)[:, :k]
    order = router.order(x[:held])
    place = np.argsort(order, axis=1)  # of each partition in the query's order
    needed = np.take_along_axis(place, filed[near], axis=1)
    reached = [(needed < p).mean() for p in range(1, parts + 1)]
    router.probes = 1 + next((i for i, r in enumerate(reached) if r >= target_recall), parts - 1)
    return router


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _route_task(router: Router, dim: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                order = router.order(unit(_matrix(some.column("v"), dim)))[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("v"),
                     pa.ListArray.from_arrays(
                         np.arange(0, order.size + 1, order.shape[1], dtype=np.int32), order.ravel())],
                    ["id", "v", "parts"],
                )

    return run


def _tile(_key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
    vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
    yield pa.RecordBatch.from_arrays([
        pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([table.column("block")[0].as_py()], pa.int32()),
        pa.array([table.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
        pa.array([vectors.tobytes()], pa.binary()),
    ], ["part", "block", "ids", "vectors"])


def nearest_in_tile(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple:
    """(query row, vector row, score) of each query's ``k`` nearest rows of the tile.

    A matrix product picks them with a margin for its rounding; their scores are then taken
    pair by pair in one fixed order of summation, so equal vectors tie exactly.
    """
    if not len(v):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    q_len, v_len = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    rough = (q / q_len[:, None]) @ (v / v_len[:, None]).T
    rough[q_ids[:, None] == v_ids[None, :]] = -np.inf
    kth = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(q), -3.0)
    row, col = np.nonzero((rough >= kth[:, None] - 1e-9) & (rough > -3))
    score = (q[row] * v[col]).sum(axis=1) / (q_len[row] * v_len[col])
    order = np.lexsort((v_ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k], score[rank < k]


def _search_task(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q, v_ids, v = (
                    np.frombuffer(batch.column(c)[r].as_py(), t)
                    for c, t in (("q_ids", "<i8"), ("q", "<f8"), ("ids", "<i8"), ("vectors", "<f8"))
                )
                row, col, score = nearest_in_tile(q.reshape(-1, dim), q_ids, v.reshape(-1, dim), v_ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[row]), pa.array(v_ids[col]), pa.array(score)], ["query_id", "vec_id", "score"]
                )

    return run


def _tiles(rows: DataFrame, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(part, block, ids, vectors) of at most about ``tile_rows`` rows each, and blocks per part."""
    sizes, _ = store(
        rows.groupBy("part").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("blocks")), "ann-sizes"
    )
    # a row per partition of the index, a fixed number
    tiles = (
        rows.join(F.broadcast(sizes), "part")
        .select("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
        .groupBy("part", "block").applyInArrow(_tile, "part int, block int, ids binary, vectors binary")
    )
    return store(tiles, "ann-tiles")[0], sizes


def _search(queries: DataFrame, tiles: DataFrame, sizes: DataFrame, k: int, dim: int) -> DataFrame:
    """All ``queries`` (id, v, part) against every tile of their parts: the k best per query."""
    asked, _ = _tiles(queries, QUERY_ROWS)
    spread = asked.select("part", F.col("ids").alias("q_ids"), F.col("vectors").alias("q")).join(
        F.broadcast(sizes), "part"
    ).select("part", "q_ids", "q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # the tile's number is part of the key, so a full partition spreads over tasks
    found = spread.join(tiles, ["part", "block"]).select("q_ids", "q", "ids", "vectors").mapInArrow(
        _search_task(k, dim), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def usable(v: Column, dim: int) -> Column:
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & plain & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    partitions: int = PARTITIONS,
    sample: int = SAMPLE,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries``.

    Score is the cosine of the original vectors in double precision, ties go to the smaller id.
    A row with the query's own id is no candidate. The index is fitted on the ``sample`` vectors
    with the smallest hashes of their ids; every vector is filed. A query for which the searched
    partitions hold fewer than ``k`` others is compared with all vectors. ``partitions`` and
    the tiles bound what a task holds; a partition of any size is many tiles.

    A vector that is null, all zero, of another length than most, or holds a null or a value
    that is not finite takes no part, as candidate or query; null ids neither. Rows with the
    same id are candidates each, and one query with an id is asked once (its smallest vector).
    Further columns are ignored. Empty tables give an empty table.
    """
    spark = vectors.sparkSession
    schema = T.StructType([
        T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()),
        T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()),
    ])
    v = F.col(vec_col).cast("array<double>")
    length = (
        vectors.filter(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count()
        .orderBy(F.desc("count"), F.desc("d")).first()
    )
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length["d"]

    def ready(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
            F.col("id").isNotNull() & usable(F.col("v"), dim)
        )

    rows = ready(vectors)
    # at most `sample` rows
    picked = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()
    if not picked:
        return spark.createDataFrame([], schema)
    router = fit_router(np.array([r["v"] for r in picked], np.float64), partitions, k, target_recall)
    routed = "id long, v array<double>, parts array<int>"
    tiles, sizes = _tiles(
        rows.mapInArrow(_route_task(router, dim, 1), routed).select("id", "v", F.get("parts", F.lit(0)).alias("part")),
        TILE_ROWS,
    )
    asked = ready(queries).groupBy("id").agg(F.min("v").alias("v"))
    near, _ = store(
        _search(
            asked.mapInArrow(_route_task(router, dim, router.probes), routed)
            .select("id", "v", F.explode("parts").alias("part")),
            tiles, sizes, k, dim,
        ),
        "ann-found",
    )
    full = near.groupBy("query_id").count().filter(F.col("count") >= k)
    short, _ = store(asked.join(full, asked["id"] == full["query_id"], "left_anti"), "ann-short")
    if not short.isEmpty():
        everywhere = short.select("id", "v", F.explode(F.lit(list(range(partitions)))).alias("part"))
        near = near.join(full, "query_id", "left_semi").unionByName(_search(everywhere, tiles, sizes, k, dim))
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
