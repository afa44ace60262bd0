"""Hard-negative mining: bounds along a spanning tree of anchors decide which scores are computed.

For an anchor a with parent p in the tree and a candidate c, <a, c> lies within
<p, c> plus or minus |a - p| |c|. Only candidates whose interval can reach the wanted window
of scores are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgatlas.llm.common import store

POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 80, 100
#: Anchors in one tree.
TREE_ANCHORS = 512
#: Candidates that one task holds at a time, fewer for wide vectors.
CHUNK_ROWS = 32_768
CHUNK_CELLS = 4_000_000
#: Chunks that a small table is still cut into, so that all cores work.
LEAST_CHUNKS = 24
_SLACK = 1e-9


def integer_vectors(
    vectors: DataFrame, id_col: str, label_col: str, vec_col: str, anchor: Column, scale: int
) -> DataFrame:
    """(rid, vec, label, v, anchor): rows that take part, components as floor(scale * x)."""
    x = F.col(vec_col)
    usable = F.col(label_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(2.0**31 / scale))
    )
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int"))
    square = F.aggregate("v", F.lit(0.0), lambda t, e: t + e.cast("double") * e.cast("double"))
    return (
        vectors.filter(usable)
        .select(
            F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("long").alias("label"),
            whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        )
        .filter(square < F.lit(2.0**62))
        .withColumn("rid", F.monotonically_increasing_id())
    )


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """One row per list, short ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """A minimum spanning tree over the rows, walked from row 0: (rows in order, place of each
    one's parent in it, edge lengths, whether it is its parent's last child, whether it is a parent).

    Smaller subtrees come first and a parent is let go at its last child, so a walk holds at
    most about log2(rows) parents at once.
    """
    n = len(x)
    squares = (x * x).sum(axis=1)
    near, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    done, picked, at = np.zeros(n, bool), [], 0
    for _ in range(n):
        done[at] = True
        picked.append(at)
        d = np.maximum(squares + squares[at] - 2 * (x @ x[at]), 0)
        closer = ~done & (d < near)
        near[closer], parent[closer] = d[closer], at
        if len(picked) < n:
            at = int(np.where(done, np.inf, near).argmin())
    children: list[list[int]] = [[] for _ in range(n)]
    weight = np.ones(n, np.int64)
    for i in reversed(picked[1:]):
        weight[parent[i]] += weight[i]
        children[parent[i]].append(i)
    order, up, last = [], [], []
    stack = [(0, -1, False)]
    while stack:
        i, above, final = stack.pop()
        order.append(i)
        up.append(above)
        last.append(final)
        here = len(order) - 1
        for k, c in enumerate(sorted(children[i], key=lambda c: -weight[c])):
            stack.append((c, here, k == 0))  # the heaviest is taken off last
    order, up = np.array(order), np.array(up)
    # the distance itself, not the root of a difference of squares
    edge = np.sqrt(((x[order] - x[order[np.maximum(up, 0)]]) ** 2).sum(axis=1))
    return order, up, edge, np.array(last), weight[order] > 1


_TREE = "block long, ord long, parent int, edge double, last boolean, inner boolean, rid long, vec long, label long, v array<int>"


def _tree_task(dims: int, size: int):
    def grow(rows: pa.Table, block: int) -> pa.RecordBatch:
        x = _matrix(rows.column("v").combine_chunks(), dims)
        order, up, edge, last, inner = spanning_tree(x)
        some = rows.take(pa.array(order)).combine_chunks()
        n = len(order)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, block)), pa.array(np.arange(n)), pa.array(up.astype(np.int32)), pa.array(edge), pa.array(last), pa.array(inner),
            *[some.column(c).combine_chunks() for c in ("rid", "vec", "label", "v")],
        ], ["block", "ord", "parent", "edge", "last", "inner", "rid", "vec", "label", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= size:
                yield grow(held.slice(0, size), block)
                held, block = held.slice(size), block + 1
        if held is not None and held.num_rows:
            yield grow(held, block)

    return run


def _direction_key(dims: int, bits: int = 24):
    """Signs against fixed random directions: alike vectors get alike keys."""
    directions = np.random.default_rng(5).standard_normal((dims, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _matrix(batch.column("v"), dims) @ directions > 0
            key = signs @ (1 << np.arange(bits)[::-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(key.astype(np.int64))], [*batch.schema.names, "key"]
            )

    return run


def anchor_trees(rows: DataFrame, dims: int, tree_anchors: int = TREE_ANCHORS) -> DataFrame:
    """Anchors in the walking order of their trees; alike anchors share one where they can."""
    anchors = rows.filter("anchor").select("rid", "vec", "label", "v").mapInArrow(
        _direction_key(dims), "rid long, vec long, label long, v array<int>, key long"
    )
    keyed, _ = store(anchors, "anchor-keys")
    parts = max(1, -(-keyed.count() // (8 * tree_anchors)))
    trees, _ = store(
        keyed.repartitionByRange(parts, "key", "rid").sortWithinPartitions("key", "rid")
        .mapInArrow(_tree_task(dims, tree_anchors), _TREE),
        "anchor-trees",
    )
    return trees


class _Chunk:
    """Candidates of one chunk, in the order of ties."""

    def __init__(self, rows: pa.Table, dims: int) -> None:
        self.x = _matrix(rows.column("v").combine_chunks(), dims)
        self.rid, self.label = (rows.column(c).to_numpy() for c in ("rid", "label"))
        self.vec = rows.column("vec").combine_chunks()
        self.norm = np.sqrt((self.x * self.x).sum(axis=1)) * (1 + _SLACK)
        self.most = np.abs(self.x).max(initial=0)
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def exact(self, some: np.ndarray | None, a: np.ndarray) -> np.ndarray:
        x = self.x if some is None else self.x[some]
        self.scored += len(x)
        if self.most * np.abs(a).max(initial=0) * x.shape[1] < 2**53:
            return x @ a
        return x.astype(np.int64) @ a.astype(np.int64)

    def interval(self, parent: int, edge: float, size: float) -> tuple[np.ndarray, np.ndarray] | None:
        if parent < 0 or self.most * size * self.x.shape[1] >= 2**53:
            return None
        low, high = self.bounds[parent]
        reach, limit = self.norm * (edge * (1 + _SLACK)) + _SLACK, self.norm * size
        return np.maximum(low - reach, -limit), np.minimum(high + reach, limit)


def _least_of_best(values: np.ndarray, k: int) -> float:
    """The k-th largest, or nothing to go by when there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest; equal ones in their order."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= _least_of_best(scores, k))
        return some[np.argsort(-scores[some], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")


def _score_task(dims: int, positives: int, negatives: int, low: int, high: int, mine: bool):
    """One pass over chunks, each with all anchors after it: positives, or negatives for ``windows``."""

    def wanted(chunk: _Chunk, label: int, rid: int, windows: list[int], bounds) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the right label, and whether each can reach a window."""
        fits = np.flatnonzero(chunk.label != label if mine else (chunk.label == label) & (chunk.rid != rid))
        if bounds is None or not len(fits):
            return fits, np.ones(len(fits), bool)
        below, above = (b[fits] for b in bounds)
        if not mine:
            return fits, above >= _least_of_best(below, positives)
        reach = np.zeros(len(fits), bool)
        for score in windows:
            floor, top = low * score / 100, high * score / 100
            sure = below[(below >= floor) & (above <= top)]
            reach |= (above >= max(floor, _least_of_best(sure, negatives))) & (below <= top)
        return fits, reach

    def anchor_rows(chunk: _Chunk, row: dict, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        windows = sorted({s for s in row["windows"] or [] if low * s <= high * s}) if mine else []
        bounds = chunk.interval(row["parent"], row["edge"], float(np.sqrt((a * a).sum())))
        fits, reach = wanted(chunk, row["label"], row["rid"], windows, bounds)
        some = fits[reach]
        if bounds is None or 2 * len(some) > len(chunk.rid):
            scores = chunk.exact(None, a)
            bounds, got = (scores.astype(np.float64),) * 2, scores[some]
        else:
            got = chunk.exact(some, a)
            for b in bounds:
                b[some] = got
        if row["inner"]:
            chunk.bounds[row["ord"]] = bounds
        if not mine:
            best = _first(got, positives)
        else:
            chosen = []
            for score in windows:
                exact = got.astype(object) if got.dtype != np.float64 and np.abs(got).max(initial=0) > 2**55 else got
                inside = np.flatnonzero((100 * exact >= low * score) & (100 * exact <= high * score))
                chosen.append(inside[_first(got[inside], negatives)])
            best = np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)
        if row["last"]:
            del chunk.bounds[row["parent"]]
        return some[best], got[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, chunk, block = None, [], None, None
        for batch in batches:
            heads = batch.drop_columns(["v"])
            chunks, kinds = (batch.column(c).to_numpy() for c in ("chunk", "kind"))
            at = 0
            while at < batch.num_rows:
                changes = np.flatnonzero((chunks[at:] != chunks[at]) | (kinds[at:] != kinds[at]))
                end = at + int(changes[0]) if len(changes) else batch.num_rows
                part = batch.slice(at, end - at)
                if chunks[at] != number:
                    number, held, chunk, block = chunks[at], [], None, None
                if kinds[at] == 0:
                    held.append(part)
                elif held or chunk is not None:
                    if chunk is None:
                        chunk, held = _Chunk(pa.Table.from_batches(held), dims), []
                    vectors = _matrix(part.column("v"), dims)
                    anchors, found = [], []
                    for a, row in zip(vectors, heads.slice(at, end - at).to_pylist()):
                        if row["block"] != block:
                            block = row["block"]
                            chunk.bounds.clear()
                        found.append(anchor_rows(chunk, row, a))
                        anchors.append(row["rid"])
                    rows = np.concatenate([f[0] for f in found]).astype(np.int64)
                    scores = np.concatenate([f[1].astype(np.int64) for f in found])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(np.array(anchors, np.int64), [len(f[0]) for f in found])),
                        pa.array(chunk.rid[rows]), chunk.vec.take(pa.array(rows)), pa.array(scores),
                    ], ["anchor", "rid", "vec", "score"])
                at = end

    return run


def _pass(rows: DataFrame, anchors: DataFrame, chunks: int, task) -> DataFrame:
    """(anchor, rid, vec, score) of each chunk of candidates against all anchors."""
    columns = ["chunk", "kind", "block", "ord", "parent", "edge", "last", "inner", "rid", "vec", "label", "v", "windows"]
    candidates = rows.withColumns({
        "chunk": F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int"), "kind": F.lit(0), "block": F.lit(0).cast("long"),
        "ord": F.lit(0).cast("long"), "parent": F.lit(-1), "edge": F.lit(0.0), "last": F.lit(False), "inner": F.lit(False),
        "windows": F.lit(None).cast("array<bigint>"),
    })
    sent = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("kind", F.lit(1))
    return (
        candidates.select(*columns).unionByName(sent.select(*columns))
        .repartition(chunks, "chunk")
        .sortWithinPartitions("chunk", "kind", "block", "ord", F.col("vec").asc_nulls_last(), "rid")
        .mapInArrow(task, "anchor long, rid long, vec long, score long")
    )


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = 256,
    tree_anchors: int = TREE_ANCHORS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on ``vectors``. Scores are inner products of floor(``scale`` * x).
    Positives are an anchor's ``positives`` best other rows of its label; negatives the best
    ``negatives`` rows of other labels with a score from ``low`` to ``high`` hundredths of the
    positive's. Higher scores come first, ties by smaller id, null ids last.

    Candidates are dealt into chunks and shuffled once a pass; anchors go to every chunk, tree
    by tree. At most ``positives`` rows (then ``negatives`` a positive) leave a chunk for an
    anchor. There is no sample and no index: every candidate is scored or excluded by its bound,
    which is a bound in the integers' exact scores. Where anchors lie far apart the bounds
    exclude little and the work is that of scoring all.

    Rows with a null label or vector, or null or non-finite components, take no part, nor do those
    whose integers' sum of squares reaches 2 ** 62. Vectors of unlike lengths are filled up with
    zeros. Rows that share an id, or repeat, each take part on their own. A null id is never an
    anchor unless the condition says so. Further columns are ignored; an empty table, or one
    without anchors, gives an empty table.
    """
    rows, _ = store(integer_vectors(vectors, id_col, label_col, vec_col, anchor, scale), "integer-vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(1, dims or 0)
    room = max(256, min(chunk_rows, CHUNK_CELLS // dims))
    chunks = max(1, -(-n // room), min(LEAST_CHUNKS, n // 256))
    candidates = rows.select("rid", "vec", "label", "v")
    trees = anchor_trees(rows, dims, tree_anchors)
    none = F.lit(None).cast("array<bigint>")
    found = _pass(candidates, trees.withColumn("windows", none), chunks, _score_task(dims, positives, negatives, low, high, False))
    order = [F.col("score").desc(), F.col("vec").asc_nulls_last(), F.col("rid")]
    best, _ = store(
        found.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
        .filter(F.col("r") <= positives).drop("r"),
        "positives",
    )
    # at most ``positives`` scores an anchor; a score that repeats is one window
    windows = best.groupBy("anchor").agg(F.collect_set("score").alias("windows"))
    asked = trees.join(windows, trees["rid"] == windows["anchor"], "left").drop("anchor")
    others, _ = store(
        _pass(candidates, asked, chunks, _score_task(dims, positives, negatives, low, high, True)), "negatives"
    )
    wide = "decimal(20,0)"
    p, q = best.alias("p"), others.alias("q")
    ps, qs = F.col("p.score").cast(wide), F.col("q.score").cast(wide)
    ranked = (
        p.join(q, F.col("p.anchor") == F.col("q.anchor"))
        .filter((ps * low <= qs * 100) & (qs * 100 <= ps * high))
        .select(
            F.col("p.anchor").alias("anchor"), F.col("p.vec").alias("positive_id"), F.col("p.rid").alias("prid"),
            F.col("p.score").alias("positive_score"), F.col("q.vec").alias("vec"), F.col("q.rid").alias("rid"), F.col("q.score").alias("score"),
        )
        .withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "prid").orderBy(*order)))
        .filter(F.col("rank") <= negatives)
    )
    names = trees.select(F.col("rid").alias("anchor"), F.col("vec").alias("anchor_id"))
    return ranked.join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
