import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pkgatlas.llm import hard_negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rid int, score string"


def brute(data, k_pos=5, k_neg=5):
    """Rows of the contract, by every score."""
    kept = []
    for r in data:
        if r[1] is None or r[2] is None or any(x is None or not math.isfinite(x) for x in r[1]):
            continue
        kept.append((r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]], r[2]))
    key = lambda s, c: (-s, c[0] is None, c[0] or 0)
    out = []
    for i, a in enumerate(kept):
        if a[0] is None or a[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a[1], c[1])), c) for j, c in enumerate(kept) if j != i]
        scored.sort(key=lambda t: key(*t))
        for ps, p in [t for t in scored if t[1][2] == a[2]][:k_pos]:
            some = [(s, c) for s, c in scored if c[2] != a[2] and 80 * ps <= 100 * s <= 100 * ps][:k_neg]
            out += [(a[0], p[0], r, c[0], ps, s) for r, (s, c) in enumerate(some, 1)]
    return sorted(out, key=str)


def run(spark, data, **more):
    got = hard_negatives.hard_negatives(spark.createDataFrame(data, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0, **more)
    return sorted(map(tuple, got.collect()), key=str)


def clustered(rnd, n, dims, spread):
    centres = rnd.standard_normal((12, dims))
    at = rnd.integers(0, 12, n)
    x = centres[at] + spread * rnd.standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True), at


@pytest.mark.parametrize("spread,step,chunk", [(0.05, 5, 32_768), (0.05, 5, 256), (1.0, 20, 256)])
def test_equals_brute_force(spark, spread, step, chunk):
    rnd = np.random.default_rng(3)
    x, at = clustered(rnd, 900, 16, spread)
    x[50:80] = x[50]  # ties
    labels = (at + rnd.integers(0, 2, 900)) % 5
    data = [(int(i) * step, v.tolist(), int(c), 1, "s") for i, (v, c) in enumerate(zip(x, labels))]
    assert run(spark, data, tree_anchors=16, chunk_rows=chunk) == brute(data)


def test_bounds_exclude_candidates(monkeypatch):
    """On clustered anchors most candidates are never scored, with the same result."""
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    x, at = clustered(rnd, 4000, 24, 0.02)
    x, labels = np.floor(256 * x), at % 4
    anchors = np.arange(0, 4000, 40)
    order, up, edge, last, inner = hard_negatives.spanning_tree(x[anchors])
    seen = []
    real = hard_negatives._Chunk

    class Counted(real):
        def __init__(self, *a):
            super().__init__(*a)
            seen.append(self)

    monkeypatch.setattr(hard_negatives, "_Chunk", Counted)
    names = ["chunk", "kind", "block", "ord", "parent", "edge", "last", "inner", "rid", "vec", "label", "v", "windows"]
    scores = x[anchors] @ x.T
    picks = []
    for k, a in enumerate(anchors):
        same = [j for j in np.lexsort((np.arange(4000), -scores[k])) if labels[j] == labels[a] and j != a][:5]
        picks.append([int(scores[k, j]) for j in same])

    def batch(rows):
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    whole = [(0, 0, 0, 0, -1, 0.0, False, False, j, j, int(labels[j]), x[j].astype(int).tolist(), None) for j in range(4000)]
    asked = [
        (0, 1, 0, n, int(u), float(e), bool(f), bool(p), int(anchors[i]), int(anchors[i]), int(labels[anchors[i]]), x[anchors[i]].astype(int).tolist(), picks[i])
        for n, (i, u, e, f, p) in enumerate(zip(order, up, edge, last, inner))
    ]
    for mine in (False, True):
        seen.clear()
        task = hard_negatives._score_task(24, 5, 5, 80, 100, mine)
        got = defaultdict(list)
        for b in task(iter([batch(whole), batch(asked)])):
            for a, r, s in zip(*(b.column(c).to_pylist() for c in ("anchor", "rid", "score"))):
                got[a].append((-s, r))
        for k, a in enumerate(anchors):
            if not mine:
                want = sorted((-int(scores[k, j]), int(j)) for j in range(4000) if labels[j] == labels[a] and j != a)[:5]
                assert sorted(got[a]) == want
            else:
                for ps in picks[k]:
                    want = sorted((-int(scores[k, j]), j) for j in range(4000) if labels[j] != labels[a] and 80 * ps <= 100 * scores[k, j] <= 100 * ps)[:5]
                    assert [t for t in sorted(got[a]) if 80 * ps <= -100 * t[0] <= 100 * ps][:5] == want
        (chunk,) = seen
        assert chunk.scored < 0.5 * 4000 * len(anchors) and not chunk.bounds


def test_hard_rows(spark):
    """Nulls, non-finite and very large components, unlike lengths, repeated ids and rows, negative scores."""
    rnd = random.Random(5)
    data = [(i * 10, [rnd.uniform(-1, 1) for _ in range(4)], i % 3, None, None) for i in range(60)]
    data += [
        (100, [1.0, 0.5, 0.5, 0.5], 0, 1, "a"), (100, [1.0, 0.5, 0.5, 0.5], 0, 1, "a"), (100, [0.9, 0.5, 0.5, 0.5], 1, 1, "a"),
        (None, [1.0, 0.5, 0.5, 0.5], 1, 1, "a"), (None, [1.0, 0.4, 0.5, 0.5], 0, 1, "a"), (700, None, 0, 1, "a"), (800, [1.0, 1.0, 1.0, 1.0], None, 1, "a"),
        (900, [1.0, None, 1.0, 1.0], 0, 1, "a"), (1000, [1.0, float("nan"), 1.0, 1.0], 0, 1, "a"), (1100, [float("inf"), 0.0, 1.0, 1.0], 0, 1, "a"),
        (1200, [], 0, 1, "a"), (1300, [0.0, 0.0, 0.0, 0.0], 0, 1, "a"), (1400, [1.0, 1.0], 0, 1, "a"), (1500, [-1.0] * 4, 7, 1, "a"),
    ]
    assert run(spark, data) == brute(data)
    large = [(i * 50, [rnd.uniform(-1, 1) * 2**20 for _ in range(4)], i % 3, 1, "a") for i in range(40)]
    assert run(spark, large) == brute(large)  # beyond what doubles hold exactly
    with_huge = [*large, (1, [1e30, 0.0, 0.0, 0.0], 0, 1, "a")]
    assert run(spark, with_huge) == brute(large)
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 0, 1, "a")]) == []
