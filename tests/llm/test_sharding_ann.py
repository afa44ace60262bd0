import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import frame, rows
from pkgatlas.llm import ann, sharding
from pkgatlas.session import new_work_path
from pyspark.sql import functions as F


def check_shards(data, got, shards=16):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data), key=str
    )
    places = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    return load


def test_hard_rows(docs, no_docs):
    check_shards(rows(), sharding.shard_documents(docs).collect())
    assert sharding.shard_documents(no_docs).count() == 0
    assert "Python" not in sharding.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()


def test_even_bytes_and_stored_versions(spark):
    data = [(i, "x" * (20 + (i * 7919) % 900), None, None, 1, 1, 1, "") for i in range(3000)]
    path = new_work_path(spark, "test-map")
    load = check_shards(data, sharding.shard_documents(frame(spark, data), map_path=path).collect())
    mean = sum(load.values()) / 16
    assert len(load) == 16 and max(load.values()) < 1.01 * mean and min(load.values()) > 0.99 * mean
    maps = spark.read.parquet(path)
    assert maps.groupBy("version").count().orderBy("version").collect() == [(0, 4096), (1, 4096)]
    old, new = ({r["slot"]: r["shard"] for r in maps.filter(F.col("version") == v).collect()} for v in (0, 1))
    assert 0 < sum(old[s] != new[s] for s in old) < 400  # an edit, not a new deal


def test_hot_id_is_spread(spark):
    data = [(7, "the same text", None, None, 1, 1, 1, "")] * 2000 + [(i, "y" * 50, None, None, 1, 1, 1, "") for i in range(4000)]
    load = check_shards(data, sharding.shard_documents(frame(spark, data)).collect())
    mean = sum(load.values()) / 16
    assert max(load.values()) < 1.05 * mean


def test_rebalance_moves_only_what_helps(spark):
    current = sharding.first_map(spark, 4, 8)
    even = sharding.rebalance(current, spark.createDataFrame([(s, 10) for s in range(8)], "slot int, bytes long"), 4)
    assert even.filter("version = 1").count() == 8 and not current.drop("version").exceptAll(even.drop("version")).count()
    skewed = spark.createDataFrame([(0, 60), (4, 30), (1, 10), (5, 5)], "slot int, bytes long")
    got = {r["slot"]: r["shard"] for r in sharding.rebalance(current, skewed, 4).collect()}
    assert (got[0] == 0) != (got[4] == 0)  # one of the two large ones moved


def brute(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    out = {}
    for qid, q in queries:
        q = np.asarray(q, np.float64)
        s = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt(q @ q))
        keep = ids != qid
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[qid] = [(int(ids[keep][i]), float(s[keep][i])) for i in order]
    return out


def clustered(n, dim=16, seed=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(40, dim)) * 2
    return [(i, [float(np.float32(c)) for c in centres[i % 40] + rnd.normal(size=dim)]) for i in range(n)]


def table(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)


def test_recall_and_scores(spark):
    data = clustered(6000)
    queries = [x for x in data if x[0] % 50 == 0]
    got = defaultdict(list)
    for r in ann.nearest(table(spark, data), table(spark, queries), 5, sample=2000).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute(data, queries, 5)
    hits = 0
    for q, near in want.items():
        assert [x[0] for x in sorted(got[q])] == [1, 2, 3, 4, 5]
        hits += len({i for i, _ in near} & {x[1] for x in got[q]})
        exact = dict(brute(data, [next(x for x in queries if x[0] == q)], len(data))[q])
        assert all(x[2] == pytest.approx(exact[x[1]], abs=1e-12) for x in got[q])
    assert hits / (5 * len(want)) >= 0.9


def test_clustered_data_needs_few_partitions():
    x = np.array([v for _, v in clustered(2500)])
    router = ann.fit_router(x, 16, 5, 0.97)
    assert router.probes < 10
    parts = ann.balanced_partitions(ann.unit(x), ann.neighbour_graph(ann.unit(x), 10), 16)
    assert np.bincount(parts, minlength=16).max() <= np.ceil(2500 / 16 * 1.1)


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, float(i % 3), 0.5]) for i in range(12)]  # ties of equal vectors
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]),
           (105, [1.0, 2.0]), (106, []), (None, [1.0, 1.0, 1.0])]
    data = table(spark, good + bad + [good[0]])
    got = defaultdict(list)
    for r in ann.nearest(data, data, 5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    want = brute([*good, good[0]], good, 5)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = table(spark, good[:3])
    assert ann.nearest(few, few, 5).count() == 6  # all candidates, if fewer
    none = table(spark, [])
    assert ann.nearest(none, none).count() == 0 and ann.nearest(table(spark, bad[:2]), none).count() == 0


def test_few_found_are_searched_everywhere(spark, monkeypatch):
    """Partitions so small that the searched one lacks k others."""
    data = clustered(200)
    fit = ann.fit_router

    def one_probe(*args):
        router = fit(*args)
        router.probes = 1
        return router

    monkeypatch.setattr(ann, "fit_router", one_probe)
    got = ann.nearest(table(spark, data), table(spark, data[:20]), 30)
    assert got.groupBy("query_id").count().filter("count = 30").count() == 20
