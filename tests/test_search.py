"""Search against brute force on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgatlas.operators import search
from pkgatlas.operators.matching import match_queries
from pkgatlas.operators.vector_search import (
    assign_ids,
    browse_vectors,
    upsert_vectors,
    vector_topk,
)

COLUMNS = "package_name string, name_key string, description string, stars long, dependent_count long, growth_pct double"


@pytest.fixture(scope="module")
def packages(spark):
    rng = random.Random(3)
    parts = ["web", "data", "50%", "a_b", "\\n", "ärger", "fast", "io", "x"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 5))) if i % 50 else None
        rows.append((f"P{i}", f"p{i}", text, i, rng.randint(0, 40), float(i)))
    return spark.createDataFrame(rows, COLUMNS), rows


KEYWORDS = ["web", "WEB data", "50%", "a_b", "\\n", "Ärger", "io", "x", "absent", "b w", "t", " "]


def brute_keywords(rows, limit):
    out = set()
    for q, kw in enumerate(KEYWORDS):
        if not kw.strip():
            continue
        hit = [r for r in rows if r[2] is not None and kw.lower() in r[2].lower()]
        hit.sort(key=lambda r: (-r[4], r[1]))
        out |= {(q, i + 1, r[0]) for i, r in enumerate(hit[:limit])}
    return out


@pytest.mark.parametrize("literals", [128, 0])
def test_keywords_match_brute_force(packages, literals):
    df, rows = packages
    got = search.keyword_search(df, KEYWORDS, 7, max_literals=literals)
    assert {(r["query_id"], r["rank"], r["name"]) for r in got.collect()} == brute_keywords(rows, 7)


def test_keyword_wildcards(packages):
    df, rows = packages
    got = search.keyword_search(df, ["w_b%io"], 300, wildcards=True)
    import re

    want = {r[0] for r in rows if r[2] and re.search("w.b.*io", r[2])}
    assert {r["name"] for r in got.collect()} == want and want


def test_no_keywords(packages):
    assert search.keyword_search(packages[0], [" "], 5).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(400, 16)).astype(np.float32)
    corpus[100:230] = corpus[7]  # a third are copies
    corpus[5] = 0
    queries = rng.normal(size=(9, 16))
    queries[0] = corpus[7]
    c = spark.createDataFrame(
        [(i, v.tolist(), f"n{i}") for i, v in enumerate(corpus)], "id long, embedding array<float>, name string"
    ).repartition(6)
    q = spark.createDataFrame(
        [(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, embedding array<double>"
    )
    return c, q, corpus.astype(float), queries


def brute_topk(corpus, queries, k, threshold):
    out = set()
    for qi, q in enumerate(queries):
        length = np.linalg.norm(corpus, axis=1) * np.linalg.norm(q)
        sims = np.round(np.divide(corpus @ q, length, out=np.zeros(len(corpus)), where=length > 0), 6)
        order = [i for i in np.lexsort((np.arange(len(sims)), -sims)) if sims[i] >= threshold][:k]
        out |= {(f"q{qi}", r + 1, int(i), f"n{i}") for r, i in enumerate(order)}
    return out


@pytest.mark.parametrize("k,threshold", [(5, -1.0), (50, 0.1), (300, 0.0), (3, 0.99)])
@pytest.mark.parametrize("broadcast", [1024, 4])
def test_vector_topk_matches_brute_force(vectors, k, threshold, broadcast):
    c, q, corpus, queries = vectors
    got = vector_topk(
        c, q, k, threshold, payload=["name"], max_broadcast_queries=broadcast, block_rows=90
    )
    rows = {(r["query_id"], r["rank"], r["id"], r["name"]) for r in got.collect()}
    assert rows == brute_topk(corpus, queries, k, threshold)


def test_streamed_queries_pass_in_blocks(vectors, monkeypatch):
    """A bound of 0 on the batch that is sent does not mean one query at a time."""
    from pkgatlas.operators import vector_search

    c, q, corpus, queries = vectors
    task, blocks = vector_search._stream_task, []
    monkeypatch.setattr(vector_search, "_stream_task", lambda columns, block, *rest: blocks.append(block) or task(columns, block, *rest))
    got = vector_topk(c, q, 5, 0.1, payload=["name"], max_broadcast_queries=0)
    assert {(r["query_id"], r["rank"], r["id"], r["name"]) for r in got.collect()} == brute_topk(corpus, queries, 5, 0.1)
    assert blocks == [vector_search.MAX_BROADCAST_QUERIES]


@pytest.mark.parametrize("weight,boosted", [(1.0, False), (0.7, True), (-1.0, True)])
@pytest.mark.parametrize("k,threshold", [(3, -1.0), (40, 0.2), (900, 0.0)])
def test_running_topk_over_rising_rows(k, threshold, weight, boosted, monkeypatch):
    """Rows that come in rising order, with copies, zeros and missing numbers, against a sort of all."""
    import pyarrow as pa
    from pkgatlas.operators import vector_search

    monkeypatch.setattr(vector_search, "STEP_SCORES", 5 * 700)
    rng = np.random.default_rng(8)
    queries, corpus = rng.normal(size=(5, 8)), rng.normal(size=(2500, 8))
    corpus = corpus[np.argsort(corpus @ queries[0])]
    corpus[600:900], corpus[40], corpus[50, 3] = corpus[2400], 0, np.nan
    bonus = rng.random(2500).round(3) if boosted else np.zeros(2500)
    top = vector_search._RunningTopK(queries, k, threshold, weight)
    for at in range(0, 2500, 1000):
        some = slice(at, at + 1000)
        ids = np.arange(2500)[some]
        top.add(pa.table({"id": ids}), ids, corpus[some], bonus[some] if boosted else None)
    got = {}
    for q, r in zip(top.query.tolist(), top.result(pa.array(range(5))).to_pylist()):
        got.setdefault(q, []).append((r["id"], r["score"]))
    for q in range(5):
        length = np.linalg.norm(corpus, axis=1) * np.linalg.norm(queries[q])
        score = np.round(np.divide(corpus @ queries[q], length, out=np.zeros(2500), where=length > 0), 6)
        rank = np.round(weight * score + bonus, 6)
        order = [i for i in np.lexsort((np.arange(2500), -rank)) if score[i] >= threshold and rank[i] == rank[i]][:k]
        assert got.get(q, []) == [(i, score[i]) for i in order]


def test_vector_topk_without_queries(vectors):
    c, q, *_ = vectors
    assert vector_topk(c, q.filter("false"), 3).count() == 0


def test_topk_is_a_prefix(vectors):
    c, q, *_ = vectors
    small = vector_topk(c, q, 4).select("query_id", "rank", "id")
    large = vector_topk(c, q, 40).filter("rank <= 4").select("query_id", "rank", "id")
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0


def test_hybrid_keeps_first_source_and_has_no_duplicates(spark):
    packages = spark.createDataFrame(
        [
            ("Rise", "rise", "a web tool", 5, 600, 90.0), ("near", "near", "web", 5, 300, 0.0),
            ("word", "word", "my web kit", 1, 10, 0.0), ("tiny", "tiny", "web", 1, 1, 0.0),
        ],
        COLUMNS,
    )
    corpus = spark.createDataFrame(
        [(1, [1.0, 0.0], "near", 5, 300, 0.0), (2, [1.0, 0.1], "rise", 5, 600, 90.0), (3, [1.0, 0.0], "word", 1, 10, 0.0)],
        "id long, embedding array<float>, name string, stars long, dependent_count long, growth_pct double",
    )
    queries = spark.createDataFrame(
        [(1, "web", [1.0, 0.0]), (2, "trending", [1.0, 0.0]), (3, "popular web", [0.0, -1.0])],
        "query_id int, query string, embedding array<double>",
    )
    got = search.hybrid_search(packages, corpus, queries, 3).orderBy("query_id", "pos").collect()
    rows = [(r["query_id"], r["name_key"], r["source"]) for r in got]
    assert rows == [
        (1, "rise", "semantic"), (1, "near", "semantic"), (1, "word", "keyword"),
        (2, "rise", "growth"), (2, "near", "semantic"),
        (3, "rise", "growth"),
    ]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    once = upsert_vectors(old, new)
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, upsert_vectors(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_ids(spark):
    df = spark.createDataFrame([(f"N{i % 70}", i) for i in range(200)], "name string, v int").repartition(5)
    dense = assign_ids(df, 10).collect()
    assert sorted(r["id"] for r in dense) == list(range(10, 210))
    assert [r["name"] for r in sorted(dense, key=lambda r: r["id"])] == sorted(
        (r["name"] for r in dense), key=str.lower
    )
    hashed = assign_ids(df.union(df.withColumn("name", F.lower("name"))))
    assert hashed.select("id").distinct().count() == 70
    assert browse_vectors(hashed.withColumn("embedding", F.lit(1)), 3).count() == 3


STOP = {"the", "for"}


def brute_match(new, known):
    def key(q):
        return q.strip().lower().replace(" ", "_")[:80]

    def words(q):
        return {w for w in key(q).replace("_", " ").split() if len(w) > 1 and w not in STOP}

    out = {}
    for qid, q, mode in new:
        exact = [(kid) for kid, k, m in known if m == mode and key(k) == key(q)]
        if exact:
            out[qid] = (min(exact), "exact", None)
            continue
        best = None
        for kid, k, m in known:
            shared = len(words(q) & words(k))
            if m == mode and shared >= 4 and len(words(q)) >= 3:
                cand = (-shared, key(k), kid)
                best = cand if best is None or cand < best else best
        out[qid] = (best[2], "fuzzy", -best[0]) if best else (None, None, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matching_is_exact(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(18)] + ["the", "for", "x"]
    weights = [1 / (i + 1) for i in range(len(vocab))]

    def text():
        return " ".join(rng.choices(vocab, weights, k=rng.randint(1, 14)))

    known = [(i, text(), rng.choice("ab")) for i in range(120)]
    known += [(1000 + i, "w1 w2 w3 w4 w5", "a") for i in range(60)]  # a mass of copies
    new = [(i, text(), rng.choice("ab")) for i in range(120)] + [
        (500, "W1 w2 w3 w4 w5", "a"), (501, "w1 w2 w3", "a"), (502, "w1 w2 w3 w4 other words", "a"),
    ]
    schema = "query_id long, query string, mode string"
    got = match_queries(
        spark.createDataFrame(new, schema), spark.createDataFrame(known, schema), stop_words=sorted(STOP)
    )
    rows = {r["query_id"]: (r["known_id"], r["match"], r["shared_words"]) for r in got.collect()}
    assert rows == brute_match(new, known)


@pytest.mark.parametrize("literals", [128, 0])
def test_many_wildcards_and_repeated_rows(packages, spark, literals):
    """A frame gives the same whatever its size: repeated rows once, patterns without a letter too."""
    import re

    df, rows = packages
    patterns = ["w_b%io", "%", "__", "da%a", "5__ %", "ro_t", "\\n_"]
    asked = [(i, p) for i, p in enumerate(patterns)] * 2
    got = search.keyword_search(
        df, spark.createDataFrame(asked, "query_id int, keyword string"), 500, wildcards=True, max_literals=literals
    )
    want = {
        (i, r[0]) for i, p in enumerate(patterns) for r in rows
        if r[2] is not None and re.search("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in p.lower()), r[2].lower(), re.S)
    }
    found = [(r["query_id"], r["name"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_many_lengths_of_bare_wildcards(packages, spark):
    df, rows = packages
    asked = spark.createDataFrame([(n, "_" * n) for n in range(1, 151)], "query_id int, keyword string")
    got = search.keyword_search(df, asked, 500, wildcards=True)
    want = {(n, r[0]) for n in range(1, 151) for r in rows if r[2] is not None and len(r[2]) >= n}
    assert {(r["query_id"], r["name"]) for r in got.collect()} == want


def test_keyword_without_hits_falls_to_the_old_layer(packages, spark):
    from pkgatlas.operators.lookup import Layers

    df, _ = packages
    old = spark.createDataFrame(
        [("Old", "web and olden things", 3, 4), ("Older", "olden", 1, 9)],
        "name string, description string, stars long, dependents_count long",
    )
    got = search.keyword_search_layers(Layers(fresh=df, projects=old), ["web", "olden"], 5).collect()
    assert {r["name"] for r in got if r["query_id"] == 1} == {"Old", "Older"}
    assert "Old" not in {r["name"] for r in got if r["query_id"] == 0}


def test_qualified_but_far_package_is_found(spark):
    """The 20 nearest are little used; the two that qualify are further away."""
    rows = [(i, [1.0, 0.001 * i], f"p{i}", 1, 1 if i < 30 else 500, 0.0) for i in range(35)]
    corpus = spark.createDataFrame(
        rows, "id long, embedding array<float>, name string, stars long, dependent_count long, growth_pct double"
    )
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<float>")
    got = search.semantic_search(corpus, query, limit=2).orderBy("rank").collect()
    assert [r["name"] for r in got] == ["p30", "p31"]


def test_long_questions_differ_after_80_characters(spark):
    start = "word " * 20
    known = spark.createDataFrame([(1, start + "alpha beta", "explore")], "query_id long, query string, mode string")
    new = spark.createDataFrame([(2, start + "gamma delta", "explore"), (3, start + "Alpha beta", "explore")], known.schema)
    got = {r["query_id"]: r["match"] for r in match_queries(new, known).collect()}
    assert got[2] is None and got[3] == "exact"


def test_a_question_is_not_its_own_match(spark):
    turns = spark.createDataFrame(
        [(1, "alpha beta gamma delta one", "a"), (2, "alpha beta gamma delta two", "a"), (3, "same text here again", "a"),
         (4, "same text here again", "a"), (5, "nothing else shares words", "a")],
        "query_id long, query string, mode string",
    )
    got = {r["query_id"]: tuple(r)[1:] for r in match_queries(turns, turns, exclude_self=True).collect()}
    assert got == {
        1: (2, "fuzzy", 4), 2: (1, "fuzzy", 4), 3: (4, "exact", None), 4: (3, "exact", None), 5: (None, None, None),
    }


def test_every_user_turn_is_asked_of_every_turn(spark, sf_dir):
    from pkgatlas.plans.domain import Domain

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    d = Domain(spark, sf_dir)
    assert d.asked_questions().count() == turns.filter("role = 'user'").count()
    assert d.known_questions().count() == turns.count()


def test_blocks_do_not_change_matches(spark, monkeypatch):
    from pkgatlas.operators import matching

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randint(1, 40))), "a") for i in range(150)]
    df = spark.createDataFrame(rows, "query_id long, query string, mode string")
    want = sorted(map(tuple, match_queries(df, df, exclude_self=True).collect()))
    monkeypatch.setattr(matching, "NEW_BLOCK", 40)
    monkeypatch.setattr(matching, "BLOCK", 9)
    assert sorted(map(tuple, match_queries(df, df, exclude_self=True).collect())) == want
    # cut by words, and all words through lists, then all by the product
    monkeypatch.setattr(matching, "BLOCK_WORDS", 300)
    for share, words in ((0, 1024), (10**6, 1024), (10**6, 3)):
        monkeypatch.setattr(matching, "DENSE_SHARE", share)
        monkeypatch.setattr(matching, "DENSE_WORDS", words)
        assert sorted(map(tuple, match_queries(df, df, exclude_self=True).collect())) == want


@pytest.mark.parametrize("parts", [(1,), (4, 2, 1)])
def test_bounds_do_not_change_matches(spark, monkeypatch, parts):
    """With the longest known texts held first, in several modes, blocks and slices: brute force's matches."""
    from pkgatlas.operators import matching

    rng = random.Random(9)
    vocab = [f"w{j}" for j in range(60)]
    weights = [1 / (j + 1) for j in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 50))), rng.choice("ab")) for i in range(200)]
    rows += [(300 + i, t.upper() if i % 2 else t + " w1", m) for i, (_, t, m) in enumerate(rows[:20])]  # near and exact copies
    for name, v in {
        "LEAST_BLOCK": 2, "LEAD_SHARE": 8, "LEAD_PARTS": parts, "NEW_BLOCK": 70, "BLOCK": 40, "DENSE_SHARE": 10**6, "DENSE_WORDS": 9,
    }.items():
        monkeypatch.setattr(matching, name, v)
    df = spark.createDataFrame(rows, "query_id long, query string, mode string")
    got = {r["query_id"]: tuple(r)[1:] for r in match_queries(df, df, exclude_self=True, stop_words=()).collect()}

    def words(t):
        return set(t.lower().split())

    for i, t, m in rows:
        others = [(k, u) for k, u, mode in rows if mode == m and k != i]
        exact = [k for k, u in others if u.lower() == t.lower()]
        best = min(
            ((-len(words(t) & words(u)), u.lower().replace(" ", "_"), k) for k, u in others),
            key=lambda x: x,
        )
        if exact:
            assert got[i] == (min(exact), "exact", None)
        elif len(words(t)) >= 4 and -best[0] >= 4:
            assert got[i] == (best[2], "fuzzy", -best[0])
        else:
            assert got[i] == (None, None, None)


def test_most_pairs_of_questions_are_never_met(monkeypatch):
    """A bound leaves frequent words out of the lists, so far fewer list entries than pairs are read."""
    from pkgatlas.operators import matching

    rng = np.random.default_rng(3)
    frequent, rare = 40, 20_000
    texts = [
        np.unique(np.r_[rng.choice(frequent, 12, False), frequent + rng.choice(rare, 14, False)]) for _ in range(2000)
    ]
    texts += [np.r_[t[:-4], frequent + rare + np.arange(4) + 4 * i] for i, t in enumerate(texts[:100])]  # edited copies
    counts, words = np.array([len(t) for t in texts]), np.concatenate(texts)
    asked = {"no": np.arange(100), "own": np.arange(100), "counts": counts[:100], "words": np.arange(words.max() + 1),
             "links": words[: counts[:100].sum()]}
    holder = np.repeat(np.arange(len(texts)), counts)[np.argsort(words, kind="stable")].astype(np.int32)
    told = {"no": np.arange(len(texts)), "words": np.arange(words.max() + 1),
            "counts": np.bincount(words, minlength=words.max() + 1), "links": holder}
    read, cells = [], matching._cells
    monkeypatch.setattr(matching, "_cells", lambda *a: read.append(len(c := cells(*a))) or c)
    results = []
    for least in (4, 20):
        q, text, shared = matching._best(asked, told, np.full(100, least), 128, 1024)
        results.append((q.tolist(), text.tolist(), shared.tolist()))
        assert text.tolist() == [2000 + i for i in range(100)] and set(shared.tolist()) == {22}
    assert results[0] == results[1]
    assert read[-1] * 20 < 100 * len(texts) < read[0]
    # in slices and steps of any size
    monkeypatch.setattr(matching, "SLICE", 7)
    monkeypatch.setattr(matching, "HITS", 50)
    again = matching._best(asked, told, np.full(100, 20), 128, 1024)
    assert tuple(x.tolist() for x in again) == results[0]


def test_scores_are_cut_before_payload(monkeypatch):
    """Many rows times many queries in small steps: k rows a query, whatever the step."""
    import pyarrow as pa

    from pkgatlas.operators import vector_search

    rng = np.random.default_rng(0)
    vectors, queries = rng.normal(size=(3000, 8)), rng.normal(size=(50, 8))
    results = []
    for step in (10**7, 5000):
        monkeypatch.setattr(vector_search, "STEP_SCORES", step)
        top = vector_search._RunningTopK(queries, 4, -1.0)
        top.add(pa.table({"name": [str(i) for i in range(3000)]}), np.arange(3000), vectors)
        assert top.rows.num_rows == 200
        results.append(sorted(zip(top.query.tolist(), top.id.tolist(), top.rows.column("name").to_pylist())))
    assert results[0] == results[1] and all(str(i) == n for _, i, n in results[0])
