import random

import corpus_pipeline
from helpers import WORD, frame, lower, rows
from pkgatlas.llm import near_copies


def brute_sets(data, n=5):
    out = []
    for r in data:
        w = WORD.findall(lower(r[1] or ""))
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute_kept(data):
    """Places (id, text) of the first row of each group that all pairs of 0.8 and more connect."""
    sets, root = brute_sets(data), list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(data):
        groups.setdefault(find(i), []).append(r)
    return groups.values()


def edited(words, rnd, places):
    words = list(words)
    for at in places:
        words[at] = f"edit{rnd.randrange(10**9)}"
    return " ".join(words)


def test_edited_copies_leave_one(spark):
    """Copies just above 0.8 go, copies just below it stay."""
    rnd = random.Random(3)
    data, want = [], set()
    for g in range(40):
        words = [f"g{g}w{rnd.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        texts = [" ".join(words), edited(words, rnd, (20, 60, 100, 150)), edited(words, rnd, (10, 50, 90, 120, 160))]
        # 4 edits leave 180 of 220 (0.82), 5 leave 175 of 225 (0.78)
        for k, text in enumerate(texts):
            data.append((g * 10 + k, text, "en", "a", len(text), 1, 1, "x"))
        want |= {g * 10, g * 10 + 2}
    got = corpus_pipeline.near_duplicate_stage(spark, frame(spark, data), "")
    assert {r["doc_id"] for r in got.collect()} == want and got.columns == frame(spark, data).columns


def test_equals_brute_force_on_hard_rows(spark):
    data = rows()
    got = near_copies.drop_near_copies(frame(spark, data)).collect()
    groups = list(brute_kept(data))
    assert len(got) == len(groups)
    kept = [(r["doc_id"], r["text"]) for r in got]
    for group in groups:
        ids = [r[0] for r in group if r[0] is not None]
        least = min(ids, default=None)
        assert sum((r[0], r[1]) in kept for r in {(r[0], r[1]) for r in group}) == 1
        assert any(r[0] == least and (r[0], r[1]) in kept for r in group)


def test_chain_in_one_band_is_followed(spark):
    """A group whose first and last are unlike is still joined through its middle."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(304)]
    data = []
    for k in range(12):
        data.append((k, " ".join(words), "en", "a", 1, 1, 1, "x"))
        words[20 + 22 * k] = f"edit{rnd.randrange(10**9)}"
        words[22 + 22 * k] = f"edit{rnd.randrange(10**9)}"
        words[28 + 22 * k] = f"edit{rnd.randrange(10**9)}"
    got = near_copies.drop_near_copies(frame(spark, data)).collect()
    assert [r["doc_id"] for r in got] == [min(r[0] for r in g) for g in brute_kept(data)]


def test_ids_that_are_shared_or_null(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    data = [(i, t, "en", "a", 1, 1, 1, "x") for i, t in [(1, one), (1, two), (2, two), (None, one), (None, "c d e"), (None, "c d e")]]
    got = near_copies.drop_near_copies(frame(spark, data)).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=str) == sorted([(1, one), (1, two), (None, "c d e")], key=str)


def test_empty_table(no_docs):
    assert near_copies.drop_near_copies(no_docs).count() == 0


def test_shared_counts_equal_set_intersections():
    import numpy as np

    rnd = np.random.default_rng(1)
    for top in (50, 20_000):
        sets = [np.unique(rnd.integers(0, top, rnd.integers(0, 3000))) for _ in range(30)]
        sides = [(np.array([len(x) for x in some]), np.concatenate(some)) for some in (sets[:12], sets[12:])]
        got = near_copies.shared_counts(*sides)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]


def test_large_bands_meet_in_tiles(spark, monkeypatch):
    """Many groups that meet in one band, cut into several tiles: the links of brute force."""
    monkeypatch.setattr(near_copies, "SMALL_BAND", 2)
    monkeypatch.setattr(near_copies, "TILE_SETS", 5)
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(150)]
    data = []
    for g in range(25):
        own = [f"g{g}w{i}" for i in range(60)]
        for k in range(3):
            words = passage + own
            words = edited(words, rnd, rnd.sample(range(150, 210), 2 * k)).split()
            data.append((g * 10 + k, " ".join(words), "en", "a", 1, 1, 1, "x"))
    got = near_copies.drop_near_copies(frame(spark, data)).collect()
    groups = list(brute_kept(data))
    assert sorted(r["doc_id"] for r in got) == sorted(min(r[0] for r in g) for g in groups)
    assert 1 < len(groups) < 40


def test_names_that_the_operator_uses(spark):
    from pyspark.sql import functions as F

    names = ["__none", "__at", "__mark", "none", "at", "mark", "row_", "class", "node", "key"]
    docs = frame(spark, [(i, f"{'one two three four five six' if i < 3 else i}", "en", "a", 1, 1, 1, "x") for i in range(5)])
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names if n != "key"])
    got = near_copies.drop_near_copies(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 3, 4]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names if n != "key")


def test_recall_on_the_table(spark, sf_dir):
    """Every link of 0.8 and more that brute force finds among the table's shorter texts."""
    from collections import Counter

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars < 20000")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = list(brute_kept_fast(data))
    got = near_copies.drop_near_copies(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(min(r[0] for r in g) for g in groups)
    assert max(Counter(map(len, groups))) > 1


def brute_kept_fast(data):
    """As brute_kept; pairs must share one of the rarest shingles of the smaller set."""
    from collections import Counter, defaultdict

    sets, root = brute_sets(data), list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = Counter(s for x in sets for s in x)
    held = defaultdict(list)
    for i, a in enumerate(sets):
        rare = sorted(a, key=lambda s: (n[s], s))[: len(a) - (4 * len(a) + 4) // 5 + 1] or [()]
        for j in {j for s in rare for j in held[s]}:
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
        for s in rare:
            held[s].append(i)
    groups = defaultdict(list)
    for i, r in enumerate(data):
        groups[find(i)].append(r)
    return groups.values()


def test_stage_tests_what_simhash_links(spark, monkeypatch):
    """The stage's pairs begin with SimHash's; what only fingerprints bring together is tested exactly."""
    asked, links = [], near_copies.near_links
    monkeypatch.setattr(near_copies, "near_links", lambda prints, radius: asked.append(radius) or links(prints, radius))
    words = [f"w{i}" for i in range(300)]
    data = [(1, " ".join(words), "en", "a", 1, 1, 1, "x"), (2, " ".join([*words[:-1], "other"]), "en", "a", 1, 1, 1, "x"), (3, "", "en", "a", 1, 1, 1, "x")]
    got = corpus_pipeline.near_duplicate_stage(spark, frame(spark, data), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3] and asked == [near_copies.RADIUS]


def test_fingerprint_pairs(spark):
    """Equal and near fingerprints are paired, far ones and empty sets are not."""
    nodes = spark.createDataFrame([(1, 5, 0b0), (2, 5, 0b111), (3, 5, 0b111), (4, 5, 0xFFFF), (5, 0, 0b1)], "node long, n long, fp long")
    assert {(r["a"], r["b"]) for r in near_copies.fingerprint_pairs(nodes).collect()} == {(1, 2), (2, 3)}
