import random

import numpy as np
import pytest
import xxhash
from helpers import WORD, frame, lower, rows
from pkgatlas.llm import common, simhash


def brute_print(text):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_equals_brute_force(docs):
    data = rows()
    prints = [brute_print(r[1]) for r in data]
    groups = brute_components(prints)
    least = {}
    for r, g in zip(data, groups):
        least[g] = min((x for x in (least.get(g), r[0]) if x is not None), default=None)
    want = sorted([(r[0], f"{p:016x}", least[g]) for r, p, g in zip(data, prints, groups)], key=str)
    got = sorted([tuple(r) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == want


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("parts,tile_rows", [(1, 64), (2, 16), (4, 2000)])
def test_every_link_at_any_tiling(spark, parts, tile_rows):
    rnd = random.Random(5)
    prints = {0, (1 << 64) - 1, 1, 7, 15}
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):  # chains of near neighbours
            prints.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    links = simhash.near_links(
        spark.createDataFrame([(s,) for s in signed], "fp long"), tile_rows=tile_rows, parts=parts
    )
    got = {r["node"]: r["root"] for r in common.components(links).collect()}
    groups = {}
    for s, g in zip(signed, brute_components(prints)):
        groups.setdefault(g, []).append(s)
    want = {s: min(g) for g in groups.values() if len(g) > 1 for s in g}
    assert got == want


def test_dense_group_leaves_a_forest(spark):
    base = 0x0123456789ABCDEF
    near = [(base ^ (1 << a) ^ (1 << b),) for a in range(40) for b in range(a)]
    links = simhash.near_links(spark.createDataFrame(near, "fp long").repartition(1), parts=1)
    assert links.count() < 4 * len(near)
    assert common.components(links).select("root").distinct().count() == 1


def test_one_of_each_group_stays(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    want = {r["component_id"] for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect()}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1500)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1500)) and 5 not in got


def test_shared_and_null_ids_lose_no_text(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    data = [(i, t, "en", "a", 1, 1, 1, "x") for i, t in [(1, one), (1, two), (2, two), (None, one), (None, "c d e"), (None, "c d e")]]
    got = simhash.drop_near_duplicates(frame(spark, data)).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=str) == sorted([(1, one), (1, two), (None, "c d e")], key=str)
