from collections import defaultdict

import pytest
from helpers import WORD, frame, rows
from pkgatlas.llm import mixing


def brute_targets(sizes, cap=3):
    """Shares of the total by weight, over and over until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in held)
        open_ = sum(weight[s] for s in order if s not in held)
        out = {s: cap * sizes[s] if s in held else left * weight[s] / open_ for s in order}
        above = {s for s in order if s not in held and out[s] > cap * sizes[s]}
        if not above:
            return out
        held |= above
        if len(held) == len(order):
            return {s: float(cap * sizes[s]) for s in order}


def corpus(n=1500):
    """A source that holds most rows, small ones, one without any word, and very unequal texts."""
    data = []
    for i in range(n):
        source = "big" if i % 3 else (None, "s1", "s2", "tiny", "void")[i // 3 % 5]
        words = 0 if source == "void" else 5 + (i * 7919) % 90 + (3000 if i % 400 == 1 else 0)
        if source == "tiny":
            words = 2
        data.append((i, " ".join(["word"] * words), "en", source, 1, 1, 1, "x"))
    return data


def test_targets_and_taken(spark):
    data = corpus()
    got = mixing.mix(frame(spark, data), group_rows=200).collect()
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(WORD.findall(r[1]))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["size"] == len(WORD.findall(data[r["id"]][1])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(data) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.005 * t, 8), (s, taken[s], t)
    again = mixing.mix(frame(spark, data[::-1]), group_rows=200).collect()
    assert sorted((r["id"], r["copies"]) for r in got) == sorted((r["id"], r["copies"]) for r in again)


def test_rates_are_tilted(spark):
    """One source below its target, one above: copies rise with size in the one, fall in the other."""
    data = [(i, " ".join(["w"] * (10 + 10 * (i % 10))), "en", "ab"[i % 2 == 0], 1, 1, 1, "") for i in range(800)]
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    sums = defaultdict(lambda: [0, 0])
    for r in mixing.mix(frame(spark, data), weights).collect():
        cell = sums[r["source"], r["size"] > 50]
        cell[0] += r["copies"]
        cell[1] += 1
    rate = {k: a / b for k, (a, b) in sums.items()}
    assert rate["a", True] > rate["a", False] and rate["b", True] < rate["b", False]


def test_hard_rows_and_pipeline_form(docs, no_docs):
    copies = mixing.mix(docs)
    out = mixing.mixed_documents(docs, copies)
    assert out.columns == docs.columns
    want = {(r["id"], r["mark"], r["source"]): r["copies"] * r["n"] for r in copies.collect()}
    assert out.count() == sum(want.values()) and sum(r["n"] for r in copies.collect()) == len(rows())
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs, mixing.mix(no_docs)).count() == 0
