import random

import pytest
from helpers import frame, lower, rows
from pkgatlas.llm import decontaminate
from pkgatlas.llm.queries import op11_decontamination
from pyspark.sql import functions as F

ITEMS = "item_id long, text string"


def words(text):
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lower(text or "")).split(" ")


def brute(text, items, window):
    """Hit positions and named items of one text, trying every window at every place."""
    w = [x for x in words(text) if x]
    hit, found = set(), set()
    for name, t in items:
        v = [x for x in words(t) if x]
        k = min(len(v), window)
        for s in range(len(v) - k + 1 if v else 0):
            for at in range(len(w) - k + 1):
                if w[at : at + k] == v[s : s + k]:
                    hit |= set(range(at, at + k))
                    found.add(name)
    return len(w), hit, sorted(str(f) for f in found if f is not None)


def places(spans):
    out = [p for s in spans for p in range(s["start"], s["end"])]
    assert out == sorted(set(out))
    return set(out)


@pytest.mark.parametrize("window,automaton_words", [(4, 500_000), (1, 500_000), (10, 500_000), (4, 60)])
def test_equals_brute_force(spark, window, automaton_words):
    rnd = random.Random(window)
    alphabet = ["A", "b", "Çé", "7"]
    text = lambda n: " ".join(rnd.choice(alphabet) + rnd.choice(["", "", ",", "\x00", "\n"]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 2, 3, 5, 9, 14, 40]))) for i in range(25)]
    items += [(None, text(6)), (3, text(8)), (26, None), (27, ""), (28, items[5][1]), (28, items[5][1])]
    data = [(i, text(rnd.randint(0, 60)), None, None, None, 1, 1, "") for i in range(120)]
    data += [(None, text(30), *[None] * 6), (7, None, *[None] * 6), (7, "", *[None] * 6), (9, data[9][1], *[None] * 6)]
    got = decontaminate.benchmark_overlap(
        frame(spark, data), spark.createDataFrame(items, ITEMS), window=window, automaton_words=automaton_words,
        piece_words=20,
    ).collect()
    want = []
    for r in data:
        n, hit, names = brute(r[1], items, window)
        want.append(str((r[0], n, sorted(hit), names)))
    assert sorted(str((r["doc_id"], r["n_words"], sorted(places(r["spans"])), r["items"])) for r in got) == sorted(want)
    assert all(r["n_hit"] == len(places(r["spans"])) for r in got)


def test_runs_in_repetitive_items():
    """Classes of runs are split and shared: periodic items, one a part of another."""
    rnd = random.Random(2)
    for _ in range(60):
        items = [(str(i), [rnd.choice([b"x", b"y"]) for _ in range(rnd.randint(1, 30))]) for i in range(6)]
        items.append(("6", items[0][1][2:] + items[0][1][2:]))
        automaton = decontaminate.Automaton(items, 5)
        automaton = decontaminate.Automaton.from_bytes(automaton.to_bytes())
        doc = [rnd.choice([b"x", b"y", b"y"]) for _ in range(80)]
        spans, found = automaton.hits(doc)
        n, hit, names = brute(b" ".join(doc).decode(), [(a, b" ".join(w).decode()) for a, w in items], 5)
        assert {p for s, e in spans for p in range(s, e)} == hit
        assert sorted(automaton.names[i] for i in found) == names


def test_spans_are_cut_and_covered_rows_go(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve"
    clean = " ".join(f"c{i}" for i in range(30))
    data = [
        (1, f"{clean}.\n{leak.upper()}! Then {clean}", "en", "a", 1, 1, 1, "x"), (2, f"so {leak}.", "en", "a", 1, 1, 1, "x"),
        (3, clean, None, None, None, None, None, None), (4, None, "en", "a", 0, None, None, None), (None, "", "en", "a", 0, 1, 1, "y"),
        (1, f"{clean}.\n{leak.upper()}! Then {clean}", "en", "a", 1, 1, 1, "x"),
    ]
    docs = frame(spark, data).withColumn("spans", F.lit(5))
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(0, leak)], ITEMS))
    assert got.columns == docs.columns
    want = [(1, f"{clean}.\n! Then {clean}")] * 2 + [(3, clean), (4, None), (None, "")]
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted(want, key=str)


def test_hard_rows_and_empty_tables(spark, docs, no_docs):
    items = [(1, rows()[5][1]), (2, "a very long text has line 3"), (3, "unique1 unique2 unique3 unique4 unique5 unique6 unique7 unique8 unique9 unique10 unique11")]
    table = spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.benchmark_overlap(docs, table).collect()}
    long = {r[0]: r for r in rows()}[42][1]
    want = set()
    for r in rows():
        if r[1] == long:
            n = len(long.split())
            # each such line holds the item's seven words; line 3 comes every 700 lines
            lines = [x for x in long.split("\n") if " line 3 " in x]
            want.add((42, n, 7 * len(lines), ("2",)))
        else:
            n, hit, names = brute(r[1], items, 10)
            want.add((r[0], n, len(hit), tuple(names)))
    assert got == want
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.benchmark_overlap(no_docs, table).count() == 0
    assert {r["n_hit"] for r in decontaminate.benchmark_overlap(docs, none).collect()} == {0}
    assert decontaminate.decontaminate(docs, none).count() == len(rows()) and decontaminate.decontaminate(no_docs, none).count() == 0


def test_query_on_the_table(spark, sf_dir):
    """The query's digest against brute force over the documents that hold a window."""
    import hashlib

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op11_decontamination(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    windows = {}
    for name, t in items:
        v = [x for x in words(t) if x]
        for s in range(len(v) - min(10, len(v)) + 1):
            windows.setdefault(tuple(v[s : s + 10]), set()).add(str(name))
    for doc, text in texts.items():
        w = [x for x in words(text) if x]
        hit, names = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if found := windows.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    names |= found
        want = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
        assert tuple(got[doc][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want

