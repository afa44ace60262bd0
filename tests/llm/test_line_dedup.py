from collections import defaultdict

import numpy as np
from helpers import WHITE, frame, lower, rows
from pkgatlas.llm import line_dedup


def brute(data):
    held = defaultdict(set)
    split = [(r[0], (r[1] or "").split("\n")) for r in data]
    for doc, lines in split:
        for line in lines:
            key = lower(line.strip(WHITE))
            if doc is not None and len(key) >= 10:
                held[key].add(doc)
    out = []
    for doc, lines in split:
        keep = [
            x for x in lines
            if doc is None or len(held[k := lower(x.strip(WHITE))]) < 2 or doc == min(held[k])
        ]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()], key=str)


def test_equals_brute_force(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert found(out) == brute(rows())


def test_full_filter_only_costs_rows(docs, monkeypatch):
    """A filter that holds everything makes every line a suspect; the result stays the same."""
    monkeypatch.setattr(line_dedup, "twice_seen", lambda texts, bits, **_: np.full(bits // 8, 255, np.uint8))
    assert found(line_dedup.dedup_lines(docs)) == brute(rows())


def test_filter_holds_every_repeat(docs):
    bits = 1 << 19
    filter_ = line_dedup.twice_seen(docs.filter("doc_id is not null").selectExpr("cast(text as binary)"), bits, tasks=3)
    held = defaultdict(set)
    for doc, text, *_ in rows():
        if doc is not None:
            for _, key in line_dedup.line_keys((text or "").encode()):
                held[key].add(doc)
    twice = [k for k, d in held.items() if len(d) > 1]
    once = [k for k, d in held.items() if len(d) == 1]

    def share(keys):
        return line_dedup._held(filter_, line_dedup._probes(line_dedup._digests(keys), bits, line_dedup.PROBES)).mean()

    assert twice and share(twice) == 1 and share(once) < 0.05


def test_clashing_columns_are_replaced(spark, docs):
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("old")))
    assert dict(out.dtypes)["n_lines"] == "bigint" and found(out) == brute(rows())


def test_empty_table(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_hot_line(spark):
    data = [(i, "this line is in every document\nown line number %d" % i, None, None, 1, 1, 1, "") for i in range(600)]
    got = line_dedup.dedup_lines(frame(spark, data))
    assert found(got) == brute(data) and got.filter("n_dropped = 0").count() == 1
