import math
from collections import Counter

import pytest
from helpers import WORD, rows
from pkgatlas.llm import quality
from pyspark.sql import functions as F


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark, docs):
    extra = docs.unionByName(docs.limit(1).withColumn("text", F.lit("a b c a b c a b c d # $$ <x> | & é é é é é é")))
    got = quality.score_documents(extra, spark.createDataFrame([], "doc_id long, quality int"))
    seen = sorted(tuple(r) for r in got.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert seen == sorted([brute(r["text"]) for r in extra.collect()])
    for r in got.collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)  # no labels, no further verdict


@pytest.mark.parametrize("k,n,p", [(0, 0, 0.02), (0, 200, 0.02), (3, 200, 0.02), (40, 90000, 0.0005), (5, 5, 0.1), (7000, 400000, 0.02)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(
        quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")
    ).first()[0]
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
        for i in range(k + 1)
    ]
    assert got == pytest.approx(min(1.0, math.fsum(map(math.exp, logs))), rel=1e-6)


def _labelled(spark, n, bad_every):
    data = []
    for i in range(n):
        bad = i % bad_every == 0
        words = [f"word{i}x{j}" for j in range(60)]
        data.append((i, " ".join(w + ("###" if bad else "") for w in words), "en" if i % 2 else None, None, 1, 1, 1, ""))
    labels = spark.createDataFrame([(i, int(i % bad_every != 0), 0) for i in range(n)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return data, labels


def test_certified_rule_rejects_junk_only(spark):
    from helpers import frame

    data, labels = _labelled(spark, 3000, 5)
    kept = {r["doc_id"] for r in quality.keep_documents(frame(spark, data), labels).select("doc_id").collect()}
    assert kept == {i for i in range(3000) if i % 5}


def test_few_labels_certify_nothing(spark):
    from helpers import frame

    data, labels = _labelled(spark, 200, 5)
    assert quality.keep_documents(frame(spark, data), labels).count() == 200


def test_cutoffs_hold_the_bound(spark):
    """Statistics without any meaning: what is certified rejects few good documents."""
    stats = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("lang"),
        *[(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1000)) / 1000).alias(r) for r in quality.RULES],
    )
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(3)) > 0).cast("int").alias("quality"))
    out = quality.certified_cutoffs(stats, labels, "lang", rules={r: (0.5, 0.9, 0.97, 0.999) for r in quality.RULES}, cost_of_good=0)
    for r in out.collect():
        assert r.certified == (r.n_false / r.n_good < 0.02 and r.p_value < 0.05) or not r.certified


def test_repeated_null_and_empty(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = quality.keep_documents(docs, labels)
    assert kept.columns == docs.columns
    want = [r for r in rows() if (b := brute(r[1]))[0] >= 50 and 100 * b[4] <= 50 * b[0]]
    assert sorted(map(str, (r[0] for r in want))) == sorted(str(r["doc_id"]) for r in kept.collect())
    assert quality.keep_documents(no_docs, labels).count() == 0


def test_no_python_in_the_plan(docs, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = quality.score_documents(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
