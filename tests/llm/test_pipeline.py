import importlib
import sys

import corpus_pipeline
import pytest
from helpers import frame, rows
from pkgatlas.llm import queries
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_bear_hard_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/stage{number}")
        docs = spark.read.parquet(f"{folder}/stage{number}")
    assert docs.agg(F.sum("length")).first()[0] > 0


def test_stages_bear_empty_tables(spark, no_docs, folder):
    docs = no_docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_decisions_take_effect(spark, folder):
    """Copies leave one, repeated lines go, short texts go."""
    body = [" ".join(f"word{i}n{j}" for j in range(120)) for i in range(4)]
    shared = "this passage of a line stands in two documents and is longer than ten"
    data = [
        (1, body[0] + "\n" + shared, "en", "a", 1, 1, 1, ""), (2, body[1] + "\n" + shared.upper(), "en", "a", 1, 1, 1, ""),
        (3, body[2], "en", "b", 1, 1, 1, ""), (4, body[2], "en", "b", 1, 1, 1, ""), (5, "too short", "en", "b", 1, 1, 1, ""),
    ]
    docs = frame(spark, data)
    quality, lines, near = (f for _, f in corpus_pipeline.STAGES[:3])
    kept = quality(spark, docs, folder)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4]
    lined = {r["doc_id"]: r for r in lines(spark, kept, folder).collect()}
    assert lined[1]["text"].endswith(shared) and lined[2]["text"] == body[1] and lined[2]["n_chars"] == len(body[1])
    assert lined[3]["text"] == body[2] and lined[4]["text"] == ""  # a copy loses its lines to the first
    assert sorted(r["doc_id"] for r in near(spark, kept, folder).collect()) == [1, 2, 3]


def test_registered(sf_dir):
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(queries.LLM_QUERIES) | {"pipeline"} <= names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert len(rows()) > 40 and set(queries.LLM_ORACLES) <= names


@pytest.mark.parametrize("name", sorted(queries.LLM_ORACLES))
def test_oracles(spark, sf_dir, name):
    from compare import diff, duck

    assert diff(queries.LLM_QUERIES[name](spark, sf_dir), duck(sf_dir), queries.LLM_ORACLES[name]) is None


def test_library_does_without(monkeypatch):
    """The entry module works when this part of the library is gone."""
    for name in [m for m in sys.modules if m.startswith(("pkgatlas.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "top_growth" in entry.queries() and not any(n.startswith("op1_") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
