"""Readers, merges and incremental joins on built inputs."""

import json

import pytest
from pyspark.sql import functions as F

from pkgatlas import schemas
from pkgatlas.sources import documents, files


def test_bad_csv_rows_are_skipped(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('name,stars,note\na,1,"x, y"\nb,two,z\nc,3,w,extra\nd,4,\n')
    df = files.read_csv(spark, str(path), "name string, stars long, note string")
    assert sorted((r["name"], r["stars"], r["note"]) for r in df.collect()) == [
        ("a", 1, "x, y"), ("d", 4, None),
    ]
    # the same rows are kept when only one column is read
    assert sorted(r[0] for r in df.select("name").collect()) == ["a", "d"]
    assert df.count() == 2


def test_optional_source(spark):
    base = spark.range(1)
    assert files.optional(None, ["prior"], base).columns == ["id", "prior"]
    assert files.optional(base, ["prior"], base).columns == ["id"]


def test_download_documents(spark):
    def doc(*entries):
        return json.dumps({"data": [dict(zip(("category", "date", "downloads"), e)) for e in entries]})

    raw = spark.createDataFrame(
        [
            ("a", doc(("without_mirrors", "2024-01-01", 5), ("with_mirrors", "2024-01-01", 9))),
            ("b", doc(("without_mirrors", "2024-01-01", None), ("without_mirrors", None, 3))),
            ("c", doc(("without_mirrors", "2024-01-02", 0), ("without_mirrors", "", 3))),
            ("d", doc()), ("e", "not json"), ("f", None),
        ],
        "package_name string, json string",
    )
    got = sorted(map(tuple, documents.read_download_json(raw).collect()))
    assert got == [("a", "2024-01-01", 5), ("c", "2024-01-02", 0)]


def test_registry_documents(spark):
    docs = [
        {"info": {"name": "a", "version": "2", "requires_dist": ["x (>=1)", "y"]},
         "releases": {"1": [{"upload_time": "2020-01-01"}, {"upload_time": "2021-05-05"}], "2": [{"upload_time": "2021-01-01"}], "3": []}},
        {"info": {"name": "b", "requires_dist": None}, "releases": {"1": [{"upload_time": None}]}},
        {"info": {"name": "c"}},
    ]
    raw = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{}",)], "json string")
    got = {r["name"]: r for r in documents.read_metadata_json(raw).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["total_versions"] == 3 and got["a"]["latest_release_date"] == "2021-05-05"
    assert got["a"]["first_release_date"] == "2020-01-01"
    assert got["b"]["total_versions"] == 1 and got["b"]["latest_release_date"] is None
    assert got["c"]["total_versions"] == 0


def test_requirements(spark):
    items = ["numpy", "a-b (>=1.0,<2)", 'C.d[x,y]>=3; extra == "t" and python_version < "3"', "e ; os_name=='nt'"]
    meta = spark.createDataFrame([("p", json.dumps(items)), ("q", None), ("r", "[]")], "name string, requires_dist string")
    got = {r["dependency_name"]: r for r in documents.requirement_edges(meta).collect()}
    assert set(got) == {"numpy", "a-b", "C.d", "e"}
    assert got["a-b"]["dependency_requirements"] == ">=1.0,<2"
    assert (got["C.d"]["extras"], got["C.d"]["dependency_requirements"]) == ("x,y", ">=3")
    assert got["C.d"]["marker"].startswith("extra ==") and got["e"]["marker"] == "os_name=='nt'"


def test_newest_batch_wins(spark):
    old = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-01", 2)], schemas.DOWNLOADS)
    new = spark.createDataFrame(
        [("a", "2024-01-01", 10, 1), ("a", "2024-01-01", 7, 2), ("c", "2024-01-01", 3, 1)],
        schemas.DOWNLOADS + ", batch int",
    )
    merged = files.merge_downloads(old, new)
    assert sorted(map(tuple, merged.collect())) == [
        ("a", "2024-01-01", 7), ("b", "2024-01-01", 2), ("c", "2024-01-01", 3),
    ]
    assert files.merge_downloads(merged, new).exceptAll(merged).count() == 0


@pytest.mark.parametrize("fold,left", [(False, ["A", "c"]), (True, ["c"])])
def test_not_yet_and_done_make_all(spark, fold, left):
    everything = spark.createDataFrame([("A",), ("b",), ("c",)], "name string")
    done = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    assert sorted(r[0] for r in files.not_yet(everything, done, "name", fold).collect()) == left


def test_edges_are_pruned_by_key(spark, tmp_path):
    edges = spark.createDataFrame([("p", "B"), ("q", "a")], "project_name string, dependency_name string")
    files.write_edges(edges, str(tmp_path / "edges"))
    back = spark.read.parquet(str(tmp_path / "edges"))
    assert {r["name_key"] for r in back.collect()} == {"a", "b"}
    plan = back.filter(F.col("name_key") == "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name_key,a)" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    left = spark.createDataFrame([(f"N{i}", i) for i in range(50)], "name string, v int")
    files.write_bucketed(left, "bucketed_a", "name", 4, str(tmp_path / "a"))
    files.write_bucketed(left, "bucketed_b", "name", 4, str(tmp_path / "b"))
    a, b = spark.table("bucketed_a"), spark.table("bucketed_b").drop("name", "v")
    joined = a.hint("merge").join(b, "name_key")
    assert joined.count() == 50
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_a")
    spark.sql("DROP TABLE bucketed_b")


def test_work_folder(spark, monkeypatch):
    from pkgatlas import session

    named = spark.conf.get("spark.checkpoint.dir", spark.conf.get("spark.sql.warehouse.dir"))
    assert session.shared_dir(spark) == named
    a, b = session.new_work_path(spark, "x"), session.new_work_path(spark, "x")
    assert a != b and a.startswith(session.shared_dir(spark).rstrip("/"))


def test_quoted_quotes_and_breaks_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"says ""hi"", twice"\n2,"two\nlines"\nx,bad\n3,plain\n')
    schema = "a long, b string"
    got = {r["a"]: r["b"] for r in files.read_csv(spark, str(tmp_path), schema).collect()}
    assert got == {1: 'says "hi", twice', 2: "two\nlines", 3: "plain"}
    assert [r["record"] for r in files.rejected_csv(spark, str(tmp_path), schema).collect()] == ["x,bad"]


def test_plain_csv_lines_pass_by_the_batch():
    """Whole records are kept however batches cut a range; the second pass sends only what is cut."""
    import pyarrow as pa
    from pkgatlas.sources.split_csv import _record_task

    lines = ["tail of a field", 'end",x', "a,b", '"c', 'd",e', "f,g", '"open', "until the end"]
    for size in (1, 3, 8):
        batches = [
            pa.RecordBatch.from_pydict({"value": part, "file": ["f"] * len(part), "start": [9] * len(part), "inside": [True] * len(part)})
            for part in (lines[i : i + size] for i in range(0, 8, size))
        ]
        found = [{(r["record"], r["opens"], r["closes"]) for b in _record_task(True, both)(iter(batches)) for r in b.to_pylist()} for both in (True, False)]
        cut = {('tail of a field\nend",x', False, True), ('"open\nuntil the end', True, False)}
        assert found[0] == cut | {("a,b", True, True), ('"c\nd",e', True, True), ("f,g", True, True)}
        assert found[1] == cut | {('"c\nd",e', True, True)}
