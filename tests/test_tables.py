"""Split CSV and kept tables."""

import csv
import io
import random

import pytest
from pkgatlas.sources import files, split_csv
from pkgatlas.sources.tables import KeyedTable, Manifest

SCHEMA = "id long, name string, note string"


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "512")
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def write_csv(path, rows, line="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line)
    writer.writerow(["id", "name", "note"])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def hard_rows(n, seed):
    rnd = random.Random(seed)
    notes = ["plain", 'says "hi"', "two\nlines", '"', '""', ",", 'a\n\n"b",\n', "ünï\ncode", "x" * 700, 'open "\nclose "', "line\n" * 60]
    return [(i, f"n{i}", rnd.choice(notes)) for i in range(n)]


@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_split_csv_equals_the_written_rows(spark, tmp_path, small_ranges, line):
    want = []
    for k in range(2):
        rows = hard_rows(120, k)
        write_csv(tmp_path / f"{k}.csv", rows, line)
        want += rows
    got = split_csv.read_split_csv(spark, str(tmp_path), SCHEMA)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert split_csv._lines(spark, str(tmp_path / "0.csv")).rdd.getNumPartitions() >= 8


def test_split_csv_equals_the_one_task_reader(spark, tmp_path, small_ranges):
    """Also in what it rejects, in one long record over many ranges, and in an open quote at the end."""
    rows = hard_rows(60, 3)
    write_csv(tmp_path / "a.csv", [*rows, (500, "long", "z\n" * 3000), (501, "after", "q")])
    with open(tmp_path / "a.csv", "a") as f:
        f.write('x,bad,"a ""number"""\n7,too,many,fields\n\n8,"fine\n",\n9,last,"never closed\n')
    path = str(tmp_path)
    keep = lambda df: sorted(map(str, df.collect()))
    assert keep(split_csv.read_split_csv(spark, path, SCHEMA).filter("id <> 9")) == keep(files.read_csv(spark, path, SCHEMA).filter("id <> 9"))
    told = [r["record"] for r in split_csv.rejected_split_csv(spark, path, SCHEMA).collect()]
    assert 'x,bad,"a ""number"""' in told and "7,too,many,fields" in told
    # the same rows are kept when one column is read
    assert split_csv.read_split_csv(spark, path, SCHEMA).select("name").count() == split_csv.read_split_csv(spark, path, SCHEMA).count()


def test_large_range_tables_are_joined(spark, tmp_path, small_ranges, monkeypatch):
    rows = hard_rows(80, 5)
    write_csv(tmp_path / "a.csv", rows)
    monkeypatch.setattr(split_csv, "SENT_RANGES", 0)
    assert sorted(map(tuple, split_csv.read_split_csv(spark, str(tmp_path), SCHEMA).collect())) == sorted(rows)


def test_files_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,note\n")
    (tmp_path / "b.csv").write_text("")
    assert split_csv.read_split_csv(spark, str(tmp_path), SCHEMA).count() == 0


def table(spark, path):
    return KeyedTable(spark, str(path / "t"), ["id"], "id long, v array<double>, note string", buckets=4)


def rows(spark, *items):
    return spark.createDataFrame(list(items), "id long, v array<double>, note string")


def state(df):
    return sorted(((r["id"], r["v"], r["note"]) for r in df.collect()), key=str)


def test_commits_replays_and_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.versions() == []
    t.upsert(rows(spark, (1, [1.0], "a"), (2, [2.0], "a"), (None, [0.0], "n")), 0)
    t.upsert(rows(spark, (2, [3.0], "b"), (3, [4.0], "b"), (3, [5.0], "c")), 1)
    want = [(1, [1.0], "a"), (2, [3.0], "b"), (3, [5.0], "c"), (None, [0.0], "n")]
    assert state(t.read()) == want
    # a replay, and an older batch, change nothing
    assert t.upsert(rows(spark, (9, [9.0], "z")), 1).version == t.upsert(rows(spark, (9, [9.0], "z")), 0).version == 2
    assert state(t.read()) == want and t.versions() == [1, 2]
    t.delete(rows(spark, (1, None, None), (77, None, None), (None, None, None)), 2)
    t.upsert(rows(spark, (77, [7.0], "back")), 3)
    assert state(t.read()) == [(2, [3.0], "b"), (3, [5.0], "c"), (77, [7.0], "back")]
    assert state(t.read(2)) == want  # an older version is still there


def test_compaction_changes_no_row(spark, tmp_path):
    t = table(spark, tmp_path)
    for b in range(4):
        t.upsert(rows(spark, *[(i, [float(b)], f"b{b}") for i in range(b * 5, b * 5 + 12)]), b)
    t.delete(rows(spark, (3, None, None), (14, None, None)), 4)
    want = state(t.read())
    assert t.compact().deltas == () and state(t.read()) == want
    assert t.compact().version == t.manifest().version  # nothing to do
    t.upsert(rows(spark, (3, [9.0], "again"), (5, None, None)), 5)
    assert state(t.read()) == sorted([r for r in want if r[0] != 5] + [(3, [9.0], "again"), (5, None, None)], key=str)


def test_a_failed_commit_is_not_seen(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, [1.0], "a")), 0)

    def fail(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", fail)
        with pytest.raises(OSError):
            t.upsert(rows(spark, (2, [2.0], "b")), 1)
    assert state(t.read()) == [(1, [1.0], "a")]
    t.upsert(rows(spark, (2, [2.0], "b")), 1)
    assert state(t.read()) == [(1, [1.0], "a"), (2, [2.0], "b")]


def test_two_writers(spark, tmp_path, monkeypatch):
    """One of two writers of a version begins again on top of the other; no rows are lost."""
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    real, raced = KeyedTable._publish, []

    def late(self, manifest):
        if self is t and not raced:
            raced.append(1)
            other.upsert(rows(spark, (2, [2.0], "other")), 5)
        return real(self, manifest)

    t.upsert(rows(spark, (0, [0.0], "first")), 0)
    monkeypatch.setattr(KeyedTable, "_publish", late)
    raced.clear()
    t.upsert(rows(spark, (1, [1.0], "own")), 6)
    assert state(t.read()) == [(0, [0.0], "first"), (1, [1.0], "own"), (2, [2.0], "other")]
    assert t.versions() == [1, 2, 3] and t._publish(Manifest(version=3)) is False


def test_commit_during_compaction_stays(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.upsert(rows(spark, (1, [1.0], "a")), 0)
    t.upsert(rows(spark, (2, [1.0], "a")), 1)
    real = KeyedTable._commit

    def late(self, change, attempts=20):
        if self is t:
            other.upsert(rows(spark, (1, [8.0], "late")), 2)
        return real(self, change, attempts)

    monkeypatch.setattr(KeyedTable, "_commit", late)
    assert len(t.compact().deltas) == 1
    assert state(t.read()) == [(1, [8.0], "late"), (2, [1.0], "a")]


def test_merging_looks_base_rows_up_and_groups_only_deltas(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, *[(i, [1.0], "a") for i in range(50)]), 0)
    t.compact()
    t.upsert(rows(spark, (1, [2.0], "b")), 1)
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.count("Aggregate") == 2
    fail_first = plan.index("LeftAnti")
    assert plan[:fail_first].count("Aggregate") == 0
