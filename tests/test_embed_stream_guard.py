"""Embedding hook, streams, guarded SQL, citations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgatlas.operators import citations, embed
from pkgatlas.operators.guard import GuardError, check_select, guarded_select, run_guarded
from pkgatlas.operators.trends import monthly_downloads
from pkgatlas.sources.documents import read_download_json
from pkgatlas.streaming import downloads, vectors


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(
        [(1, "red red blue"), (2, "blue green"), (3, ""), (4, None), (5, "red red blue")],
        "id long, embedding_text string",
    )


def test_native_vectors(texts):
    got = {r["id"]: np.array(r["embedding"]) for r in embed.embed_texts(texts, dim=64).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(len(v) == 64 for v in got.values())
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6 and np.linalg.norm(got[3]) == 0
    assert np.linalg.norm(got[4]) == 0 and (got[1] == got[5]).all()
    assert 0 < got[1] @ got[2] < 1


def test_provider_batches_and_failures(spark):
    df = spark.createDataFrame([(i, "bad" if i == 7 else f"t{i}") for i in range(20)], "id long, embedding_text string").coalesce(1)

    def provider(batch):
        assert len(batch) <= 4
        if "bad" in batch:
            raise RuntimeError("quota")
        return [[float(len(t)), 1.0] for t in batch]

    got = embed.embed_texts(df, provider=provider, batch_size=4).orderBy("id").collect()
    failed = [r["id"] for r in got if r["embed_error"]]
    assert failed == [4, 5, 6, 7] and "quota" in got[4]["embed_error"]
    assert got[0]["embedding"] == [2.0, 1.0] and got[4]["embedding"] is None


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))


def test_download_stream_equals_batch(spark, tmp_path):
    schema = "package_name string, json string"

    def doc(*entries):
        items = ",".join(f'{{"category":"without_mirrors","date":"{d}","downloads":{n}}}' for d, n in entries)
        return f'{{"data":[{items}]}}'

    src = tmp_path / "in"
    first = [("a", doc(("2024-01-01", 5), ("2024-01-02", 6))), ("b", doc(("2024-01-01", 1)))]
    second = [("a", doc(("2024-01-02", 6), ("2024-02-01", 9)))]  # one day comes again

    def run():
        raw = spark.readStream.schema(schema).json(str(src))
        downloads.start_downloads(raw, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(map(tuple, downloads.monthly_totals(spark, str(tmp_path / "out")).collect()))

    _write(spark, src, first, schema)
    assert run() == [("a", "2024-01", 11), ("b", "2024-01", 1)]
    _write(spark, src, second, schema)
    total = run()
    batch = read_download_json(spark.createDataFrame(first + second, schema)).distinct()
    assert total == sorted(map(tuple, monthly_downloads(batch).collect()))
    assert run() == total  # nothing new, nothing counted twice
    # an older date in a later file counts, and a corrected number replaces the first
    _write(spark, src, [("a", doc(("2023-01-05", 2), ("2024-01-01", 7)))], schema)
    assert run() == [("a", "2023-01", 2), ("a", "2024-01", 13), ("a", "2024-02", 9), ("b", "2024-01", 1)]


def test_vector_stream_skips_unchanged(spark, tmp_path):
    schema = "id long, name string, embedding_text string, updated_at long"
    src, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        rows = spark.readStream.schema(schema).json(str(src))
        vectors.start_vectors(rows, out, str(tmp_path / "cp")).awaitTermination()
        return {r["id"]: r for r in vectors.current_vectors(spark, out).collect()}

    _write(spark, src, [(1, "a", "x y", 1), (2, "b", "z", 1)], schema)
    before = run()
    _write(spark, src, [(1, "a", "x y", 2), (2, "b", "older", 2), (2, "b", "changed", 3), (3, "c", "new", 2)], schema)
    after = run()
    assert set(after) == {1, 2, 3} and after[1]["batch_id"] == before[1]["batch_id"]
    assert after[2]["batch_id"] > before[2]["batch_id"] and after[2]["embedding"] != before[2]["embedding"]
    newest = vectors.plain_vectors(spark.createDataFrame([(2, "b", "changed", 3)], schema)).first()
    assert after[2]["embedding"] == newest["embedding"]  # the newer of two versions in one batch


TABLES = "t"


@pytest.fixture
def tables(spark):
    return {"t": spark.createDataFrame([(i, i % 3) for i in range(10)], "id long, g long")}


@pytest.mark.parametrize("sql", [
    "DROP TABLE t", "INSERT INTO t VALUES (1, 2)", "CREATE TABLE x AS SELECT * FROM t", "SET a=b",
    "SELECT 1; SELECT 2", "SELECT * FROM other", "SELECT * FROM t WHERE id IN (SELECT id FROM secret)",
    "SELECT * FROM parquet.`/etc`", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "not sql",
    "SELECT java_method('java.lang.System', 'exit', 0) FROM t", "CACHE TABLE t", "SHOW TABLES", "USE x",
    "SELECT missing FROM t", "SELECT reflect('a', 'b') FROM t",
    "FROM t INSERT INTO x SELECT *", "EXPLAIN SELECT * FROM t",
    "SELECT * FROM secret WHERE 1 IN (WITH secret AS (SELECT 1 AS a) SELECT a FROM secret)",
    "SELECT " + ", ".join(f"id AS c{i}" for i in range(40)) + ", reflect('java.lang.System', 'lineSeparator') FROM t",
    "SELECT * FROM (SELECT * FROM nested)", "SELECT system.builtin.reflect('java.lang.System', 'lineSeparator') FROM t",
    "SELECT (SELECT max(a) FROM secret) FROM t", "SELECT raise_error('x') FROM t",
])
def test_guard_refuses(spark, tables, sql):
    spark.createDataFrame([(1,)], "a long").createOrReplaceTempView("secret")
    spark.sql("SELECT * FROM secret").createOrReplaceTempView("nested")
    with pytest.raises(GuardError):
        guarded_select(spark, sql, tables)


@pytest.mark.parametrize("sql,want", [
    ("SELECT g, count(*) AS n FROM t GROUP BY g ORDER BY g;", [(0, 4), (1, 3), (2, 3)]),
    ("WITH a AS (SELECT max(id) AS m FROM T) SELECT m FROM a", [(9,)]),
    ("SELECT id FROM t WHERE id > (SELECT avg(id) FROM t) ORDER BY id LIMIT 2", [(5,), (6,)]),
    ("SELECT '{x}' AS a, 'DROP TABLE t' AS b", [("{x}", "DROP TABLE t")]),
    ("SELECT '{x}' AS a FROM t LIMIT 1", [("{x}",)]),
    ("SELECT 1 AS a UNION ALL SELECT id FROM t WHERE id = 2 -- end", [(1,), (2,)]),
])
def test_guard_allows(spark, tables, sql, want):
    assert sorted(map(tuple, guarded_select(spark, sql, tables).collect())) == want


@pytest.mark.parametrize("expression", [
    "upper(x) || lower(x) || trim(x) || initcap(x) || repeat(x, 2) || lpad(x, 9, '0') || rpad(x, 9) || replace(x, 'a', 'b')",
    "length(x) + instr(x, 'a') + levenshtein(x, 'b') + ascii(x) + position('a' IN x)",
    "contains(x, 'a') AND startswith(x, 'a') OR endswith(x, 'a') OR x LIKE 'a%' OR x ILIKE 'A%' OR x RLIKE 'a' OR NOT x IN ('a', 'b')",
    "regexp_replace(x, 'a', 'b') || split(x, ',')[0] || split_part(x, ',', 1) || substring(x, 1, 2) || left(x, 1) || concat_ws('-', x, x)",
    "ceil(id / 3) + floor(id / 3) + ceil(id / 3, 1) + round(id / 3, 2) + abs(-id) + sqrt(id) + ln(id + 1) + pow(id, 2) + id % 2",
    "CASE WHEN id > 3 THEN 1 WHEN id IS NULL THEN 2 ELSE nullif(id, 4) END + coalesce(id, 0) + if(id > 2, 1, 0) + greatest(id, 1)",
    "date_trunc('month', d) = to_timestamp('2020-01-01') OR year(d) = 2020 OR d > date'2020-01-01' + interval 1 month OR hour(d) > 1",
    "datediff(d, to_date('2020-01-01')) + extract(month FROM d) + date_part('day', d) + unix_timestamp(d)",
    "date_add(d, 3) > current_date() OR date_format(d, 'yyyy') = '2020' OR add_months(d, 1) IS NOT NULL OR d - interval '1' day > d",
    "size(array(id, 2)) + aggregate(sequence(1, id), 0L, (a, v) -> a + v) + element_at(map('a', id), 'a') + named_struct('a', id).a",
    "transform(filter(array(id, 2), v -> v > 2), v -> v + 1)[0] + cast('3' AS INT) + try_divide(id, 0) + array_max(array(id))",
    "(SELECT count(*) FROM t u WHERE u.id < 3) + get_json_object('{\"a\":1}', '$.a') + hash(id) + xxhash64(x)",
    "sum(id) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) + row_number() OVER (ORDER BY id) + lag(id) OVER (ORDER BY id)",
    "EXISTS (SELECT 1 FROM t u WHERE u.id = s.id) OR id IN (SELECT id FROM t)",
])
def test_guard_allows_usual_functions(spark, tables, expression):
    sub = "(SELECT *, cast(id AS STRING) AS x, timestamp'2020-01-05 10:00:00' AS d FROM t) s"
    assert guarded_select(spark, f"SELECT {expression} AS v FROM {sub}", tables).count() == 10


@pytest.mark.parametrize("select", [
    "count(*), count(DISTINCT id), sum(id), avg(id), min(id), max(id), stddev(id), median(id), percentile_approx(id, 0.5), try_sum(id)",
    "collect_list(id), array_agg(id), max_by(g, id), first(id), any_value(g), bool_or(id > 2), count_if(id > 1), mode(g), corr(id, g)",
    "sum(id) FILTER (WHERE id > 2), percentile_cont(0.5) WITHIN GROUP (ORDER BY id), listagg(cast(id AS STRING), ',')",
])
def test_guard_allows_usual_aggregates(spark, tables, select):
    assert guarded_select(spark, f"SELECT g, {select} FROM t GROUP BY g", tables).count() == 3
    assert guarded_select(spark, f"SELECT g, {select} FROM t GROUP BY CUBE (g) HAVING count(*) > 0", tables).count() == 4


def test_guard_allows_usual_relations(spark, tables):
    for sql, n in [
        ("SELECT a.id, e FROM t a LATERAL VIEW explode(array(1, 2)) v AS e", 20),
        ("SELECT * FROM (SELECT g, id FROM t) PIVOT (sum(id) FOR g IN (0, 1, 2))", 1),
        ("SELECT id FROM t EXCEPT SELECT id FROM t WHERE id > 4", 5),
        ("SELECT id FROM t INTERSECT SELECT id + 1 FROM t", 9),
        ("SELECT a.id FROM t a LEFT JOIN t b ON a.id = b.id + 1", 10),
        ("SELECT DISTINCT g FROM t ORDER BY g LIMIT 2 OFFSET 1", 2),
        ("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS v(n, s)", 2),
        ("SELECT t.g, l.m FROM t, LATERAL (SELECT max(u.id) AS m FROM t u WHERE u.g = t.g) l", 10),
    ]:
        assert guarded_select(spark, sql, tables).count() == n, sql


@pytest.mark.parametrize("expression", [
    "typeof(id)", "version()", "current_user()", "uuid()", "spark_partition_id()", "monotonically_increasing_id()",
    "assert_true(id > 0)", "aes_encrypt('a', '0000111122223333')", "twice(id)", "upper(current_catalog())",
    "transform(array(id), v -> uuid())", "if(id > 3, input_file_name(), 'x')",
])
def test_guard_refuses_what_no_list_names(spark, tables, expression):
    spark.udf.register("twice", lambda v: v * 2, "long")
    with pytest.raises(GuardError):
        guarded_select(spark, f"SELECT {expression} AS v FROM t", tables)


def test_guard_bounds_what_is_read(spark):
    big = {"t": spark.range(10**6), "u": spark.range(10**6).withColumnRenamed("id", "k")}
    keyed = "SELECT count(*) AS n FROM t JOIN u ON id = k WHERE k < 3"
    assert guarded_select(spark, keyed, big, max_bytes=10**8).first()["n"] == 3
    for sql in ("SELECT count(*) FROM t, u", "SELECT count(*) FROM t JOIN u ON id < k", "SELECT count(*) FROM range(1000000000000)"):
        with pytest.raises(GuardError, match="bytes"):
            guarded_select(spark, sql, big, max_bytes=10**8)
    with pytest.raises(GuardError, match="bytes"):
        run_guarded(spark, keyed, big, max_bytes=10**6)


def test_guard_caps_and_stops(spark, tables):
    cut = guarded_select(spark, "SELECT * FROM t", tables, max_rows=4).collect()
    assert len(cut) == 4 and all(r["truncated"] for r in cut)
    assert not any(r["truncated"] for r in guarded_select(spark, "SELECT * FROM t", tables, max_rows=10).collect())
    assert len(run_guarded(spark, "SELECT * FROM t", tables)) == 10
    check_select(spark, "SELECT * FROM t a JOIN T b ON a.id = b.id", tables)
    slow = {"t": spark.range(0, 10**13, 1, 8)}
    with pytest.raises(TimeoutError):
        run_guarded(spark, "SELECT sum(sqrt(id)) FROM t", slow, timeout_s=2)


def test_citations(spark):
    answers = spark.createDataFrame(
        [(1, "Flask has 1,200 stars and django has 7 forks."), (2, "flask has 3 stars, FLASK HAS 1200 Stars"),
         (3, "nope has 1 stars"), (4, "nothing cited"), (5, "flask has 99999999999999999999 stars")],
        "answer_id long, text string",
    )
    stats = spark.createDataFrame(
        [("flask", 1200, 5, 1), ("django", 9, 9, 7)], "name_key string, stars long, dependents_count long, forks long"
    )
    checked = citations.check_citations(answers, stats)
    labels = {r["answer_id"]: r["grounding"] for r in citations.grounding(answers, checked).collect()}
    assert labels == {1: "direct", 2: "partial", 3: "insufficient", 4: "insufficient", 5: "insufficient"}
    assert checked.filter((F.col("answer_id") == 3) & F.col("actual").isNull()).count() == 1
