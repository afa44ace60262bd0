"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def diff(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_cols = spark_df.columns
    got = rows_of(got_cols, spark_df.collect())
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rows_of(want_cols, rel.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:1]} want {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        cols = sorted(got_cols)
        cells = [(c, a, b) for c, a, b in zip(cols, *bad[0]) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {cells}"
    types = {c: t for c, t in spark_df.dtypes}
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    for c, t in types.items():
        kind = duck_types[c]
        if ("HUGEINT" in kind) or ("DECIMAL" in kind):
            return f"type of {c}: {t} vs {kind}"
    return None


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from pkgatlas.session import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                msg = diff(df, con, sqls[name])
                kind = "ok"
            else:
                msg, kind = None, f"rows={len(df.collect())}"
        except Exception as exc:
            msg = f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += msg is not None
        print(f"{name:24s} {time.time() - t:6.2f}s {msg or kind}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
