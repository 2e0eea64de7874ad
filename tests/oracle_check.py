"""Compare queries with their SQL counterparts: ``python tests/oracle_check.py [sf] [name …]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return round(value, 9)
    return int(value) if type(value).__name__ in ("Decimal",) and value == int(value) else value


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df.select(*cols).collect()]
    if sql is None:
        return True, f"{len(rows)} rows, no SQL"
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    if sorted(have) != cols:
        return False, f"columns {cols} vs {sorted(have)}"
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    types = {d[0]: str(d[1]) for d in cur.description}
    odd = {n: (t, types[n]) for n, t in df.dtypes if kinds.get(t) != types[n]}
    if odd:
        return False, f"types differ: {odd}"
    order = [have.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    rows.sort(key=key)
    want.sort(key=key)
    if rows != want:
        diff = next(((a, b) for a, b in zip(rows, want) if a != b), None)
        return False, f"{len(rows)} vs {len(want)} rows; cols {cols}; first difference {diff}"
    return True, f"{len(rows)} rows"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from docflow.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name, queries()[name], oracle_sql().get(name))
        except Exception as err:  # report and go on with the next query
            ok, note = False, f"{type(err).__name__}: {str(err)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.1f}s  {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
