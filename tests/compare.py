"""Run registered queries against their SQL: ``python -m tests.compare [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
                cells.append("∅")
            elif isinstance(v, float):
                cells.append(f"{v:.9g}")
            elif hasattr(v, "tolist"):
                cells.append(str(v.tolist()))
            else:
                cells.append(str(v))
        rows.append(tuple(cells))
    return sorted(rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = df.columns
    rows = [tuple(r) for r in df.collect()]
    return names, canonical(pd.DataFrame(rows, columns=names, dtype=object))


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, canonical(pd.DataFrame(cur.fetchall(), columns=names, dtype=object))


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from keytide.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    chosen = argv or list(queries())
    bad = 0
    for name in chosen:
        t = time.time()
        try:
            names, rows = spark_rows(queries()[name](spark, sf_dir))
            took = time.time() - t
            if name not in oracle_sql():
                print(f"ROWS  {name}: {len(rows)} rows {took:.1f}s", flush=True)
                continue
            dnames, drows = duck_rows(con, oracle_sql()[name])
            ok = sorted(names) == sorted(dnames) and rows == drows
            bad += not ok
            print(f"{'OK   ' if ok else 'DIFF '} {name}: {len(rows)}/{len(drows)} rows {took:.1f}s", flush=True)
            if not ok:
                print("  columns", sorted(names), sorted(dnames))
                print("  spark only", sorted(set(rows) - set(drows))[:3])
                print("  sql only  ", sorted(set(drows) - set(rows))[:3])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {str(e)[:1200]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
