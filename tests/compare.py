"""Run registered queries beside their DuckDB checks and compare the rows as bags."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    duck_rows = cursor.fetchall()
    t2 = time.time()
    note = f"{len(spark_rows)} rows, {t1 - t0:.2f}s / {t2 - t1:.2f}s"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    left, right = rows_of(df.columns, spark_rows), rows_of(columns, duck_rows)
    if left != right:
        only_left, only_right = list((left - right).items())[:2], list((right - left).items())[:2]
        return False, f"{note}\n  spark only: {only_left}\n  check only: {only_right}"
    return True, note


def main() -> None:
    import __spark_entry__ as entry
    from gatewarden.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(**{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        if name not in checks:
            n = query(spark, sf_dir).count()
            print(f"rows {name}: {n}", flush=True)
            continue
        try:
            ok, note = compare(spark, con, sf_dir, query, checks[name])
        except Exception as error:  # noqa: BLE001
            ok, note = False, str(error)[:1500]
        print("ok  " if ok else "BAD ", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
