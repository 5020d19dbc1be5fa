"""Run registered queries against their DuckDB checks on one folder of test tables."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def duck_rows(con, sql):
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    return canon_rows(columns, rel.fetchall())


def spark_rows(df):
    return canon_rows(df.columns, [tuple(r) for r in df.collect()])


def difference(df, con, sql) -> str | None:
    """None when both sides agree, else what differs."""
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} against {dc}"
    if sr != dr:
        only_s, only_d = [r for r in sr if r not in set(dr)][:3], [r for r in dr if r not in set(sr)][:3]
        return f"{len(sr)} rows against {len(dr)}: spark only {only_s} sql only {only_d}"
    return None


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0]
    names = argv[1:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            sql = entry.oracle_sql().get(name)
            what = difference(df, con, sql) if sql else f"rows only: {df.count()}"
            ok = what is None or not sql
        except Exception as exc:  # report and go on to the next query
            ok, what = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {what or ''}", flush=True)
    print(f"{bad} of {len(names)} differ")


if __name__ == "__main__":
    main(sys.argv[1:])
