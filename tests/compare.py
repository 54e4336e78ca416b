"""A query's rows against those of its SQL, order set aside."""

import glob
import os

import duckdb

TABLES = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else repr(round(value, 5) + 0.0)
    if isinstance(value, bool):
        return str(value)
    return "null" if value is None else str(value)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted("|".join(plain(v) for v in row) for row in frame.astype(object).where(frame.notna(), None)[names].itertuples(index=False))


def agrees(spark, query, sql, con):
    mine, theirs = rows_of(query(spark, TABLES).toPandas()), rows_of(con.execute(sql).df())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
