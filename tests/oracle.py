"""Runs a query beside its SQL counterpart and compares the rows."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def compare(spark, query, sql, data=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = query(spark, data)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(tuple(str(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in got.select(*order).collect()) == want
