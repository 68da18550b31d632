"""Comparing a query with its SQL in DuckDB."""

import datetime
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def same(spark, con, sf_dir, function, sql):
    found = function(spark, sf_dir)
    want = con.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    mine = [tuple(map(plain, row)) for row in found.select(*columns).collect()]
    theirs = [tuple(map(plain, row)) for row in want.select(*(f'"{c}"' for c in columns)).fetchall()]
    key = lambda row: [str(v) for v in row]
    assert sorted(mine, key=key) == sorted(theirs, key=key)
