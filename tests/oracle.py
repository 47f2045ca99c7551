"""Runs a query and its SQL over the same tables and compares them, rows in any order."""

from pathlib import Path

import duckdb
from pyspark.sql import types as T


def connection(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = connection(sf_dir)
    want = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda row: tuple((x is None, x) for x in row)
    place = [want.columns.index(n) for n in names]
    mine = sorted((tuple(r[n] for n in names) for r in got.collect()), key=plain)
    theirs = sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=plain)
    assert mine == theirs
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    for field in got.schema:
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):
            assert kinds[field.name] == {"bigint": "BIGINT", "int": "INTEGER"}[field.dataType.simpleString()], field.name
