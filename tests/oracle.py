"""Compare a Spark query with its DuckDB SQL, whatever the order of rows and columns."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=SF):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{file}"
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str([plain(v) for v in value]) if isinstance(value, list | tuple) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, con, query, sql, sf_dir=SF):
    frame = query(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, frame.collect()) == rows(names, result.fetchall())
