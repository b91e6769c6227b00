"""Comparison of a query with its SQL in DuckDB, as multisets of rows."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def same(spark, name, query, sql, sf=SF):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = query(spark, sf)
    r = c.execute(sql)
    theirs = rows([d[0] for d in r.description], r.fetchall())
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == theirs, name
