"""Rows of a query and of its SQL, in a form that can be compared."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cell(v):
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else repr(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(cell, r)) for r in df.select(*names).collect())


def sql_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(cell(r[i]) for i in at) for r in got.fetchall())
