"""Rows of a query against those of its SQL, in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def same(df, connection, sql):
    got = connection.execute(sql)
    columns = [x[0] for x in got.description]
    assert sorted(columns) == sorted(df.columns)
    key = sorted(columns)
    want = sorted(str([plain(r[columns.index(c)]) for c in key]) for r in got.fetchall())
    assert sorted(str([plain(r[c]) for c in key]) for r in df.collect()) == want
