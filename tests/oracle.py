"""Side-by-side run of a query and its oracle."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v + 0.0))
    return (type(v).__name__, str(v))


def normal(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def compare(con, df, sql):
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    got, want = normal(df.columns, [tuple(r) for r in df.collect()]), normal(names, res.fetchall())
    assert len(got) == len(want)
    assert got == want
