"""Compares a query with its DuckDB SQL over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.9g}")
        if isinstance(v, (bytes, bytearray)):
            return bytes(v).hex()
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


def compare(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = canon([tuple(r[c] for c in cols) for r in df.collect()])
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols, (sorted(names), cols)
    order = [names.index(c) for c in cols]
    want = canon([tuple(r[i] for i in order) for r in rel.fetchall()])
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)
