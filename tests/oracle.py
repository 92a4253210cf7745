"""Compares a query's rows with those of its SQL in DuckDB, as multisets."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple(round(x, 9) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x for x in row)


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(_key(r) for r in df.select(*cols).collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(_key([r[i] for i in at]) for r in result.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
