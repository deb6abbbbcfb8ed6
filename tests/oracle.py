"""Compares a query's rows with its SQL, as the driver does: by column name, in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _key(row):
    return tuple("" if x is None else repr(x) for x in row)


def same(df, sql, con):
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in ([dict(zip(df.columns, x, strict=True)) for x in df.collect()])), key=_key)
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == names
    want = sorted((tuple(dict(zip(columns, x, strict=True))[c] for c in names) for x in relation.fetchall()), key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y), (a, b)
