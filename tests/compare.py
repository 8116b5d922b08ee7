"""A query's rows against its SQL in DuckDB, order apart."""

import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def compare(spark, sf_dir, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = query(spark, sf_dir), db.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == expected
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: types[t] for c, t in df.dtypes if t in types} == {c: kinds[c] for c, t in df.dtypes if t in types}
