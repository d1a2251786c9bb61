"""Every registered query with SQL, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from qualspark.jobs.file_queries import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        columns, want = oracle(sf_dir, ORACLE_SQL[name])
        assert sorted(columns) == sorted(df.columns)
        assert normal(df.columns, rows) == normal(columns, want)
