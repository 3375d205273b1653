"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from fringeworks.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(QUERIES) <= set(entry.queries())


def plain(rows):
    def one(x):
        return round(float(x), 9) if isinstance(x, float) or type(x).__name__ == "Decimal" else x

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_sql_agrees(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings"):
        db.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    want = db.sql(SQL[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain([r[c] for c in columns] for r in got.collect()) == plain([r[want.columns.index(c)] for c in columns] for r in want.fetchall())
