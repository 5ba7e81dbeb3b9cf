"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from kvloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, db, data, name):
    df = catalogue.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    want_cursor = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want_cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in want_cursor.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and max(r["rank"] for r in rows) <= 9
