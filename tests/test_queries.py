"""Every query with a SQL twin gives the twin's rows, as a multiset."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from busloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else float(round(v, 6)) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted(repr([plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, data, duck, name):
    ours = catalogue.queries()[name](spark, data).toPandas()
    theirs = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
