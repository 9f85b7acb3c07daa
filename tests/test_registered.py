"""Every registered query with a SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.verify import canonical

SF = "/root/testdata/sf0.001"
# Period supersteps, some 80 jobs a query: one of the four, which resumes inside a
# season, is compared here; the others share its code and golden tests.
SLOW = {"team_ratings", "coach_ratings", "ratings_on_spine"}
# Joins of queries that are compared one by one, with ratings among them.
SLOW |= {"match_wide_table", "upcoming_full_table"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted((set(entry.oracle_sql()) & set(entry.REGISTRY)) - SLOW))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_names_its_operators():
    assert all(q.covers for q in entry.REGISTRY.values())
