"""Registered queries on the smallest tables: SQL twins and held-out accuracy."""

import glob
import os

import duckdb
import pytest

from scripts.verify import canonical
from tidemark.llm.queries import QUERIES, SQL

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


@pytest.mark.parametrize("name,label", [("op1_counterfactual_toxicity", "toxic"), ("op3_line_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    got = QUERIES[name](spark, MORE).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, {label} AS truth FROM '{MORE}/labels.parquet'").df()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert len(got) == 1000 and (held.predicted == held.truth).mean() > 0.93
