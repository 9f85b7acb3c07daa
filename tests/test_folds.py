"""Shared folds: each built once, the same rows for history and schedule."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import folds as G
from tidemark.operators import history as H
from tidemark.plans import features as X
from tidemark.plans.testbed import Tables

SF = "/root/testdata/sf0.001"
CHEAP = [n for n in X.WIDE if n != "ratings_on_spine"]


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF).once("matches")


def test_a_fold_is_built_once(spark, tables, monkeypatch):
    built = []
    for name, step in list(G.FOLDS.items()):
        def build(*a, step=step):
            built.append(step.name)
            return step.build(*a)

        monkeypatch.setitem(G.FOLDS, name, G.Fold(name, step.needs, build, step.keep))
    f = G.Folds(tables, tables.matches.select(*X.SPINE))
    out = f.assemble(CHEAP)
    assert len(built) == len(set(built)) and {"matches", "sides", "team_state", "rank_wide"} <= set(built)
    assert out.count() == tables.matches.count()
    other = f.over(tables.matches.select(*X.SPINE).limit(3))
    built.clear()
    assert other.assemble(CHEAP).count() == 3
    assert set(built) <= {"spine", "sides", *[n for n in G.FOLDS if n.endswith("_wide")]}


@pytest.mark.parametrize("back", [1, 5, 30])
def test_a_schedule_has_the_rows_that_history_gets_later(spark, tables, back):
    periods = [r[0] for r in tables.matches.select("period").distinct().orderBy("period").collect()]
    last = periods[-back]
    history = G.Folds(tables, tables.matches.filter(F.col("period") == last).select(*X.SPINE))
    known = tables.with_matches(tables.matches.filter(F.col("period") < last))
    schedule = G.Folds(known, history.spine)
    a, b = history.assemble(CHEAP), schedule.assemble(CHEAP)
    assert a.columns == b.columns and a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_teams_without_history(spark, tables):
    """A new team, a spine row that repeats, an empty spine."""
    rows = [("n1", 200101, 990, 991), ("n1", 200101, 990, 991), ("n2", 199001, 1, 2)]
    spine = spark.createDataFrame(rows, "match_id string, period long, home long, away long")
    got = G.Folds(tables, spine).over(spine.distinct()).assemble([n for n in CHEAP if n != "coach_month_record"]).collect()
    assert len(got) == 2
    for r in got:
        assert (r.home_wins, r.home_losses, r.home_won_1, r.home_allowed_1, r.met_1, r.met_ratio) == (0, 0, -1, -1, 0, 0.5)
        assert r.home_scored_1 is None and r.away_for_points is None
    assert G.Folds(tables, spine.limit(0)).assemble(CHEAP).count() == 0


def test_full_predictions(spark):
    got = entry.queries()["upcoming_full_predictions"](spark, SF).collect()
    assert got and all(r.prediction is not None and abs(r.prediction) < 1e4 for r in got)


def test_team_folds_pass_the_spine_once_per_side(spark, tables):
    """State has flat figures and no lists; all team folds share one join per side."""
    f = G.Folds(tables, tables.matches.select(*X.SPINE))
    assert not any(t.startswith("array") for _, t in f("team_state").dtypes)
    plans = [f.assemble(names)._jdf.queryExecution().optimizedPlan().toString() for names in (["last_results"], ["last_results", "all_rankings", "standings_on_spine"])]
    joins = [sum("Join LeftOuter" in line and ("(home#" in line or "(away#" in line) for line in p.splitlines()) for p in plans]
    assert joins == [2, 2]


def test_state_before_a_target_by_one_window(spark):
    """Repeated targets stay, equal periods do not count, null keys and
    periods meet nothing, state without a period is older than all."""
    state = spark.createDataFrame([(1, 10, "a"), (1, 12, "b"), (2, 11, "c"), (None, 9, "d"), (1, None, "e")], "k long, period long, v string")
    rows = [("p", 1, 10), ("q", 1, 11), ("q", 1, 11), ("r", 1, 13), ("s", 2, 12), ("t", 3, 12), ("u", None, 12), ("w", 1, None), (None, 2, 12)]
    targets = spark.createDataFrame(rows, "m string, k long, period long")
    got = H.attach_before(targets, state, ["k"], ["v"])
    want = H.asof(targets, state, ["k"], ["v"]).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert Counter((str(r.m), r.v) for r in got.collect()) == Counter([("p", "e"), ("q", "a"), ("q", "a"), ("r", "b"), ("s", "c"), ("t", None), ("u", None), ("w", None), ("None", "c")])
