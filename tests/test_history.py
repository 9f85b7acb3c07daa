"""Golden and metamorphic tests of histories, ranks and scans."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import history as H
from tidemark.operators.ranking import carry_forward, ranked, ranked_many, season_grid
from tidemark.operators.scan import Fill, Lag, Lead, RowNumber, RunningMax, RunningSum, chunked_scan


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_last_results_newest_first_padded(spark):
    h = spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 2, 1)], "team string, period long, match_id long, won int")
    state = H.last_n_rows(h, ["team"], {"won": F.col("won")}, 4)
    t = spark.createDataFrame([("a", 3)], "team string, period long")
    out = H.asof(t, state, ["team"], ["recent"]).select(*H.slots(F.col("recent"), 4, "w", F.lit(-1), "won"))
    assert rows(out, "w_1") == [(1, 0, -1, -1)]


def test_same_period_rows_do_not_see_each_other(spark):
    h = spark.createDataFrame([("a", 1, 1, 4.0), ("a", 2, 2, 8.0), ("a", 2, 3, 10.0)], "team string, period long, match_id long, x double")
    state = H.last_n_means(h, ["team"], {"x": F.col("x")}, 5)
    out = H.asof(h.select("team", "period", "match_id"), state, ["team"], ["x"], in_history=True)
    assert rows(out.select("match_id", "x"), "match_id") == [(1, None), (2, 4.0), (3, 4.0)]


def test_nulls_skipped_or_zero(spark):
    h = spark.createDataFrame([("a", 1, 1, 4.0), ("a", 2, 2, None), ("a", 3, 3, 8.0)], "team string, period long, match_id long, x double")
    for zero, want in ((True, 4.0), (False, 6.0)):
        state = H.last_n_means(h, ["team"], {"x": F.col("x")}, 5, null_as_zero=zero)
        out = H.resolve(spark.createDataFrame([("a", 9)], "team string, period long"), state, ["team"], ["x"])
        assert rows(out, "team")[0][2] == want


def test_head_to_head(spark):
    m = spark.createDataFrame([(1, 1, "a", "b", "a")], "match_id long, period long, home string, away string, winner string")
    met = m.select("match_id", "period", "winner", *H.unordered_pair("home", "away"))
    state = H.last_n_rows(met, ["lo", "hi"], {"winner": F.col("winner")}, 3)
    t = spark.createDataFrame([(5, "b", "a")], "period long, home string, away string").select("period", "home", "away", *H.unordered_pair("home", "away"))
    out = H.asof(t, state, ["lo", "hi"], ["recent"])
    won = F.transform("recent", lambda r: (r["winner"] == F.col("away")).cast("int"))
    assert rows(out.select(*H.slots(won, 3, "m", F.lit(0))), "m_1") == [(1, 0, 0)]


def test_season_mean_needs_two_games_and_falls_back(spark):
    h = spark.createDataFrame(
        [("p", 2000, 5, 200005, 10.0), ("p", 2000, 6, 200006, 20.0), ("p", 2001, 1, 200101, 99.0), ("p", 2001, 2, 200102, 1.0), ("p", 2001, 3, 200103, 3.0)],
        "player string, season long, week long, period long, x double",
    )
    out = H.season_means(h.drop("x"), h, ["player"], {"m": F.col("x")}, min_count=2)
    assert rows(out.select("period", "m"), "period") == [(200005, None), (200006, None), (200101, 15.0), (200102, None), (200103, 50.0)]


def test_exact_match_preferred_else_last_known(spark):
    s = spark.createDataFrame([("a", 1, 10), ("a", 3, 30)], "team string, period long, v int")
    t = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 9)], "team string, period long")
    assert [r[2] for r in rows(H.resolve(t, s, ["team"], ["v"], strict=False), "period")] == [10, 10, 30, 30]
    assert [r[2] for r in rows(H.resolve(t, s, ["team"], ["v"]), "period")] == [None, 10, 10, 30]


def history(spark, seed=3, n=400):
    rnd = random.Random(seed)
    data = [(i, rnd.choice("aaaaabcd"), 200001 + rnd.randrange(12), float(rnd.randrange(50))) for i in range(n)]
    return data, spark.createDataFrame(data, "match_id long, team string, period long, x double")


def test_last_n_against_brute_force_with_a_hot_team(spark):
    data, h = history(spark)
    state = H.last_n_means(h, ["team"], {"x": F.col("x")}, 7)
    got = {(r.team, r.period): r.x for r in H.before(state, ["team"], ["x"]).collect()}
    for team, period in got:
        earlier = sorted((p, i, x) for i, t, p, x in data if t == team and p < period)[-7:]
        want = sum(x for _, _, x in earlier) / len(earlier) if earlier else None
        assert got[team, period] == (pytest.approx(want) if want is not None else None)


def test_row_order_does_not_matter(spark):
    data, h = history(spark)
    random.Random(1).shuffle(data)
    again = spark.createDataFrame(data, h.schema)
    a, b = (H.last_n_rows(d, ["team"], {"x": F.col("x")}, 5) for d in (h, again))
    assert rows(a, "team", "period") == rows(b, "team", "period")


def test_training_and_scoring_agree(spark):
    _, h = history(spark)
    last = h.agg(F.max("period")).first()[0]
    train = H.asof(h, H.last_n_means(h, ["team"], {"m": F.col("x")}, 5), ["team"], ["m"], in_history=True).filter(F.col("period") == last)
    past = h.filter(F.col("period") < last)
    scoring = H.asof(h.filter(F.col("period") == last), H.last_n_means(past, ["team"], {"m": F.col("x")}, 5), ["team"], ["m"])
    assert rows(train.select("match_id", "m"), "match_id") == rows(scoring.select("match_id", "m"), "match_id")


def test_mean_fill(spark):
    d = spark.createDataFrame([(1, 4.0), (2, None), (3, 8.0)], "k int, x double")
    assert rows(H.fill_with_mean(d, ["x"], 0.5), "k") == [(1, 4.0), (2, 3.0), (3, 8.0)]


def test_role_means_equal_means_of_the_join(spark):
    from tidemark.operators.sides import attach_both

    m = spark.createDataFrame([(1, "a", "b"), (1, "c", "a"), (2, "a", "c"), (2, "b", "d")], "period long, home string, away string")
    k = spark.createDataFrame([("a", 1, 5.0), ("b", 1, None), ("a", 2, 7.0), ("c", 2, 1.0), ("b", 2, 2.0)], "team string, period long, v double")
    direct = attach_both(m, k, ["v"]).agg(F.avg("home_v"), F.avg("away_v")).first()
    assert tuple(H.role_means(m, k, ["v"]).first()) == tuple(direct)


@pytest.mark.parametrize("width", [3, 50, 1000])
def test_chunked_scan_equals_window_on_one_hot_group(spark, width):
    rnd = random.Random(width)
    data = [("hot" if rnd.random() < 0.7 else rnd.choice("xyz"), i, rnd.randrange(40), rnd.choice([None, 1, 2, 3])) for i in range(600)]
    d = spark.createDataFrame(data, "g string, num long, v long, s int")
    w = Window.partitionBy("g").orderBy("num")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    want = d.select(
        "*", F.row_number().over(w).alias("rn"), F.lag("s").over(w).alias("lag"), F.lead("s").over(w).alias("lead"),
        F.last("s", ignorenulls=True).over(run).alias("fill"), F.sum("v").over(run).alias("sum"), F.sum("v").over(prior).alias("before"), F.max("v").over(run).alias("max"),
    )
    got = chunked_scan(
        d, ["g"], F.floor(F.col("num") / width), ["num"],
        [RowNumber("rn"), Lag("lag", "s"), Lead("lead", "s"), Fill("fill", "s"), RunningSum("sum", "v"), RunningSum("before", "v", False), RunningMax("max", "v")],
    )
    assert rows(got, "num") == rows(want, "num")


def test_chunked_ranks_equal_window_ranks(spark):
    rnd = random.Random(9)
    d = spark.createDataFrame([("g" if rnd.random() < 0.8 else "h", i, rnd.randrange(-30, 30)) for i in range(500)], "g string, id long, v long")
    for desc in (True, False):
        key = F.col("v").desc() if desc else F.col("v")
        w = Window.partitionBy("g").orderBy(key)
        want = d.select("id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.row_number().over(w.orderBy(key, "id")).alias("n"))
        got = ranked(d, ["g"], "v", "r", "rank", descending=desc, width=4)
        got = ranked(got, ["g"], "v", "d", "dense_rank", descending=desc)
        got = ranked(got.withColumn("v", F.col("v").cast("double")), ["g"], "v", "n", tiebreak=["id"], descending=desc).select("id", "r", "d", "n")
        assert rows(got, "id") == rows(want, "id")


def test_rank_bases_and_ties(spark):
    d = spark.createDataFrame([(1, 300), (2, 300), (3, 250)], "id int, v int").withColumn("g", F.lit(1))
    assert [r.rank for r in ranked(d, ["g"], "v", method="rank").orderBy("id").collect()] == [1, 1, 3]
    assert [r.rank for r in ranked(d, ["g"], "v", tiebreak=["id"], base=0).orderBy("id").collect()] == [0, 1, 2]


def test_ranked_many_keeps_values(spark):
    d = spark.createDataFrame([(1, "a", 5.0, 1.0), (1, "b", 7.0, 0.0)], "period int, team string, x double, y double")
    out = ranked_many(d, ["period"], ["team"], {"x": True, "y": False})
    assert rows(out.select("team", "x", "y", "x_rank", "y_rank"), "team") == [("a", 5.0, 1.0, 2, 2), ("b", 7.0, 0.0, 1, 1)]


def test_idle_entities_are_carried(spark):
    v = spark.createDataFrame([(1, "a", 1, 10), (1, "b", 1, 20), (1, "a", 2, 11), (1, "b", 3, 21)], "season int, team string, period int, v int")
    out = carry_forward(v, ["team"], ["v"])
    assert rows(out.select("team", "period", "v"), "team", "period") == [("a", 1, 10), ("a", 2, 11), ("a", 3, 11), ("b", 1, 20), ("b", 2, 20), ("b", 3, 21)]
    assert season_grid(v, ["team"]).count() == 6


def test_shares_modes_and_first_seen(spark):
    d = spark.createDataFrame([("m", 30), ("m", 10), ("n", 7), ("z", 0), ("z", 0)], "g string, v int")
    assert [r[2] for r in rows(A.shares(d, ["g"], "v").select("g", "v", "share"), "g", "v")] == [0.25, 0.75, 1.0, None, None]
    l = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "pos int, v string").withColumn("g", F.lit(1))
    assert A.mode_by(l, ["g"], "v", "m").first()["m"] == "a"
    assert A.latest_first_seen(l, ["g"], "v", "pos", "m").first()["m"] == "b"


def test_wide_drops_sparse_columns(spark):
    d = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (1, "y", 3)], "k int, c string, v int")
    assert A.wide(d, ["k"], "c", "v", ["x", "y"], max_null=0.1).columns == ["k", "x"]


def test_null_groups_and_chunks_rank_like_any_other(spark):
    d = spark.createDataFrame([(None, 5, 1), (None, 7, 2), (1, 9, 3), (1, None, 4)], "g int, v int, id int")
    got = {r.id: r.rank for r in ranked(d, ["g"], "v", method="rank", width=1).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: None}
    got = {r.id: r.rank for r in ranked(d, ["g"], "v", method="row_number", tiebreak=["id"], width=1).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: None}
