"""Steps whose work must not grow faster than their input: plans and whole results."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import history as H
from tidemark.operators import models as M
from tidemark.operators.folds import Folds
from tidemark.operators.ratings import pair_ratings
from tidemark.operators.scan import RunningSum, chunked_scan
from tidemark.plans import q_assemblies
from tidemark.plans.testbed import Tables
from tidemark.session import stored
from tidemark.streaming import rating_stream as R
from tidemark.streaming.incremental import advance_snapshots, append_new

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_worked_out_once(spark):
    text = entry.queries()["name_spans"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") + text.count("RegExpExtractAll") == 1


def test_scan_keys_are_plain_columns(spark):
    rows = [(g, p, m, v) for g in ("x", None, "") for p in (1, 2, None, 7) for m, v in ((1, 4), (2, None), (3, 5))]
    df = spark.createDataFrame(rows, "g string, p bigint, m bigint, v bigint")
    out = chunked_scan(df, ["g"], F.col("p"), ["p", "m"], [RunningSum("s", "v")])
    assert "named_struct" not in plan(out)
    run = Window.partitionBy("g").orderBy("p", "m").rowsBetween(Window.unboundedPreceding, 0)
    assert sorted(map(str, out.collect())) == sorted(map(str, df.withColumn("s", F.sum("v").over(run)).collect()))


def test_season_means_shuffle_targets_once(spark):
    rows = [(1, 10, 1, 101, 4), (2, 10, 1, 102, 6), (3, 10, 2, 201, 8), (4, 10, 2, 202, 9), (5, 10, 2, None, 1), (6, None, 2, 202, 3)]
    df = spark.createDataFrame(rows, "id bigint, team bigint, season bigint, period bigint, v bigint")
    out = H.season_means(df.select("id", "team", "season", "period"), df, ["team"], {"m": F.col("v")}, previous_season="missing", in_history=True)
    # A row without a period counts as earlier than all others, and knows the last season only.
    assert {r.id: r.m for r in out.collect()} == {1: None, 2: 4.0, 3: 1.0, 4: 4.5, 5: 5.0, 6: None}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    # The second join is not on the targets' (left) side of the first one.
    assert len(joins) == 2 and ":" not in joins[1].split("Join")[0]


def test_last_rows_gather_no_lists(spark):
    rows = [(1, p, m, p * 10 + m) for p in (1, 2, 4) for m in (1, 2, 3)] + [(2, 1, 1, None), (2, 3, 1, 7)]
    df = spark.createDataFrame(rows, "team bigint, period bigint, match_id bigint, v bigint")
    out = H.last_n_rows(df, ["team"], {"v": F.col("v")}, 4)
    assert "collect_list" not in plan(out)
    got = {(r.team, r.period): [x.v for x in r.recent] for r in out.collect()}
    assert got == {(1, 1): [13, 12, 11], (1, 2): [23, 22, 21, 13], (1, 4): [43, 42, 41, 23], (2, 1): [None], (2, 3): [7, None]}


def test_ratings_compute_their_matches_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(1, 100 + w, a, a % 5 + 1, a * w, 3, a) for w in (1, 2, 3) for a in range(1, 6)]
    schema = "season bigint, period bigint, home bigint, away bigint, home_points bigint, away_points bigint, winner bigint"
    df = spark.createDataFrame(rows, schema).mapInArrow(run, schema)
    assert pair_ratings(df).count() == 5 * 4
    assert seen.value == len(rows)


def test_snapshots_are_not_shuffled_by_season(spark):
    rows = [(1, t, s, s * 100 + w, t, 2) for s in (1, 2) for w in (1, 2, 3) for t in (1, 2, 3)]
    side = spark.createDataFrame(rows, "m bigint, team bigint, season bigint, period bigint, for_points bigint, opp_points bigint")
    kept = spark.createDataFrame([], "team bigint, season bigint, period bigint, w bigint, l bigint, t bigint, points_for bigint, points_against bigint")
    lengths = spark.createDataFrame([(1, 2), (2, 2)], "season bigint, weeks bigint")
    out = advance_snapshots(kept, side, lengths)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text
    assert {(r.team, r.period): (r.w, r.l, r.t, r.points_for) for r in out.collect() if r.season == 2} == {
        (1, 201): (0, 1, 0, 1), (1, 202): (0, 2, 0, 2), (2, 201): (0, 0, 1, 2), (2, 202): (0, 0, 2, 4), (3, 201): (1, 0, 0, 3), (3, 202): (2, 0, 0, 6),
    }


def test_views_are_written_once(spark):
    t = Tables(spark, SF).once("matches", "outings")
    again = t.once("matches")
    assert again.matches is t.matches and again.outings is t.outings
    assert sorted(t.matches.collect()) == sorted(Tables(spark, SF).matches.collect())


def test_streamed_events_reach_their_pool_packed(spark):
    """A pool's task gets a row per period and reading task, not one per match."""
    rows = [(1999, 199900 + p, h, h % 7 + 8, 3, h % 5, h if h % 2 else None) for p in (1, 2) for h in range(500)]
    matches = spark.createDataFrame(rows, "season long, period long, home long, away long, home_points long, away_points long, winner long")
    told = spark.createDataFrame([(h, 1999, h % 2) for h in range(300)], "team long, season long, new_holder int")
    events = R.match_events(matches, F.lit("p")).unionByName(R.holder_events(told, F.lit("p"), F.lit(199901)))
    got = R.packed(events.orderBy(F.xxhash64("home", "team")).coalesce(2)).collect()
    assert len(got) <= 4 and sum(len(r.home) for r in got) == 8 * 1000 and sum(len(r.team) for r in got) == 8 * 300
    assert sum(sum(r.home_won) for r in got) == 500 and sum(sum(r.new_holder) for r in got) == 150
    assert {r.period for r in got if r.home} == {199901, 199902}
    teams = {t: new for r in got for t, new in zip(np.frombuffer(r.team, "<i8").tolist(), r.new_holder)}
    assert teams == {h: h % 2 for h in range(300)}


def test_appended_partitions_get_few_files(spark, tmp_path):
    batch = spark.range(4000).select("id", (F.col("id") % 2).alias("p")).repartition(40)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for _ in range(2):
            append_new(spark, str(tmp_path / "t"), batch, ["id"], "p")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000
    assert len(list((tmp_path / "t" / "p=1").glob("*.parquet"))) <= 16


def test_a_fit_in_one_pass_keeps_no_rows(spark, monkeypatch):
    rows = spark.range(50).select((F.col("id") % 7).alias("a"), (F.col("id") * 2 + F.col("id") % 7).alias("y"))
    kept, persist = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda df, *level: kept.append(df.columns) or persist(df, *level))
    M.fit(rows, ["a"], "y", M.regressor())
    assert not kept
    M.fit(rows.withColumn("y", F.col("y") % 2), ["a"], "y", M.classifier())
    assert len(kept) == 1


def test_wide_rows_are_not_written_for_their_means(spark, monkeypatch):
    written = []
    monkeypatch.setattr(q_assemblies, "stored", lambda df: written.append(df.columns) or stored(df))
    for name in ("match_table", "match_full_table"):
        out = entry.queries()[name](spark, SF)
        assert "match_id" in out.columns
    assert written and not any("match_id" in columns for columns in written)


def test_all_team_columns_share_the_sides_joins(spark):
    """Frames by team and by match join with the folds: the spine meets each side once."""
    t = Tables(spark, SF).once("matches")
    folds = Folds(t, t.matches.select("match_id", "period", "home", "away"))
    folds.done["matches"] = t.matches
    teams = t.sides.groupBy("team", "period").agg(F.sum("for_points").alias("scored"))
    more = t.matches.select("match_id", F.col("home_yards").alias("gained"))
    out = folds.assemble(["last_results"], [more], teams)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftOuter") == 3 and out.columns[-3:] == ["gained", "home_scored", "away_scored"]
    plain = {(r.team, r.period): r.scored for r in teams.collect()}
    got = out.select("period", "home", "away", "home_scored", "away_scored").collect()
    assert got and all(r.home_scored == plain[r.home, r.period] and r.away_scored == plain[r.away, r.period] for r in got)
