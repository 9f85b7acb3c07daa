"""Incremental tables: null keys, resumed ratings, stream state, snapshots, weekly driver."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import setops as S
from tidemark.operators.ratings import pair_ratings
from tidemark.operators.sides import sides
from tidemark.streaming import incremental as I
from tidemark.streaming import rating_stream as R
from tidemark.streaming.weekly import Weekly


def test_null_keys_are_keys(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a", 5), (None, "a", 6), (None, None, 7)], "k int, j string, v int")
    path = str(tmp_path / "t")
    for _ in range(3):
        I.append_new(spark, path, batch, ["k", "j"])
    assert spark.read.parquet(path).count() == 3
    for _ in range(2):
        I.append_new(spark, str(tmp_path / "p"), batch, ["k", "j"], partition="j")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    stored = spark.createDataFrame([(1, "a", 0), (None, None, 0), (9, None, 0)], "k int, j string, v int")
    got = S.replace_keys(stored, batch, ["k", "j"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", 5), (None, "a", 6), (None, None, 7), (9, None, 0)], key=str)
    assert S.unseen(batch, batch, ["k", "j"]).count() == 0


def games(seed=3, teams=6, seasons=3, weeks=4):
    rng, rows = random.Random(seed), []
    for s in range(2000, 2000 + seasons):
        for w in range(1, weeks + 1):
            for _ in range(rng.randint(1, 4)):
                h, a = rng.sample(range(1, teams + 1 + (s > 2000)), 2)
                x, y = rng.randint(0, 40), rng.randint(0, 40)
                rows.append((s, s * 100 + w, h, a, x, y, None if x == y else (h if x > y else a)))
    return rows


SCHEMA = "season long, period long, home long, away long, home_points long, away_points long, winner long"


@pytest.fixture(scope="module")
def matches(spark):
    return spark.createDataFrame(games(), SCHEMA).cache()


@pytest.fixture(scope="module")
def holders(spark):
    return spark.createDataFrame([(t, s, (t + s) % 2) for t in range(1, 8) for s in (2000, 2001, 2002)], "team long, season long, new_holder int")


def as_dict(df):
    return {(r.team, r.period): r.rating for r in df.collect()}


@pytest.mark.parametrize("rule", ["team", "coach"])
@pytest.mark.parametrize("upto", [None, 200102, 200104])
def test_ratings_advance(spark, matches, holders, rule, upto):
    held = holders if rule == "coach" else None
    full = as_dict(pair_ratings(matches, holders=held))
    if upto is None:
        stored = spark.createDataFrame([], "team bigint, period bigint, rating double")
    else:
        stored = pair_ratings(matches.filter(F.col("period") <= upto), holders=held)
    got = as_dict(I.advance_ratings(stored, matches, held))
    # A team that first plays later has no rating in the stored part.
    assert set(got) <= set(full) and all(math.isclose(got[k], full[k], abs_tol=1e-9) for k in got)
    assert {k for k in full if k[1] > (upto or 0)} <= set(got)
    if upto:
        again = I.advance_ratings(pair_ratings(matches, holders=held), matches, held)
        assert as_dict(again) == pytest.approx(full)


@pytest.mark.parametrize("rule", ["team", "coach"])
def test_stream_resumes_and_ignores_replays(spark, matches, holders, rule, tmp_path):
    held = holders if rule == "coach" else None
    full, first = as_dict(pair_ratings(matches, holders=held)), {}
    for r in matches.collect():
        for t in (r.home, r.away):
            first[t] = min(first.get(t, r.period), r.period)
    last = max(p for _, p in full) - 1
    events = R.match_events(matches, F.lit("p")).unionByName(R.match_events(matches, F.lit("q")))
    if held is not None:
        start = matches.groupBy("season").agg(F.min("period").alias("first"))
        for pool in "pq":
            events = events.unionByName(R.holder_events(held.join(start, "season"), F.lit(pool), F.col("first")))
    src, dst, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for lo, hi in ((0, 200003), (200003, 200101), (200101, 200203), (200003, 200101), (200203, 999999)):
        events.filter((F.col("period") > lo) & (F.col("period") <= hi)).coalesce(1).write.mode("append").parquet(src)
        R.stream_ratings(spark, src, dst, ckpt)  # each call goes on from the checkpoint
    out = spark.read.schema(R.RATINGS).parquet(dst)
    want = {k: v for k, v in full.items() if first[k[0]] <= k[1] <= last}
    for pool in "pq":
        assert as_dict(out.filter(F.col("pool") == pool)) == pytest.approx(want, abs=1e-9)
    assert out.count() == 2 * len(want)


def test_snapshots_from_an_older_table(spark, matches):
    rows = sides(matches.withColumns({"match_id": F.monotonically_increasing_id(), "week": F.col("period") % 100}), ["points"])
    weeks = spark.createDataFrame([(s, 3) for s in (2000, 2001, 2002)], "season long, weeks long")
    schema = "team long, season long, period long, w long, l long, t long, points_for long, points_against long"
    empty = spark.createDataFrame([], schema)
    full = I.advance_snapshots(empty, rows, weeks)
    want = sorted(map(tuple, full.collect()))
    assert want and all(p % 100 <= 3 for _, _, p, *_ in want)
    stored, periods = empty, sorted({r.period for r in matches.collect()})
    for p in periods:  # one period at a time, nothing older is given
        stored = spark.createDataFrame(stored.unionByName(I.advance_snapshots(stored, rows.filter(F.col("period") == p), weeks)).collect(), schema)
    assert sorted(map(tuple, stored.collect())) == want
    wins = {}
    for r in matches.orderBy("period").collect():
        if r.period % 100 <= 3:
            for t in (r.home, r.away):
                wins[t, r.season] = wins.get((t, r.season), 0) + (r.winner == t)
    last = {}
    for t, s, p, w, *_ in want:
        last[t, s] = (p, w)
    assert {k: w for k, (_, w) in last.items()} == wins


def test_weekly_driver_skips_resumes_and_swaps(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "root")
    spark.range(5).write.parquet(landed)
    state = {"break": False}

    def double(a):
        if state["break"]:
            raise RuntimeError("broken")
        return a.select((F.col("id") * 2).alias("id"))

    def run(version="1"):
        w = Weekly(spark, root)
        try:
            w.stage("a", lambda: spark.read.parquet(landed), inputs=[landed])
            w.stage("b", double, after=["a"], version=version)
            w.stage("c", lambda b: b.agg(F.sum("id").alias("s")), after=["b"])
        except RuntimeError:
            pass
        return w

    assert run().ran == ["a", "b", "c"] and run().ran == []
    spark.range(5, 8).write.mode("append").parquet(landed)
    state["break"] = True
    w = run()
    assert w.ran == ["a"] and w.table("c").first().s == 20  # the old table stays whole
    state["break"] = False
    w = run()
    assert w.ran == ["b", "c"] and w.table("c").first().s == 56
    assert run("2").ran == ["b", "c"]
    with pytest.raises(ValueError):
        Weekly(spark, root).stage("x", lambda y: y, after=["y"])
    assert Weekly(spark, root).entry("nothing") is None


def test_streamed_ratings_land_season_by_season(spark, matches, monkeypatch):
    from tidemark.plans import q_incremental as Q

    seen, batches = set(), []

    def recorded(spark_, source, target, checkpoint, files_per_batch=1):
        rows = {(r._metadata.file_path, r.season) for r in spark_.read.parquet(source).select("season", "_metadata").collect()}
        batches.append({s for path, s in rows if path not in seen})
        seen.update(path for path, _ in rows)
        spark_.createDataFrame([], R.RATINGS).write.mode("append").parquet(target)

    monkeypatch.setattr(R, "stream_ratings", recorded)
    old = matches.withColumns({c: F.col(c) - d for c, d in (("season", 6), ("period", 600))})
    t = Q.Tables(spark, "/nowhere")
    t.matches = old
    assert Q._streamed(t, None).count() == 0
    # 1994 to 1996; all of it is delivered, and what follows 199406 up to 199706 again.
    assert batches == [{1994}, {1995}, {1996}, {1995}, {1996}]
