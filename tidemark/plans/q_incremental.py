"""Incremental maintenance and streams, run to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import setops as S
from tidemark.plans.q_state import _COACH_SQL, _SEASON_RULE, _pair_sql, coach_holders
from tidemark.plans.registry import query
from tidemark.plans.testbed import Tables, views
from tidemark.session import stored
from tidemark.sources import files as Fi
from tidemark.streaming import incremental as I
from tidemark.streaming import rating_stream as R
from tidemark.streaming import weekly as W

# Ratings of the teams that have played by then, up to the last period.
_SEEN = """WITH x AS ({rated}) SELECT team, period, rating FROM x JOIN (SELECT team, min(period) AS first FROM (""" + views("sides").replace("{", "{{").replace("}", "}}") + """ SELECT team, period FROM sides) GROUP BY 1) USING (team)
    WHERE period >= first AND period <= (SELECT max(period) FROM (""" + views("matches").replace("{", "{{").replace("}", "}}") + """ SELECT period FROM matches))"""


@query("ST-1 S-2", "SELECT event_id, user_id, event_type, value FROM events")
def streamed_append(t: Tables) -> DataFrame:
    """A file stream with overlapping files appended once per key."""
    events = t.table("events").select("event_id", "user_id", "event_type", "value")
    src, dst = Fi.scratch(t.spark, "stream-in"), Fi.scratch(t.spark, "stream-out")
    # Two overlapping halves: the middle arrives twice.
    mid = events.agg(F.avg("event_id")).scalar()
    for part in (events.filter(F.col("event_id") <= mid * 1.2), events.filter(F.col("event_id") >= mid * 0.8)):
        part.write.mode("append").parquet(src)
    ckpt = Fi.scratch(t.spark, "stream-ckpt")
    I.stream_append(t.spark, src, events.schema, dst, ["event_id"], lambda b: b, ckpt, files_per_batch=1, partition="event_type")
    return t.spark.read.schema(events.schema).parquet(dst)


@query(
    "ST-1 S-3",
    views("outings") + " SELECT player, season, sum(points)::BIGINT AS points FROM outings GROUP BY ALL",
)
def batch_append(t: Tables) -> DataFrame:
    """Derived rows of earlier seasons kept, unseen keys appended."""
    rows = t.outings.groupBy("player", "season").agg(F.sum("points").alias("points"))
    return S.append_unseen(rows.filter("season < 2000"), rows, ["player", "season"])


_SNAPS = """, e AS (SELECT team, season, period, sum((for_points > opp_points)::INT) AS w, sum((for_points < opp_points)::INT) AS l, sum((for_points = opp_points)::INT) AS t,
      sum(for_points) AS points_for, sum(opp_points) AS points_against FROM sides JOIN season_length USING (season) WHERE week <= weeks GROUP BY ALL),
    g AS (SELECT team, season, p.period FROM (SELECT team, season, min(period) AS first FROM e GROUP BY ALL) JOIN (SELECT DISTINCT season, period FROM e) p USING (season) WHERE p.period >= first)
    SELECT team, season, period, """ + ", ".join(
    f"sum(coalesce({c}, 0)) OVER (PARTITION BY team, season ORDER BY period)::BIGINT AS {c}" for c in ("w", "l", "t", "points_for", "points_against")
) + " FROM g LEFT JOIN e USING (team, season, period)"


@query("ST-3 Q-11", views("sides", "season_length") + _SNAPS)
def snapshot_append(t: Tables) -> DataFrame:
    """A table of snapshots advanced twice: inside a season, and over its end.

    Each step reads the stored table and the matches of the new periods only."""
    sides = t.once("matches").sides  # each step reads them
    path = Fi.scratch(t.spark, "snapshots")
    cuts = [0, 199606, 199803, 999999]
    schema = "team bigint, season bigint, period bigint, w bigint, l bigint, t bigint, points_for bigint, points_against bigint"
    stored = t.spark.createDataFrame([], schema)
    for lo, hi in zip(cuts, cuts[1:]):
        new = sides.filter((F.col("period") > lo) & (F.col("period") <= hi))
        I.advance_snapshots(stored, new, t.season_length).write.mode("append").parquet(path)
        stored = t.spark.read.schema(schema).parquet(path)
    return stored


@query(
    "ST-4 ST-5 S-5",
    views("outings") + " SELECT player, season, sum(points)::BIGINT AS points FROM outings GROUP BY ALL",
)
def season_overwrite(t: Tables) -> DataFrame:
    """Weekly run: land, derive, then replace only the season at hand."""
    path = Fi.scratch(t.spark, "season-table")
    rows = t.outings.groupBy("player", "season").agg(F.sum("points").alias("points"))
    stale = rows.withColumn("points", F.when(F.col("season") == 2001, F.lit(0)).otherwise(F.col("points")))
    stale.select("player", "points", "season").write.partitionBy("season").parquet(path)
    I.replace_season(rows.filter("season = 2001").select("player", "points", "season"), path)
    return t.spark.read.schema("player bigint, points bigint, season bigint").parquet(path)


@query("ST-2 Q-1 Q-3", _SEEN.format(rated=_pair_sql(_SEASON_RULE)))
def ratings_streamed(t: Tables) -> DataFrame:
    """Ratings advanced by a stream of periods with the state store, stopped and
    resumed inside a season, one period delivered twice."""
    return _streamed(t)


@query("ST-2 Q-4", _SEEN.format(rated=_COACH_SQL))
def coach_ratings_streamed(t: Tables) -> DataFrame:
    """The same with the holders of each season as events: new ones start again."""
    return _streamed(t, coach_holders)


def _streamed(t: Tables, holders: Callable[[Tables], DataFrame] | None = None) -> DataFrame:
    written, src, dst, ckpt = (Fi.scratch(t.spark, f"rating-{n}") for n in ("events", "in", "out", "ckpt"))
    pool = F.lit("all")
    # Matches are folded once and laid out by season: a delivery reads its own seasons.
    R.match_events(t.matches, pool).write.partitionBy("season").parquet(written)
    games = events = t.spark.read.schema(R.EVENTS).parquet(written)
    calendar = games.groupBy("season").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    if holders is not None:
        told = holders(t.with_matches(games)).join(calendar, "season")
        events = events.unionByName(stored(R.holder_events(told, pool, F.col("first"))))
    spans = [tuple(r) for r in calendar.dropna().orderBy("season").collect()]  # one row per season

    def land(lo: int, hi: int) -> None:
        """Land the periods of a delivery season by season: a batch is one season's part."""
        for season, first, last in spans:
            if first <= hi and last > lo:
                part = events.filter((F.col("season") == season) & (F.col("period") > lo) & (F.col("period") <= hi))
                part.write.mode("append").parquet(src)
                R.stream_ratings(t.spark, src, dst, ckpt, files_per_batch=1 << 30)

    # In the order of their periods: three deliveries, the second one again after the third.
    cuts = [0, 199406, 199706, 999999]
    for lo, hi in [*zip(cuts, cuts[1:]), (cuts[1], cuts[2])]:
        land(lo, hi)
    out = t.spark.read.schema(R.RATINGS).parquet(dst)
    return out.select("team", "period", F.round("rating", 4).alias("rating"))


@query(
    "ST-4 IO-1 IO-14 J-1",
    views("outings") + " SELECT player, season, any_value(position) AS position, count(*) AS games, sum(points)::BIGINT AS points FROM outings GROUP BY player, season",
)
def weekly_refresh(t: Tables) -> DataFrame:
    """Two landings through three stages; the second run breaks once and resumes."""
    root = Fi.scratch(t.spark, "weekly")
    rows = t.outings.select("match_id", "player", "season", "position", "points")
    fields = "match_id bigint, player bigint, season bigint, position string, points bigint"
    landed = f"{root}/landed"
    broken = [False, True, False]
    ran = []
    for delivery, breaks in (("season < 1996", broken[0]), ("season >= 1996", broken[1]), (None, broken[2])):
        if delivery is not None:
            rows.filter(delivery).write.mode("append").option("header", True).csv(landed)
        driver = W.Weekly(t.spark, root)

        def totals(converted: DataFrame, players: DataFrame, breaks: bool = breaks) -> DataFrame:
            if breaks:
                raise RuntimeError("broken on purpose")
            sums = converted.groupBy("player", "season").agg(F.count(F.lit(1)).alias("games"), F.sum("points").alias("points"))
            return sums.join(players, "player").select("player", "season", "position", "games", "points")

        try:
            driver.stage("converted", lambda: Fi.read_csv(t.spark, landed, fields), inputs=[landed])
            driver.stage("players", lambda c: c.groupBy("player").agg(F.min("position").alias("position")), after=["converted"])
            driver.stage("totals", totals, after=["converted", "players"])
        except RuntimeError:
            if not breaks:
                raise
        ran.append(driver.ran)
    # The third run found the first two stages done.
    if ran[2] != ["totals"]:
        raise RuntimeError(f"stages ran again: {ran}")
    return driver.table("totals")
