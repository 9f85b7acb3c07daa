"""Pair ratings kept by a stream: the state store holds the current ratings.

The stream brings *events* of one or more rating pools: matches, and for the coach
rule the holders of a season, which must arrive with its first period or before.
Each pool is one key of the state store; its state is the last finished period, the
rating of every team seen so far and the holders that have been announced.  A batch
must bring whole periods; what is not newer than the last finished period is a
replay and changes nothing.  A query that is stopped, or fails, goes on from its
checkpoint with the ratings where they were.

One pool is sequential by its nature; pools run in parallel.  The tasks that read the
events pack them: a row for each pool and period of some million events, with the
figures as bytes, so the pool's own task gets few rows and no match by itself.  It holds
the events of one pool in one batch, some 26 bytes a match, and one number per team:
deliver a long history in several batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ratings import KEEP, SEASON_MEAN, START
from tidemark.streaming.incremental import append_new

EVENTS = (
    "pool string, season long, period long, home long, away long, home_points double, away_points double, winner long, "
    "team long, new_holder boolean"
)
RATINGS = "pool string, team long, period long, rating double"
#: Events of one pool and period in one row; the figures stand one after the other.
FIGURES = {"home": "<i8", "away": "<i8", "margin": "<f8", "home_won": "?", "away_won": "?", "team": "<i8", "new_holder": "?"}
PACKED = f"pool string, season long, period long, {', '.join(f'{c} binary' for c in FIGURES)}"
#: Events that are packed at a time.
PACK = 1 << 20


def match_events(matches: DataFrame, pool: Column) -> DataFrame:
    """Matches (season, period, home, away, points, winner) as events of a pool."""
    return matches.select(
        pool.cast("string").alias("pool"),
        *[F.col(c).cast("long").alias(c) for c in ("season", "period", "home", "away")],
        *[F.col(c).cast("double").alias(c) for c in ("home_points", "away_points")],
        F.col("winner").cast("long").alias("winner"),
        F.lit(None).cast("long").alias("team"),
        F.lit(None).cast("boolean").alias("new_holder"),
    )


def holder_events(holders: DataFrame, pool: Column, period: Column) -> DataFrame:
    """Holders (team, season, new_holder) as events; ``period`` is the season's first one."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("home", "long"), ("away", "long"), ("home_points", "double"), ("away_points", "double"), ("winner", "long"))]
    return holders.select(
        pool.cast("string").alias("pool"), F.col("season").cast("long").alias("season"), period.cast("long").alias("period"), *none,
        F.col("team").cast("long").alias("team"), F.coalesce(F.col("new_holder").cast("boolean"), F.lit(False)).alias("new_holder"),
    )


def play_period(rating: np.ndarray, home: np.ndarray, away: np.ndarray, margin: np.ndarray, home_won: np.ndarray, away_won: np.ndarray) -> np.ndarray:
    """Ratings after one period's matches, which all see the ratings before it; sides
    are places in ``rating``."""
    h, a = rating[home], rating[away]
    k = 20 * np.power(margin + 3, 0.8) / (7.5 + 0.006 * np.abs(h - a))
    for side, own, other, won in ((home, h, a, home_won), (away, a, h, away_won)):
        move = k * (won - 1 / (1 + np.power(10.0, (other - own) / 400)))
        rating = rating + np.bincount(side, weights=move, minlength=len(rating))
    return rating


def season_rule(teams: np.ndarray, rating: np.ndarray, new: dict[int, bool] | None) -> np.ndarray:
    """Ratings as a season begins: pulled to the mean, or reset for new holders."""
    if new is not None:
        return np.where(np.isin(teams, [t for t, v in new.items() if v]), START, rating)
    return np.where(rating == START, rating, rating * KEEP + (1 - KEEP) * SEASON_MEAN)


def pack(events: pd.DataFrame) -> pd.DataFrame:
    """Events as rows of ``PACKED``: what a match needs, in few bytes; a draw has no winner."""
    told = events[events["team"].notna()]
    games = events[events["home"].notna() & events["season"].notna() & events["period"].notna()]
    rows: dict[tuple, dict[str, bytes]] = {}
    parts = [
        (told, {"team": told["team"], "new_holder": told["new_holder"].eq(True)}),
        (
            games,
            {
                "home": games["home"],
                "away": games["away"],
                "margin": (games["home_points"] - games["away_points"]).abs(),
                "home_won": games["winner"] == games["home"],
                "away_won": games["winner"] == games["away"],
            },
        ),
    ]
    for part, columns in parts:
        keys = part[["pool", "season", "period"]].reset_index(drop=True)
        values = {c: v.to_numpy(dtype=FIGURES[c]) for c, v in columns.items()}
        places = keys.groupby(list(keys.columns), dropna=False, sort=False).indices.values() if len(keys) else ()
        for at in places:
            key = tuple(None if pd.isna(k) else k for k in keys.iloc[at[0]])
            rows.setdefault(key, {}).update({c: v[at].tobytes() for c, v in values.items()})
    out = pd.DataFrame([(*key, *[row.get(c, b"") for c in FIGURES]) for key, row in rows.items()], columns=["pool", "season", "period", *FIGURES])
    return out.astype({"season": "Int64", "period": "Int64"})


def packed(events: DataFrame) -> DataFrame:
    """A frame of events, packed where it is read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= PACK:
                yield pack(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield pack(pd.concat(held, ignore_index=True))

    return events.mapInPandas(run, PACKED)


def advance_pool(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Ratings going into each new period, for all teams seen up to it; ``frames`` hold
    packed events."""
    known = json.loads(state.get[0]) if state.exists else {"period": None, "season": None, "teams": {}, "holders": None}
    played: dict[tuple[int, int], list[tuple[bytes, ...]]] = {}
    sides = list(FIGURES)[:5]
    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.team:
                told = known["holders"] = known["holders"] or {}
                teams, new = (np.frombuffer(v, FIGURES[c]).tolist() for c, v in (("team", row.team), ("new_holder", row.new_holder)))
                told.setdefault(str(int(row.season)), {}).update(zip(map(str, teams), new))
            if row.home and (known["period"] is None or row.period > known["period"]):
                played.setdefault((int(row.season), int(row.period)), []).append(tuple(getattr(row, c) for c in sides))
    teams = np.array(sorted(map(int, known["teams"])), dtype="int64")
    rating = np.array([known["teams"][str(t)] for t in teams.tolist()], dtype=float)
    for season, period in sorted(played):
        parts = played.pop((season, period))
        home, away, margin, home_won, away_won = (np.frombuffer(b"".join(column), FIGURES[c]) for c, column in zip(sides, zip(*parts)))
        if known["season"] is not None and season != known["season"]:
            new = None
            if known["holders"] is not None:
                new = {int(t): v for t, v in known["holders"].pop(str(season), {}).items()}
            rating = season_rule(teams, rating, new)
        # Teams that play for the first time.
        fresh = np.setdiff1d(pd.unique(np.concatenate([home, away])), teams)
        if len(fresh):
            at = np.searchsorted(teams, fresh)
            teams, rating = np.insert(teams, at, fresh), np.insert(rating, at, START)
        yield pd.DataFrame({"pool": key[0], "team": teams, "period": period, "rating": rating})
        rating = play_period(rating, np.searchsorted(teams, home), np.searchsorted(teams, away), margin, home_won, away_won)
        known["season"], known["period"] = season, period
    known["teams"] = dict(zip(map(str, teams.tolist()), rating.tolist()))
    state.update((json.dumps(known),))


def rated(events: DataFrame) -> DataFrame:
    """The streaming frame of ratings behind a streaming frame of events."""
    return packed(events).groupBy("pool").applyInPandasWithState(advance_pool, RATINGS, "state string", "append", GroupStateTimeout.NoTimeout)


def stream_ratings(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Run the events that have landed below ``source`` and append their ratings.

    Rows that a repeated batch writes again are recognised by (pool, team, period).
    Call it again when more files are there: it goes on from the checkpoint."""

    def step(batch: DataFrame, _: int) -> None:
        batch = batch.persist()  # the append reads it twice, the ratings advance once
        append_new(spark, target, batch, ["pool", "team", "period"], "period")
        batch.unpersist()

    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rated(events).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
