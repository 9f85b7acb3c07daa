"""Ratings: pairwise recursion in period supersteps, player ratings in closed form."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

# Fixed values of the rating rule.
START = 1500.0
SEASON_MEAN = 1505.0
KEEP = 0.75
PLAYER_START = 100.0
#: Files of a period's matches.
FILES = 8


def k_factor(margin: Column, gap: Column) -> Column:
    return F.pow(margin + 3, F.lit(0.8)) * 20 / (gap * 0.006 + 7.5)


def expectation(own: Column, other: Column) -> Column:
    return 1 / (F.pow(F.lit(10.0), (other - own) / 400) + 1)


def season_start(rating: Column, new_holder: Column | None = None) -> Column:
    """Rating at a new season: pulled to the mean, a start rating stays.

    With ``new_holder`` (coach ratings) a new holder starts again and an old
    one keeps the rating.
    """
    if new_holder is not None:
        return F.when(new_holder, START).otherwise(rating)
    return F.when(rating == START, rating).otherwise(rating * KEEP + (1 - KEEP) * SEASON_MEAN)


def rating_change(own: Column, other: Column, own_points: Column, other_points: Column, won: Column) -> Column:
    """Change of one side's rating by one match; a draw counts as not won."""
    k = k_factor(F.abs(own_points - other_points), F.abs(own - other))
    return k * (won.cast("int") - expectation(own, other))


def pair_ratings(
    matches: DataFrame,
    start: DataFrame | None = None,
    holders: DataFrame | None = None,
    start_season: int | None = None,
) -> DataFrame:
    """Ratings *going into* each period for every team, and after the last one.

    ``matches``: season, period, home, away, home_points, away_points, winner.
    One superstep per period of the calendar: the period's matches join the
    current ratings, changes are summed per team, and the new ratings (one row
    per team) are written to a table in the shared checkpoint folder, which
    cuts the lineage and survives lost executors.  Matches are laid out by
    period first, so a superstep reads its own slice only.  Several matches of
    a team in one period all see the rating before the period.

    The state after the last period is labelled as the next period of the same
    season.  The season rule is applied when the first period of a new season
    comes up, so a state that ends inside or at the end of a season can be
    resumed alike: ``start`` (team, rating) is the state to begin with and
    ``start_season`` the season it belongs to.  ``holders`` (team, season,
    new_holder) switches the season rule for coaches.  The calendar is the only
    thing collected: one row per period.  Without matches the result is empty.
    """
    spark = matches.sparkSession
    base = f"{checkpoint_dir(spark)}/pair-ratings-{uuid.uuid4().hex}"
    cols = ["home", "away", "home_points", "away_points", "winner"]
    # The matches are computed once: the calendar is read from what is laid out.  A period
    # is dealt to a few tasks by its home teams, so no task and no file holds all of it.
    laid_out = matches.select("season", "period", *cols)
    dealt = F.pmod(F.xxhash64("home"), F.lit(FILES))
    laid_out.repartition("period", dealt).write.partitionBy("period").parquet(f"{base}/matches")
    games = spark.read.schema(laid_out.schema).parquet(f"{base}/matches")
    calendar = [tuple(r) for r in games.select("period", "season").distinct().orderBy("period").collect()]
    if not calendar:
        return spark.createDataFrame([], "team bigint, period bigint, rating double")
    game_schema = games.select("season", *cols).schema
    periods = [c[0] for c in calendar] + [calendar[-1][0] + 1]

    def store(ratings: DataFrame, period: int) -> DataFrame:
        path = f"{base}/ratings/period={period}"
        ratings.select("team", "rating").write.parquet(path)
        return spark.read.schema("team bigint, rating double").parquet(path)

    def new_season(ratings: DataFrame, season: int) -> DataFrame:
        """The season rule, as ``season`` begins."""
        if holders is None:
            return ratings.select("team", season_start(F.col("rating")).alias("rating"))
        new = holders.filter(F.col("season") == season).select("team", "new_holder")
        fresh = F.coalesce(F.col("new_holder") == 1, F.lit(False))
        return ratings.join(new, "team", "left").select("team", season_start(F.col("rating"), fresh).alias("rating"))

    teams = games.select(F.explode(F.array("home", "away")).alias("team")).distinct()
    first = teams.withColumn("rating", F.lit(START))
    if start is not None:
        # Teams that sit out from here on keep their rating.
        teams = teams.unionByName(start.select("team")).distinct()
        first = teams.join(start, "team", "left").select("team", F.coalesce("rating", F.lit(START)).alias("rating"))
        if start_season is not None and start_season != calendar[0][1]:
            first = new_season(first, calendar[0][1])
    current = store(first, periods[0])

    for i, (period, season) in enumerate(calendar):
        after_season = calendar[i + 1][1] if i + 1 < len(calendar) else season
        played = spark.read.schema(game_schema).parquet(f"{base}/matches/period={period}")
        both = played.join(current.select(F.col("team").alias("home"), F.col("rating").alias("hr")), "home").join(
            current.select(F.col("team").alias("away"), F.col("rating").alias("ar")), "away"
        )
        h, a, hp, ap = (F.col(c) for c in ("hr", "ar", "home_points", "away_points"))

        def move(side: str, own: Column, other: Column, own_points: Column, other_points: Column) -> Column:
            won = F.coalesce(F.col("winner") == F.col(side), F.lit(False))
            return F.struct(F.col(side).alias("team"), rating_change(own, other, own_points, other_points, won).alias("rating"))

        moves = both.select(F.inline(F.array(move("home", h, a, hp, ap), move("away", a, h, ap, hp))))
        # Old rating plus all changes is one sum per team.
        updated = current.unionByName(moves).groupBy("team").agg(F.sum("rating").alias("rating"))
        if after_season != season:
            updated = new_season(updated, after_season)
        current = store(updated, periods[i + 1])
    return spark.read.schema("team bigint, rating double, period bigint").parquet(f"{base}/ratings").select("team", "period", "rating")


# --- players --------------------------------------------------------------


def passer_grade(grade: Column, mean: Column, total_mean: Column) -> Column:
    """Below the own mean a point is taken off; half as much again around the mean, plus its lead over all."""
    lowered = F.when(grade < mean, grade - 1).otherwise(grade)
    return (lowered - mean) * 1.5 + (mean - total_mean)


def graded(grades: DataFrame, passer: bool, mean: str = "to_date") -> DataFrame:
    """Add ``gain`` to (player, season, period, grade) rows.

    ``mean="season"`` compares with the whole season, later periods
    included; ``"to_date"`` with the season up to the period.
    """
    if not passer:
        return grades.withColumn("gain", F.col("grade").cast("double"))
    w = Window.partitionBy("player", "season")
    if mean == "to_date":
        w = w.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    total = grades.agg(F.avg("grade").alias("m")).scalar()
    out = grades.withColumn("_m", F.avg("grade").over(w))
    return out.withColumn("gain", passer_grade(F.col("grade"), F.col("_m"), total)).drop("_m")


def player_ratings(gains: DataFrame, keep: float = 0.1, elapsed: str = "calendar") -> DataFrame:
    """Rating after each period in closed form.

    A season's gains add up; at each season change the distance from 100 is
    multiplied by ``keep`` (0.1 for passers, 0 for others).  Rating = 100 +
    gains so far this season + sum over earlier seasons of their gains times
    ``keep`` to the number of season changes since.  ``elapsed`` counts
    changes by ``calendar`` years or by the player's own ``played`` seasons.
    """
    seasons = gains.groupBy("player", "season").agg(F.sum("gain").alias("_s"))
    w = Window.partitionBy("player").orderBy("season")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    if elapsed == "played":
        index = F.row_number().over(w)
    else:
        index = F.col("season") - F.min("season").over(Window.partitionBy("player"))
    seasons = seasons.withColumn("_i", index)
    if keep > 0:
        # keep^(i - j) = keep^i / keep^j; i stays below the number of seasons.
        scaled = F.col("_s") * F.pow(F.lit(1 / keep), F.col("_i"))
        carried = F.coalesce(F.sum(scaled).over(earlier), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_i"))
    else:
        carried = F.lit(0.0)
    seasons = seasons.select("player", "season", carried.alias("_carried"))
    run = Window.partitionBy("player", "season").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return (
        gains.withColumn("_run", F.sum("gain").over(run))
        .join(seasons, ["player", "season"])
        .select("player", "season", "period", (F.col("_run") + F.col("_carried") + PLAYER_START).alias("rating"))
    )


def season_grade_sum(grades: DataFrame, below: float = 3.0, times: float = 5.0) -> DataFrame:
    """Older accumulator: five times the distance from the own season mean so far, three more off below it, from 100 each season."""
    run = Window.partitionBy("player", "season").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg("grade").over(run)
    g = grades.withColumn("_m", mean)
    step = (F.col("grade") - F.col("_m") - F.when(F.col("grade") < F.col("_m"), below).otherwise(0)) * times
    return g.withColumn("_step", step).select("player", "season", "period", (F.sum("_step").over(run) + PLAYER_START).alias("rating"))


def best_in_lineup(entries: DataFrame, ratings: DataFrame, role: str, default: float = PLAYER_START) -> DataFrame:
    """Best known rating among a line-up's players of a role."""
    from tidemark.operators.history import asof

    wanted = entries.filter(F.col("position") == role).select("team", "period", "player")
    known = asof(wanted, ratings.select("player", "period", "rating"), ["player"], ["rating"])
    return known.groupBy("team", "period").agg(F.max(F.coalesce("rating", F.lit(default))).alias("rating"))


def best_by_role(entries: DataFrame, ratings: DataFrame, roles: Sequence[str], default: float = PLAYER_START) -> DataFrame:
    """Best known rating among a line-up's players, a column per role: team, period,
    ``best_<role>`` (null where the line-up lists nobody of the role).

    One as-of lookup for all entries; the roles are conditional maxima of one fold."""
    from tidemark.operators.history import asof

    wanted = entries.filter(F.col("position").isin(*roles)).select("team", "period", "player", "position")
    known = asof(wanted, ratings.select("player", "period", "rating"), ["player"], ["rating"])
    rating = F.coalesce("rating", F.lit(default))
    return known.groupBy("team", "period").agg(*[F.max(F.when(F.col("position") == r, rating)).alias(f"best_{r.lower()}") for r in roles])
