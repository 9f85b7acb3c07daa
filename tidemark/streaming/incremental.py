"""Incremental and streaming maintenance of derived tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ratings import pair_ratings
from tidemark.operators.setops import unseen
from tidemark.sources.files import exists, overwrite_partitions

#: Files that one append adds to a partition at most.
FILES = 8


def append_new(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], partition: str | None = None) -> None:
    """Append the rows of ``batch`` whose key the table does not hold yet.

    ``partition`` names a column that the key determines (a season, a day): the table
    is laid out by it, and only the partitions that the batch touches are read.  A
    partition's rows are dealt to a few tasks by their keys, so it gets few files.
    """
    arrived, batch = batch, batch.dropDuplicates(list(keys))
    if exists(spark, path):
        known = spark.read.schema(batch.schema).parquet(path)
        if partition is not None:
            # One value per touched partition comes to the driver.
            touched = [r[0] for r in arrived.select(partition).distinct().collect()]
            col = F.col(partition)
            known = known.filter(col.isin([v for v in touched if v is not None]) | (col.isNull() if None in touched else F.lit(False)))
        batch = unseen(batch, known, keys)
    if partition is not None:
        batch = batch.repartition(partition, F.pmod(F.xxhash64(*keys), F.lit(FILES)))
    writer = batch.write.mode("append")
    (writer if partition is None else writer.partitionBy(partition)).parquet(path)


def stream_append(
    spark: SparkSession,
    source: str,
    schema,
    target: str,
    keys: Sequence[str],
    derive: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    files_per_batch: int = 1000,
    partition: str | None = None,
) -> None:
    """Run a file stream to its end: derive, then append unseen keys.

    The anti-join makes a replayed batch harmless, so the table holds each
    key once whatever fails in between.  With ``partition`` a batch reads the
    partitions it touches and not the whole target (see :func:`append_new`).
    """

    def step(batch: DataFrame, _: int) -> None:
        append_new(spark, target, derive(batch), keys, partition)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_state(ratings: DataFrame) -> DataFrame:
    """Newest rating per team."""
    return ratings.groupBy("team").agg(F.max_by("rating", "period").alias("rating"))


def advance_ratings(stored: DataFrame, matches: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """Stored ratings extended by the periods they do not cover yet.

    ``stored`` holds ratings going into each period up to the first unseen one,
    which may lie inside a season; ``matches`` must hold the periods from there
    on.  With nothing new the stored ratings come back as they are; without stored
    ratings all periods are new.  ``holders`` (team, season, new_holder) switches to
    the coach rule, as in :func:`pair_ratings`.
    """
    upto = stored.agg(F.max("period")).first()[0]
    if upto is None:
        return pair_ratings(matches, holders=holders)
    fresh = pair_ratings(
        matches.filter(F.col("period") >= upto), start=latest_state(stored), holders=holders, start_season=upto // 100
    )
    if fresh.isEmpty():
        return stored
    return stored.filter(F.col("period") < upto).unionByName(fresh)


def by_season(rows: DataFrame, value: str) -> Column:
    """``value`` of the season at hand from ``rows`` (season, value; a row per season),
    which come as one map; null without such a season."""
    known = rows.filter(F.col("season").isNotNull())
    whole = known.agg(F.map_from_entries(F.collect_list(F.struct("season", value))).alias("m"))
    return F.try_element_at(whole.scalar(), F.col("season"))


def advance_snapshots(stored: DataFrame, side_rows: DataFrame, season_length: DataFrame) -> DataFrame:
    """Standing snapshots of the periods in ``side_rows``, from the stored ones.

    ``stored``: team, season, period, w, l, t, points_for, points_against, one row per
    team and period end since its first match of the season; ``side_rows`` holds only
    matches of newer periods.  The last stored row of each team in its season is the
    state to begin with, each new period adds its own sums, idle teams keep theirs;
    nothing older is read again.  Periods past the regular season give no snapshot.
    Null-safe on an empty stored table: then all periods are new.
    """
    figures = ["w", "l", "t", "points_for", "points_against"]
    state = stored.groupBy("team", "season").agg(F.max_by(F.struct("period", *figures), "period").alias("s")).select("team", "season", "s.*")
    marks = {
        "w": F.count_if(F.col("for_points") > F.col("opp_points")),
        "l": F.count_if(F.col("for_points") < F.col("opp_points")),
        "t": F.count_if(F.col("for_points") == F.col("opp_points")),
        "points_for": F.sum("for_points"),
        "points_against": F.sum("opp_points"),
    }
    # Folded before seasons are looked up: a season is a key of few values, by which
    # nothing is shuffled.  Calendar and lengths are one row each.
    weeks = by_season(season_length.groupBy("season").agg(F.max("weeks").alias("weeks")), "weeks")
    delta = side_rows.groupBy("team", "season", "period").agg(*[v.alias(k) for k, v in marks.items()])
    delta = delta.filter(F.col("period") % 100 <= weeks)
    # The state is one more delta, older than all new periods of its season.
    calendar = side_rows.select("season", "period").distinct().filter(F.col("period") % 100 <= weeks)
    new = by_season(calendar.groupBy("season").agg(F.array_sort(F.collect_set("period")).alias("periods")), "periods")
    begin = state.filter(new.isNotNull()).select("team", "season", "period", *figures, F.lit(True).alias("old"))
    both = begin.unionByName(delta.withColumn("old", F.lit(False)))
    run = Window.partitionBy("team", "season").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.select("team", "season", "period", "old", *[F.sum(c).over(run).alias(c) for c in figures])
    # A row holds until the team's next one: it fills the new periods from its own on.
    until = F.lead("period").over(Window.partitionBy("team", "season").orderBy("period"))
    held = ends.withColumn("_next", until).withColumn("periods", new).filter("periods IS NOT NULL")
    inside = F.filter("periods", lambda p: (p >= F.col("period")) & (F.col("_next").isNull() | (p < F.col("_next"))))
    return held.select("team", "season", F.explode(inside).alias("period"), *figures)


def replace_season(df: DataFrame, path: str) -> None:
    """Overwrite only the seasons present in ``df``."""
    overwrite_partitions(df, path, ["season"])
