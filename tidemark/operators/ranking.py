"""Ranks inside groups of any size, carry-forward grids and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scan import RowNumber, RunningSum, chunked_scan
from tidemark.session import stored

# Ties of one value are numbered in ranges of this many tiebreak ids.
TIE_ROWS = 65536


def log_bucket(value: Column, per_octave: int = 16) -> Column:
    """Monotone bucket of a number, ``per_octave`` buckets per power of two."""
    size = F.floor(F.log2(F.abs(value) + 1) * per_octave)
    return F.coalesce(F.when(value < 0, -size).otherwise(size), F.lit(0))


def ranked(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str = "rank",
    method: str = "row_number",
    tiebreak: Sequence[str] = (),
    descending: bool = True,
    base: int = 1,
    width: float | None = None,
) -> DataFrame:
    """Rank of ``value`` inside ``group``; nulls stay unranked.

    ``method``: ``row_number`` (ties broken by ``tiebreak``, unique integers),
    ``rank`` (min rank) or ``dense_rank``.

    The group is first folded to one row per distinct value.  Values are cut
    into buckets of ``width`` (logarithmic by default), so neither a hot group
    nor a heavily tied value puts its rows into one task; ties are numbered
    inside (group, value) by ranges of the tiebreak.
    """
    if isinstance(df.schema[value].dataType, T.FloatType | T.DoubleType):
        df = stored(df)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    bucket = log_bucket(F.col(value)) if width is None else F.floor(F.col(value) / width)
    spec = RowNumber("_at") if method == "dense_rank" else RunningSum("_at", "_n", inclusive=False)
    places = chunked_scan(counts, group, bucket, [value], [spec], descending).drop("_n")
    if method == "dense_rank":
        rank = F.col("_at")
    else:
        rank = F.coalesce("_at", F.lit(0)) + (F.col("_tie") if method == "row_number" else 1)
    if method == "row_number":
        if tiebreak:
            df = chunked_scan(df, [*group, value], F.floor(F.col(tiebreak[0]) / TIE_ROWS), tiebreak, [RowNumber("_tie")])
        else:
            raise ValueError("row_number needs a tiebreak")
    # One struct as the key: rows of a null group meet as well.
    key = F.struct(*group, value)
    out = df.withColumn("_key", key).join(places.select(key.alias("_key"), "_at"), "_key", "left")
    rank = F.when(F.col(value).isNotNull(), rank + (base - 1))
    return out.select(*[c for c in df.columns if c != "_tie"], rank.alias(name))


def ranked_many(
    df: DataFrame, group: Sequence[str], keys: Sequence[str], descending: dict[str, bool], method: str = "rank"
) -> DataFrame:
    """``<col>_rank`` for several columns in one pass over the long form.

    ``keys`` identify a row inside ``group``; ``descending`` maps each column
    to its direction.  The frame is read once: values travel along in the long
    form and come back with their ranks.
    """
    sign = {c: -1 if down else 1 for c, down in descending.items()}
    signed = [(F.col(c) * k).alias(c) for c, k in sign.items()]
    rest = [c for c in df.columns if c not in (*group, *keys, *descending)]
    long = df.select(*group, *keys, *rest, *signed).unpivot([*group, *keys, *rest], list(descending), "_stat", "_value")
    r = ranked(long, [*group, "_stat"], "_value", "_r", method, tiebreak=keys if method == "row_number" else (), descending=False)
    own = {c: F.col("_stat") == c for c in descending}
    return r.groupBy(*group, *keys).agg(
        *[F.first(c).alias(c) for c in rest],
        *[(F.max(F.when(own[c], F.col("_value"))) * k).alias(c) for c, k in sign.items()],
        *[F.max(F.when(own[c] & F.col("_value").isNotNull(), F.col("_r"))).alias(f"{c}_rank") for c in descending],
    )


def ranked_in(
    df: DataFrame,
    groupings: dict[str, Sequence[str]],
    value: str,
    tiebreak: Sequence[str],
    keys: Sequence[str],
    method: str = "row_number",
    descending: bool = True,
    width: float | None = None,
) -> DataFrame:
    """Ranks of ``value`` inside several groupings: ``{name of the rank: columns}``.

    Each row goes once per grouping into one long form, whose groups are the grouping's
    number and its columns (the others are null, as in grouping sets); one fold and one
    scan rank them all, and the ranks come back by ``keys``, which identify a row.
    """
    cols = sorted({c for group in groupings.values() for c in group})
    forms = [
        F.struct(F.lit(i).alias("_set"), *[(F.col(c) if c in group else F.lit(None).cast(df.schema[c].dataType)).alias(f"_by_{c}") for c in cols])
        for i, group in enumerate(groupings.values())
    ]
    rest = [c for c in df.columns if c not in keys]
    long = df.select("*", F.inline(F.array(*forms)))
    r = ranked(long, ["_set", *[f"_by_{c}" for c in cols]], value, "_r", method, tiebreak if method == "row_number" else (), descending, width=width)
    return r.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in rest], *[F.max(F.when(F.col("_set") == i, F.col("_r"))).alias(n) for i, n in enumerate(groupings)]
    )


def season_grid(values: DataFrame, entity: Sequence[str], season: str = "season", period: str = "period") -> DataFrame:
    """Every entity of a season at every period of that season.

    The periods of a season form one short array per season, joined on the
    season and exploded.
    """
    periods = values.groupBy(season).agg(F.array_sort(F.collect_set(period)).alias("_periods"))
    members = values.select(season, *entity).distinct()
    return members.join(periods, season).select(season, *entity, F.explode("_periods").alias(period))


def carry_forward(
    values: DataFrame,
    entity: Sequence[str],
    cols: Sequence[str],
    season: str = "season",
    period: str = "period",
) -> DataFrame:
    """Values on the full season grid; idle entities keep their last value.

    The values (one row per entity and period) are stored first: the grid
    reads them three times, and what lies behind them is computed once.
    """
    values = stored(values.select(season, *entity, period, *cols))
    w = Window.partitionBy(season, *entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    grid = season_grid(values, entity, season, period)
    return grid.join(values, [season, *entity, period], "left").select(
        season, *entity, period, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols]
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group; the limit runs on the map side as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def hash_order(key: Sequence[str], seed: int) -> Column:
    """Reproducible shuffling key, which other engines can repeat."""
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
