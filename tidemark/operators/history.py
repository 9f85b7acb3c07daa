"""Histories: what was known about an entity before a period.

All windows here run over rows that are already folded to (entity, period),
or to the newest n rows of (entity, period), so their size depends on the
calendar and on n and not on how many rows an entity has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, rank: str = "_rn") -> DataFrame:
    """The n newest rows per group; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def period_totals(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column], period: str = "period") -> DataFrame:
    """Rows folded to (entity, period): ``n`` and the named sums."""
    return df.groupBy(*by, period).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )


def running_totals(totals: DataFrame, by: Sequence[str], cols: Sequence[str], period: str = "period") -> DataFrame:
    """Totals as known at the *end* of each period."""
    w = Window.partitionBy(*by).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return totals.select(*by, period, *[F.sum(c).over(w).alias(c) for c in cols])


def resolve(
    keys: DataFrame,
    state: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    strict: bool = True,
    period: str = "period",
) -> DataFrame:
    """As-of lookup: for each distinct (entity, period) of ``keys`` the newest ``state``.

    ``state`` has one row per (entity, period), known at the end of the
    period.  ``strict`` ignores the key's own period; otherwise an exact match
    wins and older rows serve as fallback.  One union and one window: no
    inequality join, and scoring rows need no history row of their own.
    """
    w = Window.partitionBy(*by).orderBy(period).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    packed = state.select(*by, F.col(period).cast("bigint").alias(period), F.struct(*cols).alias("_state"))
    wanted = (
        keys.select(*by, F.col(period).cast("bigint").alias(period))
        .distinct()
        .withColumn("_state", F.lit(None).cast(packed.schema["_state"].dataType))
        .withColumn("_key", F.lit(True))
    )
    return (
        packed.withColumn("_key", F.lit(False))
        .unionByName(wanted)
        .withColumn("_state", F.last("_state", ignorenulls=True).over(w))
        .filter("_key")
        .select(*by, period, *[F.col("_state").getField(c).alias(c) for c in cols])
    )


def before(state: DataFrame, by: Sequence[str], cols: Sequence[str], period: str = "period") -> DataFrame:
    """State known before each period *of the state itself*.

    The training case: every target has a history row in its own period, so
    the row before is the answer and no key set has to be built.
    """
    w = Window.partitionBy(*by).orderBy(period)
    shifted = F.lag(F.struct(*cols)).over(w).alias("_state")
    return state.select(*by, period, shifted).select(*by, period, *[F.col("_state").getField(c).alias(c) for c in cols])


def asof(
    targets: DataFrame,
    state: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    strict: bool = True,
    period: str = "period",
    in_history: bool = False,
) -> DataFrame:
    """``targets`` with the newest earlier ``state`` columns (null when there is none).

    ``in_history`` promises that every target's (entity, period) occurs in
    the state, which saves building the key set.
    """
    if in_history and strict:
        found = before(state, by, cols, period)
    else:
        found = resolve(targets, state, by, cols, strict, period)
    return targets.join(found, [*by, period], "left")


def attach_before(targets: DataFrame, state: DataFrame, by: Sequence[str], cols: Sequence[str], period: str = "period") -> DataFrame:
    """``targets`` with the newest earlier ``state`` columns, by one shuffle of each.

    Like a strict :func:`asof`, for keys with few targets each: these pass the window
    themselves, where ``asof`` folds them to distinct keys and joins them again."""
    w = Window.partitionBy(*by).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    own = [c for c in targets.columns if c not in (*by, period)]
    known = state.select(*by, F.col(period).cast("bigint").alias(period), F.struct(*cols).alias("_state"), F.lit(None).cast(targets.select(F.struct(*own)).schema[0].dataType).alias("_own"))
    asked = targets.select(*by, F.col(period).cast("bigint").alias(period), F.lit(None).cast(known.schema["_state"].dataType).alias("_state"), F.struct(*own).alias("_own"))
    found = known.unionByName(asked).withColumn("_state", F.last("_state", ignorenulls=True).over(w)).filter(F.col("_own").isNotNull())
    # A null key or period meets nothing, as in a join.
    whole = F.forall(F.array(*[F.col(c).isNotNull() for c in (*by, period)]), lambda x: x)
    picked = {c: F.when(whole, F.col("_state").getField(c)) for c in cols}
    return found.select(*[F.col(c) if c in (*by, period) else F.col("_own").getField(c).alias(c) for c in targets.columns], *[v.alias(k) for k, v in picked.items()])


def to_date(
    targets: DataFrame,
    history: DataFrame,
    by: Sequence[str],
    sums: Mapping[str, Column],
    period: str = "period",
    in_history: bool = False,
) -> DataFrame:
    """Targets with ``n`` and the sums over all earlier periods of ``by``."""
    totals = period_totals(history, by, sums, period)
    cols = ["n", *sums]
    return asof(targets, running_totals(totals, by, cols, period), by, cols, True, period, in_history)


def season_means(
    targets: DataFrame,
    history: DataFrame,
    by: Sequence[str],
    values: Mapping[str, Column],
    season: str = "season",
    period: str = "period",
    min_count: int = 1,
    previous_season: str | None = "first_week",
    week: str = "week",
    in_history: bool = False,
) -> DataFrame:
    """Season-to-date means of ``values`` for each target.

    ``previous_season`` chooses the fallback: ``"first_week"`` uses last
    season's mean in week 1 only, ``"missing"`` whenever nothing is known this
    season, ``None`` never.  Fewer than ``min_count`` rows give null.  Nulls
    in a value do not count towards its mean.
    """
    sums = {f"_s_{k}": v for k, v in values.items()}
    counts = {f"_n_{k}": F.when(v.isNotNull(), 1).otherwise(0) for k, v in values.items()}
    totals = period_totals(history, [*by, season], {**sums, **counts}, period)
    cols = ["n", *sums, *counts]
    state = running_totals(totals, [*by, season], cols, period)

    def mean(prefix: str, k: str) -> Column:
        return F.when(
            F.coalesce(F.col(f"{prefix}n"), F.lit(0)) >= min_count,
            F.try_divide(F.col(f"{prefix}_s_{k}"), F.col(f"{prefix}_n_{k}")),
        )

    if previous_season is None:
        out = asof(targets, state, [*by, season], cols, True, period, in_history)
        return out.select(*targets.columns, *[mean("", k).alias(k) for k in values])
    last = totals.groupBy(*by, season).agg(*[F.sum(c).alias(f"p_{c}") for c in cols])
    last = last.withColumn(season, F.col(season) + 1)
    # Last season's figures go to the folded rows, so the targets, which are many, pass one shuffle.
    found = before(state, [*by, season], cols, period) if in_history else resolve(targets, state, [*by, season], cols, True, period)
    found = found.join(last, [*by, season], "left")
    # A row without a period knows nothing of its own season, but the last one.
    dated = F.col(period).isNotNull()
    now = {k: F.when(dated, mean("", k)).alias(f"_now_{k}") for k in values}
    then = {k: mean("p_", k).alias(f"_then_{k}") for k in values}
    known = found.select(*[F.col(c).alias(f"_by_{c}") for c in (*by, season, period)], *now.values(), *then.values())
    same = [F.col(c) == F.col(f"_by_{c}") for c in (*by, season)] + [F.col(period).eqNullSafe(F.col(f"_by_{period}"))]
    out = targets.join(known, reduce(and_, same), "left")
    if previous_season == "first_week":
        picked = {k: F.when(F.col(week) == 1, F.col(f"_then_{k}")).otherwise(F.col(f"_now_{k}")) for k in values}
    else:
        picked = {k: F.coalesce(f"_now_{k}", f"_then_{k}") for k in values}
    return out.select(*targets.columns, *[c.alias(k) for k, c in picked.items()])


def last_n_means(
    history: DataFrame,
    by: Sequence[str],
    values: Mapping[str, Column],
    n: int,
    order: str = "match_id",
    null_as_zero: bool = False,
    period: str = "period",
) -> DataFrame:
    """State table: means over the newest n rows up to the end of each period."""
    rows = newest(history, [*by, period], [order], n)
    w = Window.partitionBy(*by).orderBy(period, order).rowsBetween(-(n - 1), 0)
    return (
        rows.select(
            *by,
            period,
            "_rn",
            *[F.avg(F.coalesce(v, F.lit(0)) if null_as_zero else v).over(w).alias(k) for k, v in values.items()],
        )
        .filter("_rn = 1")
        .drop("_rn")
    )


def last_n_array_means(
    history: DataFrame, by: Sequence[str], values: Mapping[str, Column], width: int, n: int, order: str = "match_id", period: str = "period"
) -> DataFrame:
    """State table: means, element by element, of arrays of ``width`` figures over the
    newest n rows.  A null array, or a missing element, does not count; an element that
    no row has is null."""
    flat = {f"_{k}_{i}": F.get(v, F.lit(i)) for k, v in values.items() for i in range(width)}
    state = last_n_means(history, by, flat, n, order, period=period)
    return state.select(*by, period, *[F.array(*[f"_{k}_{i}" for i in range(width)]).alias(k) for k in values])


def last_n_rows(
    history: DataFrame,
    by: Sequence[str],
    fields: Mapping[str, Column],
    n: int,
    order: str = "match_id",
    period: str = "period",
    name: str = "recent",
) -> DataFrame:
    """State table: the newest n rows up to the end of each period, newest first."""
    # Only the fields that are read pass the shuffles.
    slim = history.select(*by, period, order, F.struct(*[v.alias(k) for k, v in fields.items()]).alias("_item"))
    rows = newest(slim, [*by, period], [order], n)
    w = Window.partitionBy(*by).orderBy(period, order)
    # The rows before, by their distance: no list is gathered row by row.
    items = [F.lag("_item", i).over(w).alias(f"_item_{i}") for i in range(1, n)]
    lagged = rows.select(*by, period, "_rn", "_item", F.row_number().over(w).alias("_at"), *items).filter("_rn = 1")
    recent = F.array("_item", *[f"_item_{i}" for i in range(1, n)])
    return lagged.select(*by, period, F.slice(recent, F.lit(1), F.least("_at", F.lit(n))).alias(name))


def slots(array: Column, n: int, prefix: str, pad: Column | None = None, field: str | None = None) -> list[Column]:
    """An array as n columns ``prefix_1..n``, padded where it is shorter."""
    out = []
    for i in range(n):
        v = F.get(array, F.lit(i))
        v = v.getField(field) if field else v
        out.append((F.coalesce(v, pad) if pad is not None else v).alias(f"{prefix}_{i + 1}"))
    return out


def fill_with_mean(
    df: DataFrame,
    cols: Sequence[str],
    scale: float = 1.0,
    over: DataFrame | None = None,
    means: DataFrame | None = None,
) -> DataFrame:
    """Nulls in ``cols`` become ``scale`` times the column mean.

    The means are one row, read by a scalar subquery; ``over`` (default: the
    frame itself) supplies them, e.g. the training split only, unless they
    come ready as ``means``.
    """
    if means is None:
        means = (over if over is not None else df).agg(*[F.avg(c).alias(c) for c in cols])
    row = means.select(F.struct(*cols).alias("m")).scalar()
    filled = [
        F.coalesce(F.col(c), F.col("_means").getField(c) * scale).alias(c) if c in cols else F.col(c) for c in df.columns
    ]
    return df.withColumn("_means", row).select(*filled)


def role_means(spine: DataFrame, by_team: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("period",)) -> DataFrame:
    """Means of ``home_<col>`` and ``away_<col>`` as they come out of ``attach_both``.

    Counts of spine rows per (team, keys) weigh the per-team rows, so the wide
    join is not computed a second time for its means.
    """
    weights = spine.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("home").alias("team"), F.lit(1).alias("_h"), F.lit(0).alias("_a")),
                F.struct(F.col("away").alias("team"), F.lit(0).alias("_h"), F.lit(1).alias("_a")),
            )
        ),
    )
    weights = weights.groupBy("team", *keys).agg(F.sum("_h").alias("_h"), F.sum("_a").alias("_a"))
    joined = by_team.join(weights, ["team", *keys])

    def mean(col: str, weight: str) -> Column:
        return F.try_divide(F.sum(F.col(col) * F.col(weight)), F.sum(F.when(F.col(col).isNotNull(), F.col(weight)))).cast("double")

    return joined.agg(*[mean(c, w).alias(f"{r}_{c}") for r, w in (("home", "_h"), ("away", "_a")) for c in cols])


def unordered_pair(a: str, b: str) -> list[Column]:
    """Key that is the same for both orders of two sides."""
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def calendar(df: DataFrame, by: Sequence[str], period: str = "period") -> DataFrame:
    """Distinct periods of each entity with the next one."""
    w = Window.partitionBy(*by).orderBy(period)
    return df.select(*by, period).distinct().withColumn("next_period", F.lead(period).over(w))
