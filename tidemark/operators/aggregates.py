"""Aggregates the plain API does not name: shares, modes, tiers, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shares(df: DataFrame, group: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Share of the group total; 1.0 for a group of one; null for a total of zero.

    Totals are folded before the shuffle and joined back, so that a hot group
    is never sorted in one task.
    """
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_members"))
    out = df.join(totals, list(group))
    share = F.when(F.col("_members") == 1, F.lit(1.0)).otherwise(F.try_divide(F.col(value), F.col("_total")))
    return out.withColumn(name, share).drop("_total", "_members")


def mode_by(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Most common value per group, the smallest among equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias(name))


def latest_first_seen(df: DataFrame, by: Sequence[str], value: str, position: str, name: str) -> DataFrame:
    """The value whose *first* occurrence comes last (not the mode)."""
    first = df.groupBy(*by, value).agg(F.min(position).alias("_first"))
    return first.groupBy(*by).agg(F.max_by(value, F.struct("_first", value)).alias(name))


def mean_of_means(df: DataFrame, by: Sequence[str], role: str, value: str, name: str) -> DataFrame:
    """Mean per role, then the mean of those means."""
    inner = df.groupBy(*by, role).agg(F.avg(value).alias("_m"))
    return inner.groupBy(*by).agg(F.avg("_m").alias(name))


def argmax_by(df: DataFrame, by: Sequence[str], value: str, item: str, name: str) -> DataFrame:
    """Item with the largest value per group, the smallest item among equals."""
    return df.groupBy(*by).agg(F.min_by(item, F.struct((-F.col(value)).alias("v"), F.col(item).alias("i"))).alias(name))


def wide(df: DataFrame, keys: Sequence[str], category: str, value: str, categories: Sequence[str], max_null: float | None = None) -> DataFrame:
    """Long to wide over a fixed category list; drop columns with too many nulls."""
    out = df.groupBy(*keys).agg(*[F.max(F.when(F.col(category) == c, F.col(value))).alias(c) for c in categories])
    if max_null is None:
        return out
    # One row of null ratios decides the columns.
    ratios = out.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in categories]).first()
    return out.select(*keys, *[c for c in categories if ratios[c] is None or ratios[c] <= max_null])


def votes(cols: Sequence[str]) -> tuple[Column, Column]:
    """Majority flag and agreement in percent over 0/1 columns."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    n = len(cols)
    return F.when(total * 2 > n, 1).otherwise(0), F.round(F.greatest(total, n - total) * 100.0 / n, 2)


def row_mean(cols: Sequence[str]) -> Column:
    return sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)


def accuracy(df: DataFrame, label: str, models: Sequence[str]) -> DataFrame:
    """One row per model column: share of rows that equal the label."""
    one = df.agg(*[F.avg((F.col(m) == F.col(label)).cast("int")).alias(m) for m in models])
    return one.unpivot([], list(models), "model", "accuracy")
