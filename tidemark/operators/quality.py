"""Data quality checks."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_everywhere(values: DataFrame, col: str, dims: Sequence[DataFrame]) -> DataFrame:
    """Distinct values that occur in none of the dimensions."""
    return functools.reduce(lambda left, dim: left.join(dim, col, "left_anti"), dims, values.select(col).distinct())


def text_summary(df: DataFrame, by: Sequence[str], text: str, short: int, nullable: Sequence[str] = ()) -> DataFrame:
    """Characters, short rows and null counts per group."""
    return df.groupBy(*by).agg(
        F.sum(F.length(text)).alias("chars"),
        F.count_if(F.length(text) < short).alias("short_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in nullable],
    )


def column_parity(train: DataFrame, score: DataFrame) -> tuple[list[str], list[str]]:
    """Columns missing in the scoring frame, and columns only it has."""
    a, b = train.columns, score.columns
    return [c for c in a if c not in b], [c for c in b if c not in a]


def wrong_predictions(predictions: DataFrame, features: DataFrame, keys: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Rows the model got wrong, with their features."""
    return predictions.filter(F.col(label) != F.col(prediction)).join(features, list(keys))
