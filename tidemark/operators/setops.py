"""Unions, differences and idempotent replacement of keyed batches."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return union_all(*frames).dropDuplicates(list(keys) if keys else None)


def _without(df: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur; null is a key like any other."""
    own = [f"__{i}" for i in range(len(keys))]
    there = keys_of.select(*[F.col(k).alias(o) for k, o in zip(keys, own)]).distinct()
    same = functools.reduce(lambda a, b: a & b, [df[k].eqNullSafe(there[o]) for k, o in zip(keys, own)])
    return df.join(there, same, "left_anti")


def unseen(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet."""
    return _without(batch, stored, keys)


def append_unseen(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.unionByName(unseen(batch, stored, keys))


def replace_keys(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows under the batch's keys give way to the batch."""
    return _without(stored, batch, keys).unionByName(batch)
