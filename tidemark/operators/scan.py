"""Ordered scans (lag, lead, fill, running sum, row number) that survive a hot group.

A window partitioned by the group alone puts the whole group into one task.
Here each group is cut into *chunks*: a chunk is a coarse, monotone function
of the ordering (``num div 65536``, ``floor(value / width)``).  Windows run
inside (group, chunk); each chunk also folds into one summary row, a second
small window carries the summaries across chunks, and a join hands the
carried state to the rows.  Exact for any data: the key of group and chunk is
never null, so a null key is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Chunk numbers that one chunk of the next level holds.
FAN = 1024


@dataclass(frozen=True)
class RowNumber:
    name: str


@dataclass(frozen=True)
class RunningSum:
    """Sum over earlier rows, and the row itself when ``inclusive``."""

    name: str
    col: str
    inclusive: bool = True


@dataclass(frozen=True)
class RunningMax:
    """Maximum over earlier rows, and the row itself when ``inclusive``."""

    name: str
    col: str
    inclusive: bool = True


@dataclass(frozen=True)
class Lag:
    name: str
    col: str


@dataclass(frozen=True)
class Lead:
    name: str
    col: str


@dataclass(frozen=True)
class Fill:
    """Last non-null value at or before the row; only before it unless ``inclusive``."""

    name: str
    col: str
    inclusive: bool = True


Spec = RowNumber | RunningSum | RunningMax | Lag | Lead | Fill


def chunked_scan(
    df: DataFrame,
    by: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    specs: Sequence[Spec],
    descending: bool = False,
    levels: int = 1,
) -> DataFrame:
    """Add the scan columns ``specs`` to ``df``.

    Chunk summaries are carried by a window over the group's chunks.  With more
    ``levels`` they are themselves scanned in chunks of ``FAN`` chunk numbers, and so
    on, so that no window holds more than a group's rows over chunk size and
    ``FAN ** (levels - 1)``; ``chunk`` must then be a number.

    ``order`` names the ordering columns, unique within a group.  ``descending`` turns the first ordering column
    (and the chunks) round; the others always ascend.
    """
    by = list(by)
    lead_col = F.col(order[0]).desc() if descending else F.col(order[0]).asc()
    keyed, key = _keyed(df, by, chunk)
    inner = Window.partitionBy(*key).orderBy(lead_col, *[F.col(c) for c in order[1:]])
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    if descending and any(isinstance(s, Lag | Lead | Fill) for s in specs):
        raise ValueError("lag, lead and fill scan upwards")
    at = F.struct(*order)
    local: list[Column] = []
    fold: list[Column] = []
    carry: list[Spec] = []
    result: list[Column] = []

    for i, s in enumerate(specs):
        loc, tot, car = f"_l{i}", f"_t{i}", f"_c{i}"
        match s:
            case RowNumber():
                local.append(F.row_number().over(inner).cast("bigint").alias(loc))
                fold.append(F.count(F.lit(1)).alias(tot))
                carry.append(RunningSum(car, tot, inclusive=False))
                result.append((F.col(loc) + F.coalesce(car, F.lit(0))).alias(s.name))
            case RunningSum():
                local.append(F.sum(s.col).over(upto if s.inclusive else before).alias(loc))
                fold.append(F.sum(s.col).alias(tot))
                carry.append(RunningSum(car, tot, inclusive=False))
                result.append(
                    F.when(F.col(loc).isNull(), F.col(car))
                    .otherwise(F.col(loc) + F.coalesce(F.col(car), F.lit(0)))
                    .alias(s.name)
                )
            case RunningMax():
                local.append(F.max(s.col).over(upto if s.inclusive else before).alias(loc))
                fold.append(F.max(s.col).alias(tot))
                carry.append(RunningMax(car, tot, inclusive=False))
                result.append(F.greatest(loc, car).alias(s.name))
            case Lag():
                local.append(F.lag(F.struct(s.col)).over(inner).alias(loc))
                fold.append(F.max_by(F.struct(s.col), at).alias(tot))
                carry.append(Lag(car, tot))
                result.append(F.coalesce(loc, car).getField(s.col).alias(s.name))
            case Lead():
                local.append(F.lead(F.struct(s.col)).over(inner).alias(loc))
                fold.append(F.min_by(F.struct(s.col), at).alias(tot))
                carry.append(Lead(car, tot))
                result.append(F.coalesce(loc, car).getField(s.col).alias(s.name))
            case Fill():
                local.append(F.last(s.col, ignorenulls=True).over(upto if s.inclusive else before).alias(loc))
                fold.append(F.max_by(s.col, F.when(F.col(s.col).isNotNull(), at)).alias(tot))
                carry.append(Fill(car, tot, inclusive=False))
                result.append(F.coalesce(loc, car).alias(s.name))

    summaries = keyed.groupBy(*key).agg(*fold)
    if key == ["_k"]:
        carried = _carry(summaries, by, carry, descending, levels)
    else:
        # Folded rows are few: they travel with the struct and get the plain key back.
        parts = [F.when(F.col("_knull").bitwiseAND(1 << i) == 0, F.col(f"_k{i}")).alias(c) for i, c in enumerate([*by, "_chunk"])]
        struct = summaries.select(F.struct(*parts).alias("_k"), *[c for c in summaries.columns if c not in key])
        carried = _carry(struct, by, carry, descending, levels)
        carried = _keyed(carried.select("*", "_k.*"), by, F.col("_chunk"))[0].select(*key, *[s.name for s in carry])
    return (
        keyed.select("*", *local)
        .join(carried, key, "left")
        .select(*[F.col(c) for c in df.columns], *result)
    )


def _keyed(df: DataFrame, by: Sequence[str], chunk: Column) -> tuple[DataFrame, list[str]]:
    """``df`` with the key columns of (group, chunk), and their names.

    None of them is ever null, so a null key is a group like any other: each part has a
    value instead of null and a bit in ``_knull``.  Sorts compare plain columns much
    faster than one struct, which is left for parts of other types."""
    parts = [*[F.col(b) for b in by], chunk]
    types = [f.dataType for f in df.select(*[p.alias(f"_k{i}") for i, p in enumerate(parts)]).schema]
    if not all(isinstance(t, T.IntegralType | T.FractionalType | T.StringType | T.BooleanType) for t in types):
        return df.withColumn("_k", F.struct(*by, chunk.alias("_chunk"))), ["_k"]
    instead = [F.lit("" if isinstance(t, T.StringType) else False if isinstance(t, T.BooleanType) else 0).cast(t) for t in types]
    flat = {f"_k{i}": F.coalesce(p, v) for i, (p, v) in enumerate(zip(parts, instead, strict=True))}
    null = reduce(add, [F.when(p.isNull(), 1 << i).otherwise(0) for i, p in enumerate(parts)])
    return df.withColumns({**flat, "_knull": null}), [*flat, "_knull"]


def _carry(summaries: DataFrame, by: Sequence[str], specs: Sequence[Spec], descending: bool, levels: int) -> DataFrame:
    """What each chunk gets from the chunks before it: ``_k`` and the scan columns."""
    keys = [F.col("_k").getField(b).alias(f"_g{i}") for i, b in enumerate(by)]
    rows = summaries.select("*", *keys, F.col("_k").getField("_chunk").alias("_at"))
    names = [f"_g{i}" for i in range(len(by))]
    if levels > 1:
        # The next level's own columns have the same names; those of this one step aside.
        inner = {c: f"_s{c}" for c in rows.columns if c[:2] in ("_t", "_k")}
        above = [replace(s, name=f"up{s.name}", col=inner[s.col]) for s in specs]
        coarse = F.floor(F.col("_at") / FAN)
        out = chunked_scan(rows.withColumnsRenamed(inner), names, coarse, ["_at"], above, descending, levels - 1)
        return out.select(F.col("_s_k").alias("_k"), *[F.col(f"up{s.name}").alias(s.name) for s in specs])
    order = F.col("_at").desc() if descending else F.col("_at")
    outer = Window.partitionBy(*names).orderBy(order)
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    columns = []
    for s in specs:
        match s:
            case RunningSum():
                c = F.sum(s.col).over(earlier)
            case RunningMax():
                c = F.max(s.col).over(earlier)
            case Lag():
                c = F.lag(s.col).over(outer)
            case Lead():
                c = F.lead(s.col).over(outer)
            case _:
                c = F.last(s.col, ignorenulls=True).over(earlier)
        columns.append(c.alias(s.name))
    return rows.select("_k", *columns)

