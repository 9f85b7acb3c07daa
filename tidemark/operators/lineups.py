"""Delimited line-ups ``id:ROLE|id:ROLE`` as rows, and aggregates over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(cell: Column) -> Column:
    """Cell to ``array<struct<player, position>>``."""
    return F.transform(
        F.split(cell, r"\|"),
        lambda e: F.struct(
            F.split_part(e, F.lit(":"), F.lit(1)).alias("player"), F.split_part(e, F.lit(":"), F.lit(2)).alias("position")
        ),
    )


def explode(df: DataFrame, cell: str = "starters") -> DataFrame:
    """One row per line-up entry with its 1-based ``slot``."""
    rest = [c for c in df.columns if c != cell]
    out = df.select(*rest, F.posexplode(parse(F.col(cell))).alias("_pos", "_e"))
    return out.select(*rest, (F.col("_pos") + 1).alias("slot"), "_e.player", "_e.position")


def implode(df: DataFrame, by: Sequence[str], order: str = "slot") -> DataFrame:
    """Line-up entries back to one cell per group; a line-up has a fixed size."""
    entry = F.struct(order, F.concat_ws(":", "player", "position").alias("e"))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["e"]), "|")
    return df.groupBy(*by).agg(cell.alias("starters"))


def paged_list(df: DataFrame, by: Sequence[str], item: str, page_rows: int = 10_000, delimiter: str = "|") -> DataFrame:
    """Distinct integer ids per group as delimited pages.

    A page covers an id range of ``page_rows``, so that no task ever holds an
    unbounded list; a group with few ids is one page.
    """
    ids = df.select(*by, item).distinct().withColumn("page", F.floor(F.col(item) / page_rows))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), delimiter)
    return ids.groupBy(*by, "page").agg(joined.alias(f"{item}s"))


def by_role(entries: DataFrame, by: Sequence[str], value: str, roles: Sequence[str], aggs: Sequence[str] = ("avg", "min", "max")) -> DataFrame:
    """Aggregates of ``value`` per role as columns ``<role>_<agg>``.

    Conditional aggregates over a fixed role list: one pass, no pivot job.
    """
    cols = []
    for r in roles:
        own = F.when(F.col("position") == r, F.col(value))
        for a in aggs:
            fn = {"avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "sum": F.sum}[a]
            cols.append(fn(own).alias(f"{r.lower()}_{a}"))
    return entries.groupBy(*by).agg(*cols)


def fill_slots(listed: DataFrame, leaders: DataFrame, by: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """Complete line-ups to a size per role with the best players not listed yet.

    ``listed``: by, player, position.  ``leaders``: by, player, position,
    score, at most a few per group.
    """
    have = listed.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("have"))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("position"))
    free = leaders.join(listed.select(*by, "player"), [*by, "player"], "left_anti").filter(
        F.col("position").isin(*sizes)
    )
    from tidemark.operators.history import newest

    free = newest(free.withColumn("_down", -F.col("player")), [*by, "position"], ["score", "_down"], max(sizes.values()), "seat")
    free = free.join(have, [*by, "position"], "left").filter(F.col("seat") <= size - F.coalesce("have", F.lit(0)))
    return listed.select(*by, "player", "position", F.lit(False).alias("added")).unionByName(
        free.select(*by, "player", "position", F.lit(True).alias("added"))
    )
