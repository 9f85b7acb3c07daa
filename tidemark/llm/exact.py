"""Exact duplicates by content sort, in DataFrame operations only.

Sampled splitters range-partition the texts (by a short prefix, then a hash, so
the sample stays small whatever the texts' length), Spark's external sort puts
equal texts side by side, and the window operator compares each text in full
with its neighbour to find where a group ends.

A text with more rows than a fraction of a partition's share is spread over
salts of its id; each salt's part is reduced to one row by the same sort, and
these few rows (at most salts x hot texts) are put together by their full text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, shuffle_partitions

#: Characters of the text that the range splitters see first.
PREFIX = 24
#: A text is hot with more rows than 1 / HOT_SHARE of a partition's mean rows.
HOT_SHARE = 4


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", partitions: int | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: "min" or "max", which id of equal texts stays.  A null text counts
    as empty, and all empty texts are one group.  Null ids never win against
    another id.  Of repeated rows with the same text and id exactly one is kept.
    Other columns of ``docs`` are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "h", F.xxhash64("text")
    )
    total = docs.count()
    least = max(64, total // (HOT_SHARE * n))
    # More than total / (HOT_SHARE * n) rows each: at most HOT_SHARE * n hashes.
    hot = [r.h for r in base.groupBy("h").count().filter(F.col("count") > least).select("h").collect()]
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    # The window's keys hold those of the ranges, so it needs no other shuffle; a
    # constant salt would be dropped from the window's keys and is left out.
    keys = ["prefix", "h", *(["salt"] if hot else [])]
    dealt = (
        base.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(F.lit(-1)))
        .withColumn("prefix", F.substring("text", 1, PREFIX))
        .repartitionByRange(n, *keys)
    )
    order = F.col("doc_id").asc_nulls_last() if keep == "min" else F.col("doc_id").desc_nulls_last()
    w = Window.partitionBy(*keys, "text").orderBy(order)
    parts = dealt.select(
        "doc_id",
        "salt",
        F.sha2("text", 256).alias("text_sha256"),
        F.row_number().over(w).alias("rank"),
        F.first("doc_id").over(w).alias("part_id"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("part_size"),
        "text",
    )
    if not hot:
        return parts.select(
            "doc_id",
            F.col("part_id").alias("keep_id"),
            F.col("part_size").alias("group_size"),
            (F.col("rank") == 1).alias("kept"),
            "text_sha256",
        )
    scratch = Scratch(spark, "exact")
    parts = scratch.put(
        parts.withColumn("text", F.when((F.col("salt") >= 0) & (F.col("rank") == 1), F.col("text")))
    )
    best = F.min("part_id") if keep == "min" else F.max("part_id")
    merged = (
        parts.filter("salt >= 0 AND rank = 1")
        .groupBy("text")
        .agg(best.alias("all_id"), F.sum("part_size").alias("all_size"), F.first("text_sha256").alias("text_sha256"))
        .select("text_sha256", "all_id", "all_size")
    )
    # At most HOT_SHARE * n rows of a hundred bytes: the bound of ``hot``.
    joined = parts.drop("text").join(F.broadcast(merged), "text_sha256", "left")
    own = F.col("salt") < 0
    return joined.select(
        "doc_id",
        F.when(own, F.col("part_id")).otherwise(F.col("all_id")).alias("keep_id"),
        F.when(own, F.col("part_size")).otherwise(F.col("all_size")).alias("group_size"),
        # A null best id means that every id is null: all in the salt of null.
        ((F.col("rank") == 1) & (own | F.col("part_id").eqNullSafe(F.col("all_id")))).alias("kept"),
        "text_sha256",
    )
