"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are dealt by hash into blocks of about equal words.  Its
target is whole passes over all blocks and a rest: blocks in hash order until
the rest is reached, where the last document may be cut.  The block draws of all
sources are then split among the output shards by a binary tree: at each node
the counts of the left half come from a multivariate hypergeometric draw, so the
quotas add up exactly and every shard is a random sample of the whole mix.  A
shard takes consecutive draws of the permuted blocks, so shards are disjoint,
and shuffles its documents locally.

Sources may be many: their sizes, targets and quotas are tables.  The tree is
drawn group by group: a draw over all sources is one over the halves of the
sources, then over the halves of a half, down to groups of GROUP_SOURCES, so a
task needs the counts of its own sources and one count per halving.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Scratch, free_prefix, shuffle_partitions

#: Words of a block on average; a source has at least one block.
BLOCK_WORDS = 20_000
#: A source is used at most so many times.
MOST = 3
#: Sources whose quotas one task splits among the shards.
GROUP_SOURCES = 256


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> dict[str | None, Fraction]:
    """Exact target of each source of a small table: shares by weight, at most
    ``most`` times its size.  :func:`targeted` does the same for any number.

    Weights repeat over the sources by code point, null last.  Sources reach
    their cap in order of cap over weight, so one pass finds all that do.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, share, out = sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(names, key=lambda s: Fraction(most * sizes[s], weight[s])):
        fair = Fraction(left * weight[s], share)
        if fair <= most * sizes[s]:
            break
        out[s] = Fraction(most * sizes[s])
        left, share = left - most * sizes[s], share - weight[s]
    return out | {s: Fraction(left * weight[s], share) for s in names if s not in out}


def split_rows(
    quota: np.ndarray, shards: int, seed: int, group: int = 0, others: Sequence[int] = ()
) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, block counts) in order of the shards; the counts add up to ``quota``.

    Each node draws what its left half gets, without replacement, from the node's
    counts.  ``quota`` belongs to one group of sources; ``others`` are the blocks in
    the other half at each halving of the sources on the way to it.  Random numbers
    depend on the node and the halving alone, so all groups draw alike.  Draws are
    limited to 10^9 blocks in all (numpy raises beyond); take larger blocks then.
    """
    depth = len(others)
    nodes = [(0, shards, np.asarray(quota, dtype=np.int64), [int(n) for n in others])]
    while nodes:
        a, b, own, beside = nodes.pop()
        if b - a == 1:
            yield a, own
            continue
        mid = (a + b) // 2
        total = int(own.sum()) + sum(beside)
        take, gone = total * (mid - a) // (b - a), []
        for level, n in enumerate(beside):
            rng = np.random.default_rng([seed, a, b, level, group >> (depth - level)])
            upper = group >> (depth - level - 1) & 1
            total -= n
            low = hypergeometric(rng, *((n, total) if upper else (total, n)), take)
            gone.append(low if upper else take - low)
            take -= gone[-1]
        left = own
        if len(own):
            rng = np.random.default_rng([seed, a, b, depth, group])
            left = rng.multivariate_hypergeometric(own, take, method="marginals")
        nodes.append((mid, b, own - left, [n - g for n, g in zip(beside, gone)]))
        nodes.append((a, mid, left, gone))


def split_tree(quota: np.ndarray, shards: int, seed: int, group: int = 0, others: Sequence[int] = ()) -> np.ndarray:
    """Shards x sources block counts whose column sums are ``quota``."""
    return np.array([counts for _, counts in split_rows(quota, shards, seed, group, others)])


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if not good or not sample:
        return 0
    if not bad:
        return min(good, sample)
    return int(rng.hypergeometric(good, bad, sample))


def sized(docs: DataFrame, seed: int = 17) -> DataFrame:
    """A short row per document, so that texts are read and counted once:
    doc_id, source, size, row_key, same (numbers full repeats).

    Written to the shared folder; it has some 40 bytes per document."""
    rows = docs.select(
        "doc_id",
        "source",
        words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"), "source").alias("row_key"),
    )
    numbered = F.row_number().over(Window.partitionBy("row_key", "doc_id").orderBy("size"))
    return Scratch(docs.sparkSession, "mixing").put(rows.withColumn("same", numbered))


def targeted(d: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The sources of ``d``: sid (place by code point, null last), source,
    source_size, target, passes and rest (of its whole words to take), blocks.

    A written table.  A source is capped if its fair share at the common level is
    more than ``most`` times its size.  The level grows by Newton's steps on a
    concave, piecewise linear function: each is one aggregate, a handful settle it.
    """
    spark = d.sparkSession
    scratch = Scratch(spark, "sources")
    by_source = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = F.col("source").asc_nulls_last()
    ordered = by_source.repartitionByRange(shuffle_partitions(spark), name).sortWithinPartitions(name)
    # The id counts rows inside a partition, from the partition's number times 2**33.
    ordered = scratch.put(ordered.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = ordered.groupBy(part.alias("part")).count()
    starts = starts.select("part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("start"))
    sid = F.col("start") + F.col("id") - F.shiftleft("part", 33)
    numbered = ordered.join(starts, part == F.col("part")).select(sid.alias("sid"), "source", "source_size")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    numbered = scratch.put(numbered.withColumn("weight", weight.cast("decimal(38,0)")))

    def exact(x):
        return F.lit(x).cast("decimal(38,0)")

    cap = F.col("source_size").cast("decimal(38,0)") * exact(most)
    sums = [F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")]
    size, whole = numbered.agg(*sums).first()
    left, share, known = size, int(whole), None
    while (left, share) != known:
        known = left, share
        over = cap * exact(share) < F.col("weight") * exact(left)
        capped, weighed = numbered.filter(over).agg(*sums).first()
        # All sources are capped if their caps don't use up the words to share.
        left, share = (size - most * capped, int(whole - weighed)) if weighed < whole else (1, 0)
    over = cap * exact(share) < F.col("weight") * exact(left)
    fair = F.try_divide(F.col("weight").cast("double") * F.lit(float(left)), F.lit(float(share)))
    rounded = f"CAST((2 * CAST({left} AS DECIMAL(38,0)) * weight + {share}) DIV {max(1, 2 * share)} AS LONG)"
    own = F.col("source_size")
    take = F.when(over, own * most).otherwise(F.expr(rounded))
    return scratch.put(
        numbered.select(
            "sid",
            "source",
            "source_size",
            F.when(over, (own * most).cast("double")).otherwise(fair).alias("target"),
            take.alias("take"),
            F.greatest(F.lit(1), F.ceil(own / block_words)).alias("blocks"),
        ).select(
            "sid",
            "source",
            "source_size",
            "target",
            F.expr("take DIV greatest(source_size, 1)").alias("passes"),
            F.expr("take % greatest(source_size, 1)").alias("rest"),
            "blocks",
        )
    )


def quotas_by_shard(quota: DataFrame, sources: int, shards: int, seed: int) -> DataFrame:
    """What each shard draws of each source: sid, shard, first, n (draws first to
    first + n - 1 of the source), for n above 0.  ``quota``: sid, quota; sids are
    below ``sources``.  One task splits the quotas of GROUP_SOURCES sources."""
    groups = -(-sources // GROUP_SOURCES)
    depth = max(0, groups - 1).bit_length()
    grouped = quota.withColumn("group", F.floor(F.col("sid") / GROUP_SOURCES))
    sums = grouped.groupBy("group").agg(F.sum("quota").alias("blocks"))
    # Each half met on the way down, and for each group the halves beside its way.
    levels = sums.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>")))
    half = F.floor(F.col("group") / F.pow(F.lit(2), depth - F.col("level")))
    halves = levels.groupBy("level", half.alias("half")).agg(F.sum("blocks").alias("blocks"))
    beside = (
        levels.select("group", "level", half.bitwiseXOR(F.lit(1)).alias("half"))
        .join(halves, ["level", "half"], "left")
        .groupBy("group")
        .agg(F.sort_array(F.collect_list(F.struct("level", F.coalesce("blocks", F.lit(0)).alias("n")))).alias("others"))
        .select("group", F.col("others.n").alias("others"))
    )

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        sids, others = rows["sid"].to_numpy(), rows["others"].iloc[0]
        first, parts = np.zeros(len(sids), dtype=np.int64), []
        for shard, n in split_rows(rows["quota"].to_numpy(), shards, seed, int(rows["group"].iloc[0]), () if others is None else others):
            at = np.flatnonzero(n)
            parts.append(np.stack([sids[at], np.full(len(at), shard), first[at], n[at]], axis=1))
            first += n
        return pd.DataFrame(np.concatenate(parts), columns=["sid", "shard", "first", "n"])

    return grouped.join(beside, "group", "left").groupBy("group").applyInPandas(split, "sid long, shard int, first long, n long")


def mix(
    d: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    shards: int | None = None,
    seed: int = 17,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """The mix and the sources: (draws, sources).

    draws: one row per document and copy taken: doc_id, row_key, source, copy,
    words (less than the document's for one cut document per source), shard,
    position (order within the shard).  sources: source, source_size, target.
    ``d`` is the result of :func:`sized` with the same seed.

    A null text (size 0) is never taken; null sources are one source, last in
    order.  Rows are told apart by (doc_id, hash of the text,
    source); full repeats share a row_key and are numbered.  An empty table gives no rows.
    Every step groups by source and block, never by source alone, so a source
    with a third of all rows is spread over its blocks.  Sources are never collected
    nor broadcast by a hint; there may be as many as documents.
    """
    spark = d.sparkSession
    shards = shards or shuffle_partitions(spark)
    scratch = Scratch(spark, "mixing")
    sources = targeted(d, weights, MOST, block_words)
    plan = sources.filter("source_size > 0")
    placed = (
        d.filter("size > 0")
        .withColumnRenamed("source", "s")
        .join(plan.select("sid", "source", "passes", "rest", "blocks"), F.col("s").eqNullSafe(F.col("source")))
        .drop("s")
        .withColumn("block", F.pmod(F.col("row_key"), F.col("blocks")))
    )
    blocks = placed.groupBy("sid", "block").agg(F.sum("size").alias("own"))
    # Running words and ranks of blocks: groups of 1,000 blocks, then inside them.
    blocks = scratch.put(blocks.withColumn("group", F.floor(F.col("block") / 1000)))
    groups = blocks.groupBy("sid", "group").agg(F.sum("own").alias("words"), F.count(F.lit(1)).alias("n"))
    of_source = Window.partitionBy("sid")
    upto = of_source.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "sid",
        "group",
        F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n_before"),
        F.sum("n").over(of_source).alias("n"),
    )
    inside = Window.partitionBy("sid", "group").orderBy("block")
    blocks = blocks.join(groups, ["sid", "group"]).select(
        "sid",
        "block",
        "n",
        (F.col("words_before") + F.sum("own").over(inside) - F.col("own")).alias("before"),
        (F.col("n_before") + F.row_number().over(inside) - 1).alias("rank"),
    )
    # One row per draw of a block: full passes, and once more up to the rest.
    last = F.col("before") < F.col("rest")
    drawn_blocks = scratch.put(
        blocks.join(plan.select("sid", "passes", "rest"), "sid")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        .filter((F.col("copy") < F.col("passes")) | last)
        .select("sid", "block", "before", "copy", (F.col("copy") * F.col("n") + F.col("rank")).alias("draw"))
    )
    quota = drawn_blocks.groupBy("sid").agg(F.count(F.lit(1)).alias("quota"))
    dealt = quotas_by_shard(quota, sources.count(), shards, seed)
    upto_n = F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)
    dealt = dealt.select("sid", "shard", F.explode(upto_n).alias("draw"))
    # A block has one draw per pass, at most MOST + 1.
    blocks = (
        drawn_blocks.join(dealt, ["sid", "draw"])
        .groupBy("sid", "block")
        .agg(F.first("before").alias("before"), F.collect_list(F.struct("copy", "shard")).alias("takes"))
    )
    inner = Window.partitionBy("sid", "block").orderBy("row_key", "doc_id", "same")
    drawn = (
        placed.join(blocks, ["sid", "block"])
        .withColumn("before", F.col("before") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("before"))))
        .withColumn("take", F.explode("takes"))
        .withColumn("copy", F.col("take.copy"))
        .withColumn("words", F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("part")))
        .filter("words > 0")
    )
    local = F.xxhash64(F.lit(seed + 1), "row_key", "copy", "same")
    draws = drawn.select(
        "doc_id", "row_key", "same", "source", "copy", "words", "size", F.col("take.shard").alias("shard"), local.alias("position")
    )
    return draws, sources.select("source", "source_size", "target")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document comes once per
    copy, and the one cut document of a source keeps its first words only.

    Rows are dealt to shards and shuffled inside them.
    """
    spark = docs.sparkSession
    shards = how.pop("shards", None) or shuffle_partitions(spark)
    seed = how.get("seed", 17)
    draws, _ = mix(sized(docs, seed), shards=shards, **how)
    columns, own = docs.columns, free_prefix(docs.columns)
    key, same, lead = f"{own}key", f"{own}same", f"{own}lead"
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"), "source"))
    keyed = keyed.withColumn(same, F.row_number().over(Window.partitionBy(key, "doc_id").orderBy(F.lit(1))))
    keyed = keyed.withColumn(lead, F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int"))
    names = {"row_key": "row", "same": "number", "doc_id": "id", "words": "words", "size": "size", "shard": "shard", "position": "position"}
    picks = draws.select(*(F.col(c).alias(own + n) for c, n in names.items()))
    words, size, shard, position = (own + n for n in ("words", "size", "shard", "position"))
    cut = F.array_join(F.slice(F.split("text", r"[\x20\x09-\x0D]+"), 1, F.col(words).cast("int") + F.col(lead)), " ")
    picked = (F.col(key) == F.col(f"{own}row")) & (F.col(same) == F.col(f"{own}number")) & F.col("doc_id").eqNullSafe(F.col(f"{own}id"))
    out = keyed.join(picks, picked).withColumn("text", F.when(F.col(words) < F.col(size), cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.repartitionByRange(shards, shard, position).sortWithinPartitions(shard, position).select(*columns)


def taken_per_document(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """Every row of ``docs``: doc_id, size, source_size, target, taken."""
    rows = sized(docs, seed)
    draws, sources = mix(rows, seed=seed, **how)
    sums = draws.groupBy("row_key", "same", F.col("doc_id").alias("id")).agg(F.sum("words").alias("words"))
    sums = sums.withColumnsRenamed({"row_key": "key", "same": "number"})
    own = (F.col("row_key") == F.col("key")) & (F.col("same") == F.col("number")) & F.col("doc_id").eqNullSafe(F.col("id"))
    named = sources.withColumnRenamed("source", "s")
    return (
        rows.join(sums, own, "left")
        .join(named, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"))
    )
