"""Lookups into dimensions: defaults, repairs, ambiguity, list membership."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.history import newest
from tidemark.session import stored


def unique_by(dim: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` (an explicit stand-in for "the first row")."""
    cols = [c for c in dim.columns if c not in keys]
    picked = dim.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in cols])


def lookup(
    df: DataFrame, dim: DataFrame, keys: Sequence[str], defaults: Mapping[str, object], order: Sequence[str] | None = None
) -> DataFrame:
    """Left join on a de-duplicated dimension; misses take the default."""
    dim = dim.select(*keys, *defaults) if order is None else unique_by(dim, keys, order).select(*keys, *defaults)
    out = df.join(dim, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None})


def join_all(spine: DataFrame, features: Sequence[DataFrame], on: Sequence[str], how: str = "left") -> DataFrame:
    """Feature assembly: fold of equi-joins on the spine key."""
    return functools.reduce(lambda left, right: left.join(right, list(on), how), features, spine)


def patch(base: DataFrame, corrections: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Overwrite ``cols`` where a correction row exists."""
    fix = corrections.select(*keys, *[F.col(c).alias(f"_fix_{c}") for c in cols])
    out = base.join(fix, list(keys), "left")
    return out.select(*[F.coalesce(f"_fix_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns])


def backfill(df: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]], col: str) -> DataFrame:
    """First non-null of ``col`` from the frame and then each dimension in turn."""
    out = df
    for i, (dim, keys) in enumerate(dims):
        out = out.join(dim.select(*keys, F.col(col).alias(f"_b{i}")), list(keys), "left")
    return out.select(
        *[F.coalesce(c, *[f"_b{i}" for i in range(len(dims))]).alias(c) if c == col else F.col(c) for c in df.columns]
    )


def prefer(candidates: DataFrame, by: Sequence[str], score: Column, tiebreak: Sequence[str]) -> DataFrame:
    """Of several hits per key keep the one with the highest score."""
    scored = candidates.withColumn("_score", score)
    scored = scored.withColumns({f"_t{i}": -F.col(c) for i, c in enumerate(tiebreak)})
    order = ["_score", *[f"_t{i}" for i in range(len(tiebreak))]]
    return newest(scored, by, order, 1).drop("_rn", *order)


def only_unique(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys with exactly one hit."""
    cols = [c for c in candidates.columns if c not in by]
    one = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*cols)).alias("_row"))
    return one.filter("_n = 1").select(*by, *[F.col("_row").getField(c).alias(c) for c in cols])


def name_keys(name: Column) -> Column:
    """Normalised spelling: lower case, letters only, a lone middle initial dropped."""
    no_initial = F.regexp_replace(name, r"^(\S+) [A-Z]\.? (\S+)$", "$1 $2")
    return F.regexp_replace(F.lower(no_initial), "[^a-z]", "")


def resolve_names(
    mentions: DataFrame, players: DataFrame, aliases: DataFrame, name: str, context: Sequence[str]
) -> DataFrame:
    """Name-to-id by normalised name or alias under the same ``context`` columns, unique hits only.

    An equi-join on the normalised spelling: no containment test over pairs.
    """
    known = players.select("p_id", *context, name_keys(F.col("name")).alias("_key")).unionByName(
        aliases.join(players.select("p_id", *context), "p_id").select("p_id", *context, name_keys(F.col("aka")).alias("_key"))
    )
    known = only_unique(known.distinct(), [*context, "_key"])
    out = mentions.withColumn("_key", name_keys(F.col(name))).join(known, [*context, "_key"], "left")
    return out.drop("_key")


def pieces(spelled: DataFrame, wanted: DataFrame, name: str, mention: str) -> DataFrame:
    """Every piece of the names that is as long as some mention: _nid, _hash of the piece.

    The lengths are one small table; a name of n letters has at most n pieces of a length."""
    lengths = wanted.select(F.length(mention).alias("_len")).distinct()
    fitting = spelled.join(F.broadcast(lengths), F.col("_len") <= F.length(name))
    starts = F.sequence(F.lit(1), F.length(name) - F.col("_len") + 1)
    cut = F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(F.col(name), i, F.col("_len"))))))
    return fitting.select("_nid", cut.alias("_hash"))


def contained_in(mentions: DataFrame, names: DataFrame, mention: str, context: Sequence[str]) -> DataFrame:
    """For each mention, context and team with a fitting name: the least and the
    greatest p_id, which are the same where one entity fits.

    Names and mentions meet on the hash of the whole mention and are verified, so the
    candidates are the hits; a name makes as many rows as it has pieces."""
    wanted = stored(mentions.select(mention).filter(F.length(mention) > 0).distinct())
    spelled = stored(names.select("name").distinct().withColumn("_nid", F.monotonically_increasing_id()))
    candidates = pieces(spelled, wanted, "name", mention).join(wanted.withColumn("_hash", F.xxhash64(mention)), "_hash")
    spellings = candidates.join(spelled, "_nid").filter(F.contains("name", F.col(mention))).select(mention, "name")
    # Folded before any mention asks: a common mention meets one row, not all namesakes.
    return spellings.join(names, "name").groupBy(mention, *context, "team").agg(F.min("p_id").alias("_lo"), F.max("p_id").alias("_hi"))


def resolve_contained(
    mentions: DataFrame, names: DataFrame, keys: Sequence[str], mention: str, context: Sequence[str], teams: Sequence[str]
) -> DataFrame:
    """Mentions to the one entity whose name contains them: keys, mention, p_id, team.

    ``names`` (p_id, team, name and the ``context`` columns) lists every spelling of an
    entity, aliases too; a mention looks at its own context and at the teams in its
    ``teams`` columns.  Exactly one entity must fit, else p_id and team are null, as
    they are for an empty or null mention.
    """
    fits = contained_in(mentions, names, mention, context)
    asked = mentions.select(*keys, mention, *context, F.explode(F.array_distinct(F.array(*teams))).alias("team"))
    hits = asked.join(fits, [mention, *context, "team"])
    found = hits.groupBy(*keys).agg(F.min("_lo").alias("p_id"), F.max("_hi").alias("_hi"), F.min("team").alias("team"))
    one = found.filter(F.col("p_id") == F.col("_hi")).drop("_hi")
    return mentions.select(*keys, mention).join(one, list(keys), "left")


def id_hint(name: Column) -> tuple[Column, Column]:
    """The two pieces an id is made of: four letters of the last name, two of the first."""
    words = F.filter(F.split(name, " "), lambda w: ~w.isin("Jr", "Jr.", "Sr", "Sr.", "II", "III", "IV"))
    last = F.element_at(words, -1)
    return F.substring(last, 1, 4), F.substring(name, 1, 2)


def id_fits(p_id: Column, name: Column) -> Column:
    last, first = id_hint(name)
    return F.contains(p_id, last) & F.contains(p_id, first)
