"""Landed pages and odds documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ODDS_SCHEMA = (
    "home_team string, away_team string, bookmakers array<struct<key: string, markets: array<struct<key: string, "
    "outcomes: array<struct<name: string, point: double>>>>>>"
)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), 1)


def schedule_rows(pages: DataFrame, keys: list[str], wanted: str | None = None) -> DataFrame:
    """Links of a schedule page in threes: away, match key, home.

    ``wanted`` keeps only links that match; a leading link that would break
    the threes is the caller's to filter.
    """
    links = hrefs(F.col("html"))
    if wanted is not None:
        links = F.filter(links, lambda x: x.rlike(wanted))
    triples = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(links) / 3).cast("int") - 1),
        lambda i: F.struct(
            i.alias("pos"), F.get(links, i * 3).alias("away"), F.get(links, i * 3 + 1).alias("key"), F.get(links, i * 3 + 2).alias("home")
        ),
    )
    return pages.select(*keys, F.inline(F.when(F.size(links) >= 3, triples)))


def anchors_to_ids(html: Column) -> Column:
    """Anchors give way to the last part of their target, other tags vanish."""
    with_ids = F.regexp_replace(html, r'<a [^>]*href="(?:[^"]*/)?([^"/.]*)(?:\.[a-z]+)?"[^>]*>[^<]*</a>', "$1")
    return F.regexp_replace(with_ids, r"<[^>]*>", "")


def odds_rows(docs: DataFrame, column: str) -> DataFrame:
    """First bookmaker's first market: the point of each side by team name."""
    d = docs.withColumn("_o", F.from_json(column, ODDS_SCHEMA))
    outcomes = F.get(F.get(F.col("_o.bookmakers"), F.lit(0))["markets"], F.lit(0))["outcomes"]

    def point(team: str) -> Column:
        return F.get(F.filter(outcomes, lambda o: o["name"] == F.col(f"_o.{team}")), F.lit(0))["point"]

    return d.select(
        *docs.columns, F.col("_o.home_team").alias("home_team"), F.col("_o.away_team").alias("away_team"),
        point("home_team").alias("home_point"), point("away_team").alias("away_point"),
    ).drop(column)


def file_team(files: DataFrame, teams: DataFrame) -> DataFrame:
    """Team whose name is contained in a file name.

    File names split into words and runs of words; an equi-join on the name
    replaces the containment test over pairs.  The longest hit wins.
    """
    words = F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace("file", r"\.[a-z]+$", ""), r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    n = F.size("w")
    # No run is longer than the longest name: one figure.
    longest = teams.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.array_join(F.slice(F.col("w"), i, k), " ")),
        )
    )
    r = files.withColumn("w", words).filter(n > 0).select("file", F.explode(F.array_distinct(runs)).alias("name"))
    hit = r.join(teams.select(F.lower("name").alias("name"), "team"), "name")
    return hit.groupBy("file").agg(F.max_by("team", F.struct(F.length("name").alias("n"), "name")).alias("team"))
