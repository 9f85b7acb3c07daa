"""Sources and sinks: every query writes a derived table and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.testbed import Tables, views
from tidemark.sources import files as S
from tidemark.sources import landed as L

ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query("IO-1 IO-2 IO-10", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def gzip_csv_round_trip(t: Tables) -> DataFrame:
    """Gzip CSV sink and scan with a declared schema."""
    path = S.scratch(t.spark, "orders-csv")
    S.write_csv(t.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path, gzip=True)
    return S.read_csv(t.spark, path, ORDERS_SCHEMA)


@query("IO-3 IO-12", "SELECT o_orderkey, o_totalprice, o_orderstatus AS status FROM orders")
def directory_scan(t: Tables) -> DataFrame:
    """One folder per value, read back with the folder name as a column."""
    path = S.scratch(t.spark, "orders-by-status")
    rows = t.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows.write.partitionBy("o_orderstatus").option("header", True).csv(path)
    return S.read_directory(t.spark, path, "o_orderkey bigint, o_totalprice double", S.folder_value("o_orderstatus"), "status")


@query("IO-3 IO-12", "SELECT o_orderkey, o_totalprice, o_orderpriority AS priority FROM orders")
def files_by_name(t: Tables) -> DataFrame:
    """One file per value, read back with the file's name as a column."""
    path = S.scratch(t.spark, "orders-by-priority")
    S.write_named(t.table("orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "o_orderpriority")
    return S.read_directory(t.spark, path, "o_orderkey bigint, o_totalprice double", S.file_stem(), "priority")


@query(
    "IO-4 S-1",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier",
)
def mapped_columns(t: Tables) -> DataFrame:
    """Sources with different column names under one mapping each."""
    return S.read_mapped(
        [
            (t.table("customer"), {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
            (t.table("supplier"), {"id": "s_suppkey", "name": "s_name", "balance": "s_acctbal"}),
        ]
    )


@query("IO-5", views("plays") + " SELECT num AS quarter, detail, home AS away_points, away AS home_points FROM plays")
def normalised_header(t: Tables) -> DataFrame:
    """Raw table with two team-code columns; the header rule names them."""
    path = S.scratch(t.spark, "raw-plays")
    raw = t.plays.select(F.col("num").alias("Quarter"), F.col("detail").alias("Detail"), F.col("home").alias("ABC"), F.col("away").alias("XYZ"))
    S.write_csv(raw, path)
    df = S.read_csv(t.spark, path, "Quarter bigint, Detail string, ABC bigint, XYZ bigint")
    return df.toDF(*S.normalise_header(df.columns))


@query("IO-6", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS name FROM customer")
def sheet_export(t: Tables) -> DataFrame:
    """Sheets exported as CSV, header row below some text."""
    path = S.scratch(t.spark, "sheets")
    # A sheet holds a range of a thousand customers.
    lines = t.table("customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("sheet")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "c_custkey", "c_mktsegment"))), "\n").alias("body")
    )
    text = F.concat(F.lit("Exported sheet\n\nid,name\n"), "body").alias("value")
    lines.select("sheet", text).write.partitionBy("sheet").text(path)
    return S.read_sheet(t.spark, path, ["id", "name"], "id")


@query(
    "IO-7",
    """WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages), i AS (SELECT page_id, l, unnest(range(len(l) // 3)) AS pos FROM h)
    SELECT page_id, pos::INT AS pos, l[pos * 3 + 1] AS away, l[pos * 3 + 2] AS key, l[pos * 3 + 3] AS home FROM i""",
)
def page_links(t: Tables) -> DataFrame:
    """Links of each page in threes."""
    return L.schedule_rows(t.table("pages"), ["page_id"])


@query(
    "IO-8",
    r"""SELECT page_id, regexp_replace(regexp_replace(html, '<a [^>]*href="(?:[^"]*/)?([^"/.]*)(?:\.[a-z]+)?"[^>]*>[^<]*</a>', '\1', 'g'), '<[^>]*>', '', 'g') AS text FROM pages""",
)
def page_text_with_ids(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", L.anchors_to_ids(F.col("html")).alias("text"))


@query(
    "IO-9 F-34 J-13",
    views("matches") + " SELECT match_id, 'Team ' || home AS home_team, 'Team ' || away AS away_team, -(home_yards % 14 + 0.5)::DOUBLE AS home_point, (home_yards % 14 + 0.5)::DOUBLE AS away_point FROM matches",
)
def odds_documents(t: Tables) -> DataFrame:
    """Nested odds documents back to one row per match."""
    name = {s: F.concat(F.lit("Team "), F.col(s)) for s in ("home", "away")}
    p = (F.col("home_yards") % 14 + 0.5).cast("double")
    outcomes = F.array(F.struct(name["away"].alias("name"), p.alias("point")), F.struct(name["home"].alias("name"), (-p).alias("point")))
    doc = F.to_json(
        F.struct(
            name["home"].alias("home_team"), name["away"].alias("away_team"),
            F.array(F.struct(F.lit("first").alias("key"), F.array(F.struct(F.lit("spreads").alias("key"), outcomes.alias("outcomes"))).alias("markets"))).alias("bookmakers"),
        )
    )
    return L.odds_rows(t.matches.select("match_id", doc.alias("doc")), "doc")


@query("IO-11", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def json_round_trip(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "orders-json")
    t.table("orders").select("o_orderkey", "o_orderpriority", "o_totalprice").write.json(path)
    return t.spark.read.schema("o_orderkey bigint, o_orderpriority string, o_totalprice double").json(path)


@query("IO-13", views("plays") + " SELECT detail AS line, count(*) AS n FROM plays GROUP BY 1")
def text_corpus(t: Tables) -> DataFrame:
    """Line corpus as text files and its line frequencies."""
    path = S.scratch(t.spark, "corpus")
    t.plays.select(F.col("detail").alias("value")).write.text(path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("IO-14 IO-12", views("matches") + " SELECT season, count(*) AS matches, sum(home_points)::BIGINT AS points FROM matches GROUP BY 1")
def materialised_once(t: Tables) -> DataFrame:
    """Second call reads what the first one wrote."""
    path = S.scratch(t.spark, "season-points")

    def build() -> DataFrame:
        return t.matches.groupBy("season").agg(F.count(F.lit(1)).alias("matches"), F.sum("home_points").alias("points"))

    S.materialize(t.spark, path, build)
    return S.materialize(t.spark, path, build)


@query(
    "IO-15",
    "SELECT lower(replace(c_name, '#', '_')) || '_' || lower(n_name) || '.csv' AS file, n_nationkey AS team FROM customer JOIN nation ON n_nationkey = c_nationkey",
)
def team_of_file(t: Tables) -> DataFrame:
    """Team from the name inside a file name."""
    nation = t.table("nation")
    named = t.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    files = named.select(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lit("_"), F.lower("n_name"), F.lit(".csv")).alias("file"))
    teams = nation.select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"), F.col("n_nationkey").alias("team"))
    return L.file_team(files, teams)
