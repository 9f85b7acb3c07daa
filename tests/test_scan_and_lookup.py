"""Scans over several levels, ranks in several groupings, contained names, quarters, files."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import lookups as J
from tidemark.operators import scan as C
from tidemark.operators.ranking import ranked_in
from tidemark.sources import files as S


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(1), []
    for g in (1, 2, None):
        for i in rng.sample(range(3000), 400 if g == 1 else 60):
            out.append((g, i, rng.choice([None, rng.randint(-9, 9)])))
    return spark.createDataFrame(out, "g int, i int, v int").cache()


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_levels_agree_with_plain_windows(spark, rows, monkeypatch, levels):
    monkeypatch.setattr(C, "FAN", 4)
    specs = [
        C.RowNumber("n"), C.RunningSum("s", "v"), C.RunningSum("b", "v", inclusive=False), C.RunningMax("m", "v"),
        C.RunningMax("mb", "v", inclusive=False), C.Lag("lag", "v"), C.Lead("lead", "v"), C.Fill("f", "v"), C.Fill("fb", "v", inclusive=False),
    ]
    got = C.chunked_scan(rows, ["g"], F.floor(F.col("i") / 20), ["i"], specs, levels=levels)
    w = Window.partitionBy("g").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "g", "i", "v", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(upto).alias("s"), F.sum("v").over(before).alias("b"),
        F.max("v").over(upto).alias("m"), F.max("v").over(before).alias("mb"), F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
        F.last("v", True).over(upto).alias("f"), F.last("v", True).over(before).alias("fb"),
    )
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    down = C.chunked_scan(rows, ["g"], F.floor(F.col("i") / 20), ["i"], [C.RowNumber("n")], descending=True, levels=levels)
    rev = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("i"))).cast("long"))
    assert sorted(map(str, down.collect())) == sorted(map(str, rev.collect()))


def test_a_hot_group_is_carried_in_small_windows(spark, monkeypatch):
    """With two levels no window over summaries holds more than FAN of them."""
    monkeypatch.setattr(C, "FAN", 8)
    sizes = []
    plain = C._carry

    def seen(summaries, by, specs, descending, levels):
        if levels == 1:
            keys = [F.col("_k").getField(b) for b in by]
            sizes.append(summaries.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return plain(summaries, by, specs, descending, levels)

    monkeypatch.setattr(C, "_carry", seen)
    hot = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("i"))
    out = C.chunked_scan(hot, ["g"], F.floor(F.col("i") / 10), ["i"], [C.RowNumber("n")], levels=3)
    assert out.filter("n <> i + 1").count() == 0 and max(sizes) <= 4000 / 10 / 64 + 1


@pytest.mark.parametrize("method", ["row_number", "rank", "dense_rank"])
def test_ranks_in_several_groupings(spark, method):
    rng = random.Random(2)
    data = [(i, rng.choice("ab"), rng.choice([None, "x", "y"]), rng.choice([None, *range(6)])) for i in range(300)]
    df = spark.createDataFrame(data, "id int, a string, b string, v int").withColumn("extra", F.col("id") * 2)
    got = ranked_in(df, {"all": [], "in_a": ["a"], "in_ab": ["a", "b"]}, "v", ["id"], ["id"], method)
    want = df
    for name, by in (("all", []), ("in_a", ["a"]), ("in_ab", ["a", "b"])):
        order = [F.desc_nulls_last("v"), "id"] if method == "row_number" else [F.desc_nulls_last("v")]
        r = getattr(F, method)().over(Window.partitionBy(*by).orderBy(*order))
        want = want.withColumn(name, F.when(F.col("v").isNotNull(), r).cast("long"))
    cols = ["id", "a", "b", "v", "extra", "all", "in_a", "in_ab"]
    assert sorted(map(str, got.select(*[F.col(c).cast("string") for c in cols]).collect())) == sorted(
        map(str, want.select(*[F.col(c).cast("string") for c in cols]).collect())
    )


def test_contained_names_need_one_hit_in_their_context(spark):
    names = [("p1", 2001, "A", "Aldo Marsh"), ("p1", 2001, "A", "Al Marsh"), ("p2", 2001, "B", "Bo Marshall"), ("p3", 2001, "C", "Aldo Marsh"),
             ("p4", 2002, "A", "Cy Reed"), ("p5", 2001, "A", None), ("p6", 2001, "B", "Xu")]
    known = spark.createDataFrame(names, "p_id string, year int, team string, name string")
    asked = [(1, 2001, "A", "B", "Marsh"), (2, 2001, "A", "D", "Marsh"), (3, 2001, "A", "C", "Aldo Marsh"), (4, 2001, "A", "B", "Cy Reed"),
             (5, 2002, "B", "A", "y Re"), (6, 2001, "A", "B", "Nobody"), (7, 2001, "A", "B", ""), (8, 2001, "A", "B", None), (9, 2001, "D", "A", "l"),
             (10, 2001, "B", "B", "Xu"), (11, 2001, "B", "A", "X"), (12, 2001, "A", "B", "marsh"), (13, 2001, "A", "D", "Al M")]
    mentions = spark.createDataFrame(asked, "k int, year int, home string, away string, who string")
    got = {r.k: (r.p_id, r.team) for r in J.resolve_contained(mentions, known, ["k"], "who", ["year"], ["home", "away"]).collect()}
    none = (None, None)
    assert got == {1: none, 2: ("p1", "A"), 3: none, 4: none, 5: ("p4", "A"), 6: none, 7: none, 8: none, 9: ("p1", "A"),
                   10: ("p6", "B"), 11: ("p6", "B"), 12: none, 13: ("p1", "A")}


def test_contained_names_against_all_pairs(spark):
    rng = random.Random(5)
    names = [(f"p{i}", rng.randint(0, 1), rng.randint(0, 3), " ".join("".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(2))) for i in range(60)]
    asked = [(k, rng.randint(0, 1), rng.randint(0, 3), rng.randint(0, 3), "".join(rng.choices("abc ", k=rng.randint(0, 5)))) for k in range(300)]
    known = spark.createDataFrame(names, "p_id string, year int, team int, name string")
    mentions = spark.createDataFrame(asked, "k int, year int, home int, away int, who string")
    got = {r.k: r.p_id for r in J.resolve_contained(mentions, known, ["k"], "who", ["year"], ["home", "away"]).collect()}
    for k, year, home, away, who in asked:
        hits = {p for p, y, t, n in names if y == year and t in (home, away) and who and who in n}
        assert got[k] == (hits.pop() if len(hits) == 1 else None)


def test_common_mentions_meet_one_row_per_team(spark):
    """A mention that many names contain is folded before the plays ask for it."""
    names = [(f"p{i:04}", 2001, i % 3, f"Al M{i:04} Jr") for i in range(600)] + [("q", 2001, 7, "Cy Jr")]
    known = spark.createDataFrame(names, "p_id string, year int, team int, name string")
    asked = [(k, 2001, k % 3, 7 if k % 2 else 8, "Jr") for k in range(400)] + [(400, 2001, 7, 8, "Jr"), (401, 2001, 1, 2, "M0004 J")]
    mentions = spark.createDataFrame(asked, "k int, year int, home int, away int, who string")
    fits = {(r.who, r.team): (r._lo, r._hi) for r in J.contained_in(mentions, known, "who", ["year"]).collect()}
    assert fits == {("Jr", 0): ("p0000", "p0597"), ("Jr", 1): ("p0001", "p0598"), ("Jr", 2): ("p0002", "p0599"), ("Jr", 7): ("q", "q"), ("M0004 J", 1): ("p0004", "p0004")}
    got = {r.k: (r.p_id, r.team) for r in J.resolve_contained(mentions, known, ["k"], "who", ["year"], ["home", "away"]).collect()}
    assert got == {k: (None, None) for k in range(400)} | {400: ("q", 7), 401: ("p0004", 1)}


def test_names_meet_on_whole_mentions(spark):
    """Candidates are the hits, however many names share every three letters."""
    names = spark.createDataFrame([(f"Al Mabc{a}{b}",) for a in "abcdefgh" for b in "abcdefgh"], "name string")
    wanted = spark.createDataFrame([("Al Mabcab",), ("Mabcgh",)], "who string")
    spelled = names.withColumn("_nid", F.monotonically_increasing_id())
    met = J.pieces(spelled, wanted, "name", "who").join(wanted.withColumn("_hash", F.xxhash64("who")), "_hash").join(spelled, "_nid")
    assert sorted((r.who, r.name) for r in met.collect()) == [("Al Mabcab", "Al Mabcab"), ("Mabcgh", "Al Mabcgh")]


def test_array_means_element_by_element(spark):
    data = [(1, 1, 10, [1, 2]), (1, 2, 11, [3]), (1, 3, 12, None), (1, 4, 13, [5, 8])]
    df = spark.createDataFrame(data, "t int, period int, match_id int, q array<int>")
    got = {r.period: r.m for r in H.last_n_array_means(df, ["t"], {"m": F.col("q")}, 2, 2).collect()}
    assert got == {1: [1, 2], 2: [2, 2], 3: [3, None], 4: [5, 8]}


def test_file_names_survive_odd_values(spark, tmp_path):
    values = ["plain", "two words", "50% off", "a+b", "x.y", "é", "a/b:c", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(9, "plain")], "i int, v string")
    path = str(tmp_path / "named")
    S.write_named(df, path, "v")
    got = {r.i: r.v for r in S.read_directory(spark, path, "i int", S.file_stem(), "v").collect()}
    assert got == {0: "plain", 1: "two words", 2: "50% off", 3: "a+b", 4: "x.y", 5: "é", 6: "a-b-c", 7: "null", 9: "plain"}
