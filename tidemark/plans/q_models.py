"""Statistics and models."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import quality as Q
from tidemark.plans.registry import query
from tidemark.plans.testbed import Tables, views
from tidemark.session import stored

NUM = ["home_points", "away_points", "home_yards", "away_yards", "home_attempts", "away_attempts", "home_turnovers", "away_turnovers"]
FEATURES = ["home_yards", "away_yards", "home_attempts", "away_attempts", "home_turnovers", "away_turnovers"]
TARGETS = ["home_points", "away_points", "home_win"]


def wide(t: Tables) -> DataFrame:
    m = t.matches
    return m.select("match_id", *[F.col(c).cast("double").alias(c) for c in NUM], F.coalesce((m.winner == m.home).cast("int"), F.lit(0)).alias("home_win"))


def wide_once(t: Tables) -> DataFrame:
    """The same table written once: a fit passes over its rows many times, and the
    facts are folded for the first pass only."""
    return stored(wide(t))


@query(
    "ML-1 R-10",
    views("matches") + " , c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, home_points) AS r FROM matches" for c in NUM[1:])
    + ") SELECT feature, round(r, 6) AS correlation FROM c ORDER BY abs(r) DESC LIMIT 5",
)
def top_correlations(t: Tables) -> DataFrame:
    r = M.correlations(wide(t), NUM[1:], "home_points")
    return r.orderBy(F.abs("correlation").desc()).limit(5).select("feature", F.round("correlation", 6).alias("correlation"))


@query(
    "ML-1",
    views("matches") + ", c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM matches" for i, a in enumerate(NUM) for b in NUM[i + 1 :])
    + ") SELECT a, b, round(r, 6) AS correlation FROM c WHERE abs(r) > 0.2",
)
def correlated_pairs(t: Tables) -> DataFrame:
    return M.correlated_pairs(wide(t), NUM, 0.2).withColumn("correlation", F.round("correlation", 6))


@query("ML-2")
def p_value_selection(t: Tables) -> DataFrame:
    """OLS p-value per column and whether it stays at 0.2."""
    values = M.p_values(wide_once(t), FEATURES, "home_points")
    return t.spark.createDataFrame([(c, round(p, 6), p <= 0.2) for c, p in values.items()], "feature string, p_value double, kept boolean")


@query(
    "ML-3 SL-14",
    views("matches") + " SELECT match_id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM matches)) / (SELECT stddev_samp({c}) FROM matches), 6) AS {c}" for c in FEATURES) + " FROM matches",
)
def scaled_features(t: Tables) -> DataFrame:
    """Mean 0 and sample deviation 1 per column."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    cols = FEATURES
    data = M.assembled(wide(t).select("match_id", *cols), cols)
    out = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(data).transform(data)
    v = vector_to_array("scaled")
    return out.select("match_id", *[F.round(v[i], 6).alias(c) for i, c in enumerate(cols)])


@query("ML-4 ML-5 ML-14 ML-16")
def home_win_probability(t: Tables) -> DataFrame:
    """Logistic model on the training part, wrong predictions of the hold-out with probability."""
    df = wide_once(t)
    train, test = M.split(df, ["match_id"])
    model = M.fit(train, FEATURES, "home_win", M.classifier())
    out = M.score(model, test, ["match_id", "home_win"], "prediction", probability=True)
    return Q.wrong_predictions(out, df.select("match_id", *FEATURES), ["match_id"], "home_win", "prediction")


@query(
    "ML-6",
    views("matches") + ", m AS (SELECT regr_slope(home_points, home_attempts) AS s, regr_intercept(home_points, home_attempts) AS i FROM matches) SELECT match_id, round(i + s * home_attempts, 4) AS prediction FROM matches, m",
)
def linear_prediction(t: Tables) -> DataFrame:
    """Least-squares model over a scaled column, scored on the spine."""
    df = wide(t).select("match_id", "home_points", "home_attempts")
    model = M.fit(df, ["home_attempts"], "home_points", M.regressor())
    return M.score(model, df, ["match_id"], "prediction").withColumn("prediction", F.round("prediction", 4))


@query("ML-7 ML-9")
def stacked_models(t: Tables) -> DataFrame:
    """Forest and logistic predictions as features of a final model."""
    df = wide_once(t)
    base = {"by_forest": M.classifier("forest"), "by_logistic": M.classifier()}
    return M.stack(df, ["match_id"], FEATURES, "home_win", base, M.classifier())


@query(
    "ML-8 ML-17",
    views("outings") + " SELECT position, round(regr_slope(points, attempts), 6) AS slope, round(regr_intercept(points, attempts), 6) AS intercept, round(regr_r2(points, attempts), 6) AS r2 FROM outings WHERE points BETWEEN 2 AND 38 GROUP BY 1",
)
def model_per_role(t: Tables) -> DataFrame:
    """One line per role, outliers cut, fitted as an aggregate."""
    out = M.grouped_line(t.outings.filter(F.col("points").between(2, 38)), ["position"], "attempts", "points")
    return out.select("position", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


_PLANE = """, c AS (SELECT position, avg(points) AS my, avg(attempts) AS m1, avg(yards) AS m2, var_pop(attempts) AS v1, var_pop(yards) AS v2, covar_pop(attempts, yards) AS v12,
      covar_pop(attempts, points) AS c1, covar_pop(yards, points) AS c2 FROM outings WHERE {rows} GROUP BY 1),
    b AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM c)"""


@query(
    "ML-8",
    views("outings") + _PLANE.format(rows="true") + " SELECT position, round(my - b1 * m1 - b2 * m2, 6) AS intercept, round(b1, 6) AS by_attempts, round(b2, 6) AS by_yards FROM b",
)
def planes_per_role(t: Tables) -> DataFrame:
    """Model on several columns per role, fitted from one aggregate."""
    out = M.grouped_planes(t.outings, ["position"], ["attempts", "yards"], "points")
    b = F.col("coefficients")
    return out.select("position", F.round("intercept", 6).alias("intercept"), F.round(b[0], 6).alias("by_attempts"), F.round(b[1], 6).alias("by_yards"))


@query(
    "ML-15 ML-8",
    views("outings") + _PLANE.format(rows="match_id % 10 <> 0")
    + " SELECT match_id, player, round(CASE WHEN match_id % 10 <> 0 THEN points ELSE my + b1 * (attempts - m1) + b2 * (yards - m2) END, 4) AS points FROM outings JOIN b USING (position)",
)
def imputed_by_columns(t: Tables) -> DataFrame:
    """Missing points from the role's model on several columns."""
    holed = t.outings.select("match_id", "player", "position", "attempts", "yards", F.when(F.col("match_id") % 10 != 0, F.col("points")).alias("points"))
    out = M.impute_with_planes(holed, ["position"], ["attempts", "yards"], "points")
    return out.select("match_id", "player", F.round("points", 4).alias("points"))


@query("ML-10")
def best_split(t: Tables) -> DataFrame:
    """Best of the reference's 50 random splits."""
    seed, accuracy = M.best_of_splits(wide_once(t), ["match_id"], FEATURES, "home_win", M.classifier, range(50))
    return t.spark.createDataFrame([(seed, accuracy)], "seed int, accuracy double")


_POOLED = """, classes AS (SELECT points AS c, count(*) AS n FROM outings WHERE points IS NOT NULL GROUP BY 1),
    rows_ AS (SELECT o.position, CASE WHEN n >= (SELECT count(*) FROM outings) / 40 THEN points::DOUBLE ELSE -1 END AS c FROM outings o JOIN classes ON c = points)"""


@query(
    "ML-5 ML-13",
    views("outings") + _POOLED + """, g AS (SELECT position, count(*) AS n FROM rows_ GROUP BY 1), k AS (SELECT DISTINCT c FROM rows_),
    s AS (SELECT position, c, count(*) AS m FROM rows_ GROUP BY ALL)
    SELECT position, c AS class, round(coalesce(m, 0) / n, 2) AS probability FROM g CROSS JOIN k LEFT JOIN s USING (position, c)""",
)
def class_shares_by_role(t: Tables) -> DataFrame:
    """Softmax model of exact points on one-hot roles alone: its probabilities are the
    shares of the classes per role.  Classes below a fortieth of all rows are pooled."""
    rows = t.outings.filter("points IS NOT NULL").select("position", "points")
    least = -(-rows.count() // 40)
    hot = stored(M.encode(M.pooled_classes(rows, "points", least), "position"))
    cols = [c for c in hot.columns if c.startswith("is_")]
    model = M.fit_multinomial(hot, cols, "points")
    roles = hot.select("position", *cols).distinct()
    return model.probabilities(roles, ["position"]).withColumn("probability", F.round("probability", 2))


@query("ML-5 ML-4")
def exact_points_probabilities(t: Tables) -> DataFrame:
    """Probability of every exact home score for the matches held out; scores below a
    hundredth of the training rows are one class (-1)."""
    df = wide_once(t)
    train, test = M.split(df, ["match_id"])
    pooled = stored(M.pooled_classes(train, "home_points", max(1, train.count() // 100)))
    model = M.fit_multinomial(pooled, FEATURES, "home_points", iterations=50, tol=1e-6)
    return model.probabilities(test, ["match_id"], "home_points").withColumn("probability", F.round("probability", 6))


@query("ML-11")
def grid_search(t: Tables) -> DataFrame:
    """Forests of several sizes and depths, five shared folds and a split of 80 to 20."""
    grid = [{"numTrees": n, "maxDepth": d} for n in (5, 10) for d in (3, 5)]
    rows = M.forest_grid(wide_once(t), ["match_id"], FEATURES, "home_win", grid)
    found = [(g["numTrees"], g["maxDepth"], round(a, 6), round(h, 6)) for g, (_, a, h) in zip(grid, rows)]
    return t.spark.createDataFrame(found, "trees int, depth int, fold_accuracy double, test_accuracy double")


STRENGTHS = [0.0, 0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0]
_PART = "CASE WHEN ('0x' || md5(':' || match_id)[1:8])::BIGINT % 100 < 20 THEN -1 ELSE ('0x' || md5('fold:' || match_id)[1:8])::BIGINT % 5 END"


@query(
    "ML-11 ML-6",
    views("matches") + f""", d AS (SELECT home_attempts::DOUBLE AS x, home_points::DOUBLE AS y, {_PART} AS part FROM matches),
    s AS (SELECT unnest({STRENGTHS}) AS strength), f AS (SELECT unnest([0, 1, 2, 3, 4, -1]) AS held),
    m AS (SELECT strength, held, covar_pop(y, x) / var_pop(x) / (1 + strength) AS w, avg(x) AS mx, avg(y) AS my
        FROM s CROSS JOIN f JOIN d ON part <> held AND part <> -1 GROUP BY strength, held),
    e AS (SELECT strength, held, 1 - avg((y - my - w * (x - mx)) * (y - my - w * (x - mx))) / var_pop(y) AS r2 FROM m JOIN d ON part = held GROUP BY strength, held)
    SELECT strength, round(avg(r2) FILTER (held >= 0), 5) AS fold_r2, round(max(r2) FILTER (held = -1), 5) AS test_r2 FROM e GROUP BY 1""",
)
def ridge_grid(t: Tables) -> DataFrame:
    """Grid over the strength of a ridge model, five folds from products folded once."""
    rows = M.ridge_path(wide(t), ["match_id"], ["home_attempts"], "home_points", STRENGTHS)
    return t.spark.createDataFrame([(s, round(a, 5), round(b, 5)) for s, a, b in rows], "strength double, fold_r2 double, test_r2 double")


def _seasons(t: Tables) -> DataFrame:
    return wide(t).join(t.matches.select("match_id", "season"), "match_id")


@query(
    "ML-12 ML-6",
    views("matches") + """, d AS (SELECT season, home_attempts::DOUBLE AS x, (winner IS NOT DISTINCT FROM home)::INT::DOUBLE AS y,
        ('0x' || md5(':' || match_id)[1:8])::BIGINT % 100 < 20 AS test FROM matches),
    starts AS (SELECT DISTINCT season AS start FROM matches),
    m AS (SELECT start, regr_slope(y, x) AS w, regr_intercept(y, x) AS b, count(*) AS train_rows FROM starts JOIN d ON season >= start AND NOT test GROUP BY 1)
    SELECT start, train_rows, count(*) AS test_rows, round(1 - avg((y - b - w * x) * (y - b - w * x)) / var_pop(y), 5) AS r2,
        round(avg(((b + w * x >= 0.5) = (y >= 0.5))::INT), 6) AS accuracy
    FROM m JOIN d ON season >= start AND test GROUP BY start, train_rows""",
)
def start_seasons(t: Tables) -> DataFrame:
    """Model per start season, all from one pass over the matches."""
    df = stored(_seasons(t))
    starts = [r[0] for r in df.select("season").distinct().orderBy("season").collect()]
    rows = M.start_sweep(df, ["match_id"], ["home_attempts"], "home_win", starts)
    found = [(s, a, b, round(r, 5), round(c, 6)) for s, a, b, r, c in rows]
    return t.spark.createDataFrame(found, "start long, train_rows long, test_rows long, r2 double, accuracy double")


@query("ML-12")
def start_seasons_wide(t: Tables) -> DataFrame:
    """The start-season sweep with every feature column."""
    df = stored(_seasons(t))
    starts = [r[0] for r in df.select("season").distinct().orderBy("season").collect()]
    rows = M.start_sweep(df, ["match_id"], FEATURES, "home_win", starts)
    return t.spark.createDataFrame(rows, "start long, train_rows long, test_rows long, r2 double, accuracy double")


@query("ML-12")
def threshold_sweep(t: Tables) -> DataFrame:
    """The reference's nine thresholds for every target column, by hold-out accuracy."""
    df, rows = wide_once(t), []
    for target in TARGETS:
        found = M.threshold_sweep(df, ["match_id"], FEATURES, target, [i / 20 for i in range(1, 10)])
        rows += [(target, *r) for r in found]
    return t.spark.createDataFrame(rows, "target string, threshold double, kept int, accuracy double")


@query(
    "ML-13",
    "SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment_index, "
    + ", ".join(f"(c_mktsegment = '{s}')::INT AS is_{s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
)
def encoded_segments(t: Tables) -> DataFrame:
    """Alphabetical index and one-hot columns."""
    return M.encode(t.table("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    "ML-15",
    views("outings") + """, d AS (SELECT match_id, position, attempts, CASE WHEN match_id % 7 <> 0 THEN points END AS points FROM outings),
    m AS (SELECT position, regr_slope(points, attempts) AS s, regr_intercept(points, attempts) AS i FROM d WHERE points IS NOT NULL GROUP BY 1)
    SELECT match_id, round(coalesce(points, i + s * attempts), 6) AS points FROM d JOIN m USING (position)""",
)
def imputed_by_model(t: Tables) -> DataFrame:
    """Missing values predicted from the rows that have them."""
    d = t.outings.select("match_id", "position", "attempts", F.when(F.col("match_id") % 7 != 0, F.col("points")).alias("points"))
    return M.impute_with_line(d, ["position"], "attempts", "points").select("match_id", F.round("points", 6).alias("points"))


@query(
    "ML-18",
    "SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS missing_column, (SELECT count(*) FROM orders) AS rows_affected",
)
def column_parity(t: Tables) -> DataFrame:
    """Columns of the training table that the scoring table lacks."""
    orders = t.table("orders")
    missing, _ = Q.column_parity(orders, orders.select("o_custkey"))
    return orders.agg(F.count(F.lit(1)).alias("rows_affected")).select(F.explode(F.array(*[F.lit(c) for c in missing])).alias("missing_column"), "rows_affected")


@query("T-25")
def vector_clusters(t: Tables) -> DataFrame:
    """Clusters of vectors with the member nearest to each centre as exemplar."""
    e = t.table("embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=8, seed=1, maxIter=10).fit(e)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    from pyspark.ml.functions import vector_to_array

    p = model.transform(e).select("vec_id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("v"))
    gap = F.aggregate(F.zip_with("v", F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return p.groupBy("cluster").agg(F.min_by("vec_id", F.struct(gap.alias("gap"), "vec_id")).alias("exemplar"), F.count(F.lit(1)).alias("members"))
