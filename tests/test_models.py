"""Models: candidates, softmax, products folded once, sweeps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import models as M
from tidemark.plans import q_models

SF = "/root/testdata/sf0.001"


def test_best_split_tries_fifty_seeds(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(M, "best_of_splits", lambda *a: (tried.extend(a[-1]), (0, 0.0))[1])
    entry.queries()["best_split"](spark, SF)
    assert len(set(tried)) == 50


def test_threshold_sweep_has_all_targets_and_thresholds(spark):
    rows = entry.queries()["threshold_sweep"](spark, SF).collect()
    got = [(r.target, r.threshold) for r in rows]
    assert got == [(c, pytest.approx(i / 20)) for c in q_models.TARGETS for i in range(1, 10)]
    assert all(r.kept >= 1 and 0 <= r.accuracy <= 1 for r in rows)


def test_rare_classes_are_pooled_by_count(spark):
    d = spark.createDataFrame([(x,) for x in [3] * 5 + [4] * 4 + [7, 7, None]], "y int")
    got = {r.y: r["count"] for r in M.pooled_classes(d, "y", 4).groupBy("y").count().collect()}
    assert got == {3.0: 5, 4.0: 4, -1.0: 2, None: 1}


@pytest.fixture(scope="module")
def three_classes(spark):
    rng, rows = random.Random(1), []
    for i in range(900):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        scores = np.array([0.0, 1.5 * a, 0.5 - b])
        p = np.exp(scores) / np.exp(scores).sum()
        rows.append((i, a, b, float(rng.choices([10, 20, 35], p)[0])))
    return spark.createDataFrame(rows, "id int, a double, b double, y double")


def test_softmax_gives_a_distribution_per_row(spark, three_classes, tmp_path):
    model = M.fit_multinomial(three_classes, ["a", "b"], "y")
    p = model.probabilities(three_classes, ["id"], "y")
    sums = p.groupBy("id").agg(F.sum("probability").alias("s"), F.count(F.lit(1)).alias("n")).agg(F.min("s"), F.max("s"), F.min("n")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1) and sums[2] == 3
    # At the optimum the mean probability of a class is its share.
    share = {r.y: r["count"] / 900 for r in three_classes.groupBy("y").count().collect()}
    mean = {r.y: r.m for r in p.groupBy("y").agg(F.avg("probability").alias("m")).collect()}
    assert mean == pytest.approx(share, abs=1e-3)
    assert M.class_accuracy(model.predictions(three_classes, ["id", "y"]), "y") > max(share.values()) + 0.05
    model.save(str(tmp_path / "m"))
    again = M.Multinomial.load(str(tmp_path / "m")).predictions(three_classes, ["id"])
    assert again.exceptAll(model.predictions(three_classes, ["id"])).count() == 0


def test_softmax_of_one_class(spark):
    d = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 9.0)], "a double, y double")
    assert [(r["class"], r.probability) for r in M.fit_multinomial(d, ["a"], "y").probabilities(d.limit(1), ["a"]).collect()] == [(5.0, 1.0)]


def least_squares(rows, ridge=0.0):
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    mx, sx = x.mean(0), x.std(0)
    z = (x - mx) / sx
    beta = np.linalg.solve(z.T @ z / len(y) + ridge * np.eye(2), z.T @ (y - y.mean()) / len(y)) / sx
    return y.mean() - beta @ mx, beta


@pytest.fixture(scope="module")
def seasons(spark):
    rng, rows = random.Random(2), []
    for i in range(600):
        a, b = rng.gauss(50, 3), rng.gauss(-2, 1)
        rows.append((i, 2000 + i % 8, a, b, float(rng.random() < 1 / (1 + np.exp(-(a - 50 - b - 2))))))
    rows += [(900, 2001, None, 1.0, 1.0), (901, None, 50.0, 1.0, 0.0)]
    return spark.createDataFrame(rows, "id int, season int, a double, b double, y double")


def test_all_start_seasons_come_from_one_fold(spark, seasons):
    rows = seasons.withColumn("test", M.bucket(["id"], 100) < 20).dropna().collect()
    for start, n, m, r2, accuracy in M.start_sweep(seasons, ["id"], ["a", "b"], "y", range(2000, 2008)):
        train = [(r.a, r.b, r.y) for r in rows if r.season >= start and not r.test]
        test = [(r.a, r.b, r.y) for r in rows if r.season >= start and r.test]
        b, w = least_squares(train)
        value = np.array([b + w @ np.array(r[:2]) for r in test])
        y = np.array([r[2] for r in test])
        assert (n, m) == (len(train), len(test))
        assert r2 == pytest.approx(1 - ((y - value) ** 2).mean() / y.var(), abs=1e-7)
        assert accuracy == pytest.approx(((value >= 0.5) == (y >= 0.5)).mean())


def test_ridge_path_leaves_each_fold_out(spark, seasons):
    rows = seasons.withColumns({"test": M.bucket(["id"], 100) < 20, "fold": M.bucket(["id"], 5, "fold")}).dropna(subset=["a", "b", "y"]).collect()
    inner = [r for r in rows if not r.test]
    score = lambda m, part: 1 - np.mean([(r.y - m[0] - m[1] @ np.array([r.a, r.b])) ** 2 for r in part]) / np.var([r.y for r in part])
    for strength, folds, held in M.ridge_path(seasons, ["id"], ["a", "b"], "y", [0.0, 0.3, 4.0]):
        want = []
        for f in range(5):
            model = least_squares([(r.a, r.b, r.y) for r in inner if r.fold != f], strength)
            want.append(score(model, [r for r in inner if r.fold == f]))
        assert folds == pytest.approx(np.mean(want), abs=1e-7)
        model = least_squares([(r.a, r.b, r.y) for r in inner], strength)
        assert held == pytest.approx(score(model, [r for r in rows if r.test]), abs=1e-7)


def test_forest_grid_shares_its_folds(spark, seasons):
    rows = M.forest_grid(seasons.dropna(), ["id"], ["a", "b"], "y", [{"numTrees": 3, "maxDepth": 1}, {"numTrees": 5, "maxDepth": 3}], folds=2)
    assert [r[0] for r in rows] == [0, 1] and all(0.5 < a <= 1 and 0.5 < h <= 1 for _, a, h in rows)


def test_all_splits_are_fitted_at_once(spark, seasons, monkeypatch):
    df, seeds = seasons.filter("id < 900").cache(), list(range(70))  # more than the bits of one long
    want = {}
    for seed in (0, 33, 69):
        train, test = M.split(df, ["id"], seed=seed)
        out = M.score(M.fit(train, ["a", "b"], "y", M.classifier()), test, ["id", "y"], "p").collect()
        want[seed] = sum(r.p == r.y for r in out) / len(out)
    monkeypatch.setattr(M, "fit", None)  # no fit per seed
    got = M.split_accuracies(df, ["id"], ["a", "b"], "y", seeds)
    assert set(got) == set(seeds) and {s: got[s] for s in want} == pytest.approx(want, abs=0.01)
    assert M.best_of_splits(df, ["id"], ["a", "b"], "y", M.classifier, seeds) == max((a, s) for s, a in got.items())[::-1]


def test_splits_of_odd_rows(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 5), 3.0, 1) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, a double, c double, y int")
    got = M.split_accuracies(d, ["id"], ["a", "c"], "y", [1, 2])
    assert got == {1: 1.0, 2: 1.0}  # one label only: always that one
    mixed = d.withColumn("y", F.when(F.col("a").isNull(), 0).otherwise((F.col("a") > 1).cast("int")))
    assert M.split_accuracies(mixed, ["id"], ["a", "c"], "y", [1, 2]) == {1: 1.0, 2: 1.0}  # split by a line; null rows are 0


def test_forest_grid_scales_once_per_fold(spark, seasons, monkeypatch):
    df, grid, made = seasons.dropna().cache(), [{"numTrees": 3, "maxDepth": 1}, {"numTrees": 5, "maxDepth": 3}], []
    train = df.filter(M.bucket(["id"], 100) >= 20)
    test = df.filter(M.bucket(["id"], 100) < 20)
    model = M.fit(train, ["a", "b"], "y", M.classifier("forest", **grid[1]))
    want = model.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    scaler = M.StandardScaler
    monkeypatch.setattr(M, "StandardScaler", lambda **a: (made.append(1), scaler(**a))[1])
    rows = M.forest_grid(df, ["id"], ["a", "b"], "y", grid, folds=2)
    assert len(made) == 3 and rows[1][2] == pytest.approx(want)
