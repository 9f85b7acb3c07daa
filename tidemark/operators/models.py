"""Column selection, scaling and models over wide feature tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stored


def correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with the target, as rows; one pass."""
    one = df.agg(*[F.corr(c, target).alias(c) for c in cols])
    return one.unpivot([], list(cols), "feature", "correlation")


def correlated_pairs(df: DataFrame, cols: Sequence[str], above: float = 0.5) -> DataFrame:
    """Pairs of columns whose correlation exceeds ``above`` in size."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "correlation")
    split = F.split("pair", r"\|")
    return long.filter(F.abs("correlation") > above).select(split[0].alias("a"), split[1].alias("b"), "correlation")


def varying(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with more than one value (a constant column has no p-value)."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return [c for c in cols if row[f"lo_{c}"] is not None and row[f"lo_{c}"] != row[f"hi_{c}"]]


def assembled(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(df)
    return out if label is None else out.withColumn("label", F.col(label).cast("double"))


def p_values(df: DataFrame, cols: Sequence[str], label: str) -> dict[str, float]:
    """OLS p-value per column; a column that never varies counts as 1.

    Sums of products of the centred columns are one aggregate (columns x
    columns); its pseudo-inverse gives dependent columns the same finite error
    instead of none.  Rows with a null or NaN in a used column are left out.
    """
    used = varying(df, cols)
    p = dict.fromkeys(cols, 1.0)
    if not used:
        return p
    data = df.select(*[F.col(c).cast("double").alias(c) for c in used], F.col(label).cast("double").alias("_y")).dropna()
    names = [*used, "_y"]
    means = data.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in names]).first()
    centred = data.select(*[(F.col(c) - means[c]).alias(c) for c in names])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = centred.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(names), len(names)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"{i}_{j}"] or 0.0
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    gram = gram / np.outer(scale, scale)
    x, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    inverse = np.linalg.pinv(x, rcond=1e-10, hermitian=True)
    freedom = means["_n"] - np.linalg.matrix_rank(x, tol=1e-10, hermitian=True) - 1
    if freedom < 1:
        return p
    beta = inverse @ xy
    # An exact fit leaves rounding only; the floor keeps that from looking like an effect.
    left = max(float(yy - beta @ xy), 1e-14 * float(yy)) / freedom
    error = np.sqrt(np.maximum(np.diag(inverse) * left, 0.0))
    t = df.sparkSession._jvm.org.apache.commons.math3.distribution.TDistribution(float(freedom))
    for c, b, e in zip(used, beta.tolist(), error.tolist()):
        p[c] = 2 * t.cumulativeProbability(-abs(b / e)) if e > 0 else float(b == 0)
    return p


def select_columns(df: DataFrame, cols: Sequence[str], label: str, threshold: float) -> list[str]:
    """Columns at or below the p-value threshold; all of them if none is."""
    kept = [c for c, p in p_values(df, cols, label).items() if p <= threshold]
    return kept or list(cols)


def split(df: DataFrame, keys: Sequence[str], test_percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Reproducible split by a hash of the key, independent of the layout."""
    bucket = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(100))
    return df.filter(bucket >= test_percent), df.filter(bucket < test_percent)


def classifier(kind: str = "logistic", **params):
    if kind == "logistic":
        return LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=20, **params)
    return RandomForestClassifier(featuresCol="scaled", labelCol="label", **{"numTrees": 10, "maxDepth": 4, "seed": 1, **params})


def regressor(kind: str = "linear", **params):
    if kind == "linear":
        return LinearRegression(featuresCol="scaled", labelCol="label", solver="normal", **params)
    return RandomForestRegressor(featuresCol="scaled", labelCol="label", **{"numTrees": 10, "maxDepth": 4, "seed": 1, **params})


def scaling(cols: Sequence[str]) -> list:
    """Assemble and scale (mean 0, sample deviation 1)."""
    return [
        VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
    ]


def fit(df: DataFrame, cols: Sequence[str], label: str, model) -> PipelineModel:
    """Assemble, scale (mean 0, sample deviation 1) and fit one model."""
    data = df.select(*cols, F.col(label).cast("double").alias("label")).dropna()
    prepared = Pipeline(stages=scaling(cols)).fit(data)
    scaled = prepared.transform(data).select("scaled", "label")
    if isinstance(model, LinearRegression) and model.getSolver() == "normal":
        # One pass: nothing is kept, which would take 8 bytes for each figure.
        return PipelineModel([*prepared.stages, model.fit(scaled)])
    # Other fits pass over their rows many times; they are assembled for the first only.
    scaled = scaled.persist()
    try:
        return PipelineModel([*prepared.stages, model.fit(scaled)])
    finally:
        scaled.unpersist()


def score(model: PipelineModel, df: DataFrame, keys: Sequence[str], name: str, probability: bool = False) -> DataFrame:
    """Keys with the prediction (and the probability of class 1)."""
    out = model.transform(df)
    cols = [F.col("prediction").alias(name)]
    if probability:
        cols.append(vector_to_array("probability")[1].alias(f"{name}_probability"))
    return out.select(*keys, *cols)


def stack(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str, base: dict[str, object], final) -> DataFrame:
    """Predictions of the base models become features of the final one."""
    wide = df
    for name, model in base.items():
        fitted = fit(df, cols, label, model)
        wide = fitted.transform(wide).withColumn(name, F.col("prediction")).select(*wide.columns, name)
    last = fit(wide, [*cols, *base], label, final)
    return score(last, wide, keys, "prediction")


def best_of_splits(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str, make: Callable, seeds: Sequence[int]) -> tuple[int, float]:
    """Seed whose split gives the best hold-out accuracy.

    Logistic models of a 0/1 label without a penalty are fitted for all seeds at once
    (:func:`split_accuracies`); other models are fitted one by one."""
    model = make()
    span = df.agg(F.min(label), F.max(label), F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1))).first()
    if isinstance(model, LogisticRegression) and not model.getRegParam() and span[0] is not None and not span[2]:
        best = max((a, seed) for seed, a in split_accuracies(df, keys, cols, label, seeds).items())
        return best[1], best[0]
    scores = []
    for seed in seeds:
        train, test = split(df, keys, seed=seed)
        out = fit(train, cols, label, make()).transform(test.withColumn("label", F.col(label).cast("double")))
        scores.append((MulticlassClassificationEvaluator(metricName="accuracy").evaluate(out), seed))
    best = max(scores)
    return best[1], best[0]


def split_accuracies(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str, seeds: Sequence[int], test_percent: int = 20, iterations: int = 25, tol: float = 1e-9
) -> dict[int, float]:
    """Hold-out accuracy of a logistic model of a 0/1 label per seed of :func:`split`.

    A row carries one bit per seed, set where it is held out; Newton's method then needs
    one pass a step for the models of all seeds.  A batch of rows gives every seed's
    gradient and matrix of second derivatives, which are summed by position: columns
    times columns figures a seed come to the driver, whatever the number of rows.  Rows
    with a null in a used column are no training rows and are predicted as 0."""
    found: dict[int, float] = {}
    seeds = list(dict.fromkeys(seeds))
    for at in range(0, len(seeds), 60):  # a long holds the bits of some 60 seeds
        found |= _split_accuracies(df, keys, cols, label, seeds[at : at + 60], test_percent, iterations, tol)
    return found


def _split_accuracies(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str, seeds: Sequence[int], test_percent: int, iterations: int, tol: float) -> dict[int, float]:
    held = [F.pmod(F.xxhash64(*keys, F.lit(s)), F.lit(100)) < test_percent for s in seeds]
    bits = F.aggregate(
        F.array(*[F.when(h, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, h in enumerate(held)]), F.lit(0).cast("long"), lambda a, b: a + b
    )
    rows = stored(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y"), bits.alias("held")))
    xs = [f"x{i}" for i in range(len(cols))]
    known = rows.dropna(subset=xs)
    # One scale for all splits: it keeps the steps well conditioned and changes no fit.
    span = known.agg(*[F.avg(c).alias(f"m{c}") for c in xs], *[F.stddev_samp(c).alias(f"s{c}") for c in xs]).first()
    mean, deviation = (np.array([span[f"{w}{c}"] or 0.0 for c in xs]) for w in "ms")
    deviation[~(deviation > 0)] = np.inf  # a constant column weighs nothing
    k, n = len(cols) + 1, len(seeds)
    upper = np.triu_indices(k)
    shifts = np.arange(n, dtype="int64")

    def matrices(pdf):
        x = np.column_stack([np.ones(len(pdf)), (pdf[xs].to_numpy(dtype=float) - mean) / deviation])
        return x, pdf["y"].to_numpy(dtype=float), (pdf["held"].to_numpy()[:, None] >> shifts) & 1 == 1

    def summed(source: DataFrame, part: Callable, size: int) -> np.ndarray:
        """Sums of what ``part`` makes of each batch."""

        def batches(frames):
            total = np.zeros(size)
            for pdf in frames:
                total += part(pdf)
            yield pd.DataFrame({"i": np.arange(size), "v": total})

        out = np.zeros(size)
        for r in source.mapInPandas(batches, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    def steps(weights: np.ndarray) -> Callable:
        def part(pdf) -> np.ndarray:
            x, y, out = matrices(pdf)
            margin = x @ weights
            p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            loss = np.logaddexp(0, margin) - y[:, None] * margin
            used = np.where(out, 0.0, 1.0)
            return np.concatenate(
                [(loss * used).sum(0), (x.T @ ((y[:, None] - p) * used)).ravel(), ((x[:, upper[0]] * x[:, upper[1]]).T @ (p * (1 - p) * used)).ravel(), used.sum(0), used.T @ y]
            )

        return part

    weights, before = np.zeros((k, n)), np.full(n, np.inf)
    step, damped = np.zeros((k, n)), np.ones(n)
    moving = np.ones(n, dtype=bool)
    for _ in range(iterations):
        flat = summed(known, steps(weights), n * (1 + k + len(upper[0]) + 2))
        loss, flat = flat[:n], flat[n:]
        gradient, flat = flat[: k * n].reshape(k, n), flat[k * n :]
        second, count, ones = flat[: len(upper[0]) * n].reshape(-1, n), flat[-2 * n : -n], flat[-n:]
        moving &= (ones > 0) & (ones < count)  # a split that trains on one label has no finite fit
        worse = moving & ~(loss <= before * (1 + 1e-12))
        for j in np.flatnonzero(moving):
            if worse[j]:  # overshot: half of the step back
                damped[j] /= 2
                weights[:, j] -= step[:, j] * damped[j]
                continue
            if before[j] - loss[j] <= tol * max(loss[j], 1e-300) and np.isfinite(before[j]):
                moving[j] = False
                continue
            matrix = np.zeros((k, k))
            matrix[upper] = second[:, j]
            matrix = matrix + np.triu(matrix, 1).T
            step[:, j], damped[j], before[j] = np.linalg.pinv(matrix, rcond=1e-12, hermitian=True) @ gradient[:, j], 1.0, loss[j]
            weights[:, j] += step[:, j]
        if not moving.any():
            break
    weights[0, (ones > 0) & (ones == count)] = np.inf  # all ones: always 1; all zeros: never

    def hits(pdf) -> np.ndarray:
        x, y, out = matrices(pdf)
        margin = np.where(np.isinf(weights[0]), np.inf, x @ np.where(np.isinf(weights), 0.0, weights))
        right = (margin > 0) == (y[:, None] > 0)
        return np.concatenate([(right & out).sum(0), out.sum(0)]).astype(float)

    flat = summed(rows, hits, 2 * n)
    return {s: float(r / m) if m else 0.0 for s, r, m in zip(seeds, flat[:n], flat[n:])}


def pooled_classes(df: DataFrame, label: str, least: int, other: float = -1.0) -> DataFrame:
    """``df`` with ``label`` pooled: classes of fewer than ``least`` rows become ``other``.

    The classes are counted in one aggregate and joined back; nulls stay null."""
    counts = df.groupBy(F.col(label).alias("_pooled")).agg(F.count(F.lit(1)).alias("_rows"))
    out = df.join(counts, F.col(label).eqNullSafe(F.col("_pooled")), "left")
    kept = F.when(F.col(label).isNull() | (F.col("_rows") >= least), F.col(label).cast("double")).otherwise(F.lit(other))
    return out.withColumn(label, kept).drop("_pooled", "_rows")


class Multinomial:
    """A softmax model over numeric columns: probabilities per class.

    Labels may be any numbers; they are numbered in ascending order for the fit and
    given back under their own value.
    """

    def __init__(self, pipeline: PipelineModel, classes: list[float]):
        self.pipeline, self.classes = pipeline, classes

    def probabilities(self, df: DataFrame, keys: Sequence[str], name: str = "class") -> DataFrame:
        """One row per key and class: keys, ``name``, probability."""
        out = self.pipeline.transform(df).select(*keys, vector_to_array("probability").alias("_p"))
        pairs = F.arrays_zip(F.array(*[F.lit(c) for c in self.classes]).alias("c"), F.col("_p").alias("p"))
        return out.select(*keys, F.inline(pairs)).toDF(*keys, name, "probability")

    def predictions(self, df: DataFrame, keys: Sequence[str], name: str = "prediction") -> DataFrame:
        """Keys with the likeliest class (the smallest of equals) and its probability."""
        p = vector_to_array("probability")
        best = F.array_max(p)
        value = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.array_position(p, best).cast("int"))
        return self.pipeline.transform(df).select(*keys, value.alias(name), best.alias(f"{name}_probability"))

    def save(self, path: str) -> None:
        self.pipeline.save(f"{path}/pipeline")
        spark = SparkSession.active()
        spark.createDataFrame([(self.classes,)], "classes array<double>").coalesce(1).write.parquet(f"{path}/classes")

    @classmethod
    def load(cls, path: str) -> Multinomial:
        classes = SparkSession.active().read.parquet(f"{path}/classes").first()["classes"]
        return cls(PipelineModel.load(f"{path}/pipeline"), list(classes))


def fit_multinomial(df: DataFrame, cols: Sequence[str], label: str, iterations: int = 200, reg: float = 0.0, tol: float = 1e-9) -> Multinomial:
    """Softmax model of ``label`` over ``cols``, one coefficient row per class.

    Rows with a null in a used column are left out.  The classes are the distinct
    labels (pool rare ones first, :func:`pooled_classes`): one short row each comes
    to the driver, and the model holds one coefficient per class and column.  With a
    single class its probability is 1.
    """
    data = df.select(*cols, F.col(label).cast("double").alias("_label")).dropna()
    classes = [r[0] for r in data.select("_label").distinct().orderBy("_label").collect()]
    numbers = F.array(*[F.lit(c) for c in classes])
    model = LogisticRegression(
        featuresCol="scaled", labelCol="label", family="multinomial", maxIter=iterations, regParam=reg, tol=tol, standardization=False
    )
    numbered = data.withColumn("_label", (F.array_position(numbers, F.col("_label")) - 1).cast("double"))
    return Multinomial(fit(numbered, cols, "_label", model), classes)


def class_accuracy(predicted: DataFrame, label: str, name: str = "prediction") -> float:
    """Share of rows whose prediction is their label."""
    return predicted.agg(F.avg((F.col(name) == F.col(label)).cast("double"))).first()[0]


# --- least squares from folded products ------------------------------------


class Products:
    """Sums of products of columns and a target per group: (1, x.., y) times itself.

    One aggregate over the rows gives a small matrix per group; sums of groups are
    sums of matrices, so any union of groups (all seasons from a year on, all folds
    but one) is solved without reading the rows again.  The columns are shifted by
    their overall means first, which keeps the products well scaled.
    """

    def __init__(self, df: DataFrame, group: Column, cols: Sequence[str], y: str):
        self.cols, k = list(cols), len(cols) + 1
        data = df.select(group.alias("_g"), *[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("_y")).dropna()
        means = data.agg(*[F.avg(c).alias(c) for c in [*cols, "_y"]]).first()
        self.shift = np.array([means[c] or 0.0 for c in [*cols, "_y"]])
        moved = data.select("_g", *[(F.col(c) - float(m)).alias(c) for c, m in zip([*cols, "_y"], self.shift)])
        names = [F.lit(1.0), *[F.col(c) for c in cols], F.col("_y")]
        sums = [F.sum(names[i] * names[j]) for i in range(k + 1) for j in range(i, k + 1)]
        self.groups: dict = {}
        for row in moved.groupBy("_g").agg(F.array(*sums).alias("s")).collect():  # a small matrix per group
            m, values = np.zeros((k + 1, k + 1)), iter(row["s"])
            for i in range(k + 1):
                for j in range(i, k + 1):
                    m[i, j] = m[j, i] = next(values)
            self.groups[row["_g"]] = m

    def total(self, groups) -> np.ndarray:
        k = len(self.cols) + 2
        return sum((self.groups[g] for g in groups), np.zeros((k, k)))

    def solve(self, products: np.ndarray, ridge: float = 0.0) -> tuple[float, np.ndarray]:
        """Intercept and coefficients; ``ridge`` weighs the squared coefficients of
        columns scaled to deviation 1, times the number of rows."""
        n = products[0, 0]
        if not n:
            return 0.0, np.zeros(len(self.cols))
        mean = products[0, 1:] / n
        cov = products[1:, 1:] / n - np.outer(mean, mean)
        scale = np.sqrt(np.where(np.diag(cov)[:-1] > 1e-12, np.diag(cov)[:-1], 1.0))
        x, xy = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale
        beta = np.linalg.pinv(x + ridge * np.eye(len(x)), rcond=1e-10, hermitian=True) @ xy / scale
        mean = mean + self.shift
        return float(mean[-1] - beta @ mean[:-1]), beta

    def squared_error(self, products: np.ndarray, intercept: float, beta: np.ndarray) -> float:
        """Mean squared error of a model over the rows behind ``products``."""
        v = np.concatenate([[-(intercept + beta @ self.shift[:-1] - self.shift[-1])], -beta, [1.0]])
        return float(v @ products @ v / products[0, 0]) if products[0, 0] else float("nan")


def r2(products: np.ndarray, error: float) -> float:
    n = products[0, 0]
    spread = products[-1, -1] / n - (products[0, -1] / n) ** 2 if n else 0.0
    return float(1 - error / spread) if spread > 0 else float("nan")


def bucket(keys: Sequence[str], buckets: int, salt: str = "") -> Column:
    """Part of a row by the md5 of its keys, which any engine repeats: 0 to buckets - 1."""
    text = F.concat_ws(":", F.lit(salt), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def start_sweep(df: DataFrame, keys: Sequence[str], cols: Sequence[str], y: str, starts: Sequence[int], season: str = "season", test_percent: int = 20) -> list[tuple]:
    """(start, train rows, test rows, R2, accuracy of y >= 0.5) of a least-squares
    model per start season.

    The products are folded per season and part once; seasons from a start on are a
    running sum from the end, so all starts are solved from one pass.  The accuracy
    takes one more pass that scores every start at once.
    """
    test = bucket(keys, 100) < test_percent
    group = F.struct(F.col(season).cast("bigint").alias("season"), test.alias("test"))
    p = Products(df, group, cols, y)
    models = {}
    for start in starts:
        later = [(g, g["test"]) for g in p.groups if g["season"] is not None and g["season"] >= start]
        train, held = p.total([g for g, t in later if not t]), p.total([g for g, t in later if t])
        models[start] = (*p.solve(train), train, held)
    used = df.filter(test).dropna(subset=[*cols, y])
    right = []
    for start, (b, w, _, _) in models.items():
        value = sum((F.col(c) * float(x) for c, x in zip(cols, w)), F.lit(float(b)))
        hit = ((value >= 0.5) == (F.col(y) >= 0.5)).cast("double")
        right.append(F.avg(F.when(F.col(season) >= start, hit)).alias(f"a{start}"))
    accuracy = used.agg(*right).first()
    return [
        (s, int(train[0, 0]), int(held[0, 0]), r2(held, p.squared_error(held, b, w)), accuracy[f"a{s}"]) for s, (b, w, train, held) in models.items()
    ]


def ridge_path(df: DataFrame, keys: Sequence[str], cols: Sequence[str], y: str, strengths: Sequence[float], folds: int = 5, test_percent: int = 20) -> list[tuple]:
    """(strength, mean R2 over the folds, R2 of the held-out part), each strength
    fitted on all folds but one, then on the whole training part.

    Products per fold are folded once; leaving a fold out is a difference of
    matrices, so the grid may have any size.
    """
    part = F.when(bucket(keys, 100) < test_percent, F.lit(-1)).otherwise(bucket(keys, folds, "fold"))
    p = Products(df, part, cols, y)
    inner = [g for g in p.groups if g != -1]
    train, held = p.total(inner), p.total([g for g in p.groups if g == -1])
    out = []
    for strength in strengths:
        scores = []
        for g in inner:
            b, w = p.solve(train - p.groups[g], strength)
            scores.append(r2(p.groups[g], p.squared_error(p.groups[g], b, w)))
        b, w = p.solve(train, strength)
        out.append((float(strength), float(np.mean(scores)) if scores else float("nan"), r2(held, p.squared_error(held, b, w))))
    return out


def forest_grid(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str, grid: Sequence[Mapping[str, object]], folds: int = 5, test_percent: int = 20, kind: str = "classifier") -> list[tuple]:
    """(number in the grid, mean accuracy over the folds, accuracy on the held-out
    part) of a forest per candidate; all candidates share folds and split by key.

    Folds are dealt once and kept; the rows that leave one fold out are assembled and
    scaled once for all candidates, and one pass scores a fold by all of them."""
    make = classifier if kind == "classifier" else regressor
    held = F.when(bucket(keys, 100) < test_percent, F.lit(-1)).otherwise(bucket(keys, folds, "fold"))
    rows = df.select(*cols, F.col(label).alias("_label"), held.alias("_fold")).persist()

    def accuracies(train: DataFrame, test: DataFrame) -> list[float | None]:
        data = train.select(*cols, F.col("_label").cast("double").alias("label")).dropna()
        prepared = Pipeline(stages=scaling(cols)).fit(data)
        scaled = prepared.transform(data).select("scaled", "label").persist()
        forests = [make("forest", **params).setPredictionCol(f"_p{i}").fit(scaled) for i, params in enumerate(grid)]
        out = prepared.transform(test)
        for i, forest in enumerate(forests):
            out = forest.transform(out).select("scaled", "_label", *[f"_p{j}" for j in range(i + 1)])
        found = out.agg(*[F.avg((F.round(f"_p{i}") == F.col("_label")).cast("double")) for i in range(len(grid))]).first()
        scaled.unpersist()
        return list(found)

    inner, out = rows.filter(F.col("_fold") >= 0), []
    by_fold = [accuracies(inner.filter(F.col("_fold") != f), inner.filter(F.col("_fold") == f)) for f in range(folds)]
    on_test = accuracies(inner, rows.filter(F.col("_fold") < 0))
    rows.unpersist()
    for i in range(len(grid)):
        known = [a[i] for a in by_fold if a[i] is not None]
        out.append((i, float(np.mean(known)), on_test[i]))
    return out


def threshold_sweep(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str, thresholds: Sequence[float]) -> list[tuple[float, int, float]]:
    """Hold-out accuracy per p-value threshold: of a logistic model for a 0/1 target,
    of a forest classifier over exact values for others.  A forest takes some hundred
    classes, so values of fewer than a ninetieth of all rows are pooled there."""
    span = df.agg(F.min(label), F.max(label), F.count(label)).first()
    kind, classed = "logistic", df.withColumn("_class", F.col(label).cast("double"))
    if (span[0], span[1]) != (0, 1):
        kind, classed = "forest", pooled_classes(classed, "_class", span[2] // 90 + 1)
        numbers = F.array(*[F.lit(r[0]) for r in classed.select("_class").dropna().distinct().orderBy("_class").collect()])
        classed = stored(classed.withColumn("_class", (F.array_position(numbers, F.col("_class")) - 1).cast("double")))
    train, test = split(classed, keys)
    values = p_values(train, cols, label)
    out, known = [], {}
    for th in thresholds:
        kept = tuple(c for c, p in values.items() if p <= th) or tuple(cols)
        if kept not in known:  # thresholds that keep the same columns share their fit
            known[kept] = class_accuracy(fit(train, kept, "_class", classifier(kind)).transform(test), "_class")
        out.append((th, len(kept), known[kept]))
    return out


def encode(df: DataFrame, col: str, one_hot: bool = True) -> DataFrame:
    """Alphabetical label index, and one 0/1 column per label."""
    index = StringIndexer(inputCol=col, outputCol=f"{col}_index", stringOrderType="alphabetAsc").fit(df)
    out = index.transform(df)
    if not one_hot:
        return out
    enc = OneHotEncoder(inputCols=[f"{col}_index"], outputCols=[f"{col}_hot"], dropLast=False).fit(out)
    hot = vector_to_array(f"{col}_hot")
    out = enc.transform(out)
    return out.select(
        *[c for c in out.columns if c != f"{col}_hot"], *[hot[i].cast("int").alias(f"is_{v.lower()}") for i, v in enumerate(index.labels)]
    )


def grouped_line(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """One least-squares line per group, as an aggregate: any number of groups, no loop."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def impute_with_line(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Missing ``y`` from the group's line over the rows that have it."""
    lines = grouped_line(df.filter(F.col(y).isNotNull()), by, x, y)
    out = df.join(lines, list(by), "left")
    guess: Column = F.col("intercept") + F.col("slope") * F.col(x)
    return out.withColumn(y, F.coalesce(F.col(y).cast("double"), guess)).drop("slope", "intercept", "r2")


def grouped_planes(df: DataFrame, by: Sequence[str], cols: Sequence[str], y: str) -> DataFrame:
    """One least-squares model on several columns per group: by, intercept, coefficients.

    The group's means and covariances are one aggregate, so any number of rows
    folds to one row per group; these rows are solved by the pseudo-inverse in
    Arrow batches.  Rows with a null in any column are left out, as is a null y;
    dependent columns share their weight.
    """
    known = df.select(*by, *[F.col(c).cast("double").alias(c) for c in [*cols, y]]).dropna(subset=[*cols, y])
    pairs = [(a, b) for i, a in enumerate(cols) for b in [*cols[i:], y]]
    folded = known.groupBy(*by).agg(
        F.array(*[F.avg(c) for c in [*cols, y]]).alias("_means"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("_cov")
    )
    k = len(cols)

    def solve(batches):
        for pdf in batches:
            found = []
            for means, flat in zip(pdf["_means"], pdf["_cov"]):
                gram, right, values = np.zeros((k, k)), np.zeros(k), iter(flat)
                for i in range(k):
                    for j in range(i, k):
                        gram[i, j] = gram[j, i] = next(values)
                    right[i] = next(values)
                beta = np.linalg.pinv(gram, hermitian=True) @ right
                found.append((float(means[k] - beta @ means[:k]), beta.tolist()))
            out = pdf[list(by)].copy()
            out["intercept"], out["coefficients"] = [f[0] for f in found], [f[1] for f in found]
            yield out

    fields = [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
    return folded.mapInPandas(solve, ", ".join([*fields, "intercept double", "coefficients array<double>"]))


def plane_value(cols: Sequence[str]) -> Column:
    """Prediction of a joined :func:`grouped_planes` row."""
    return sum((F.get("coefficients", F.lit(i)) * F.col(c) for i, c in enumerate(cols)), F.col("intercept"))


def impute_with_planes(df: DataFrame, by: Sequence[str], cols: Sequence[str], y: str) -> DataFrame:
    """Missing ``y`` from the group's model on several columns over the rows that have it."""
    models = grouped_planes(df, by, cols, y)
    out = df.join(models, list(by), "left")
    return out.withColumn(y, F.coalesce(F.col(y).cast("double"), plane_value(cols))).drop("intercept", "coefficients")
