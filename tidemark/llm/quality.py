"""Document quality by a linear-chain conditional random field over lines.

Every line has a state, bad or good.  A line's own features and those of its
neighbours give its unary score, and a transition score couples neighbouring
states.  Forward-backward gives each line's marginal; the marginals, weighted by
the lines' lengths, are averaged to the document's figure, which a logistic
curve maps to a probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import release
from tidemark.llm.fitting import descend, platt, sample_ids, sigmoid

#: Labelled rows of a fit, and lines that such a row may have, at most.
FIT_ROWS, FIT_LINES = 4_000, 400
SHRINK, STEPS = 1e-3, 150
#: Characters whose lines are described at a time (one document at least).
STEP = 1 << 20

#: Byte classes that are counted in a line.
CLASSES = {
    "upper": lambda c: c.isupper(),
    "lower": lambda c: c.islower(),
    "digit": lambda c: c.isdigit(),
    "space": lambda c: c in " \t\r\f\v",
    "pause": lambda c: c in ".,",
    "bar": lambda c: c == "|",
    "shout": lambda c: c == "!",
    "sign": lambda c: c in "#$%&*+<=>@\\^_`{}~[]",
}
_TABLES = {k: np.array([b < 128 and f(chr(b)) for b in range(256)]) for k, f in CLASSES.items()}
OWN, NEAR = 14, 7
#: Features of a line: its own, its neighbours', two edges, and a constant.
WIDTH = OWN + 2 * NEAR + 3


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and where each text's lines begin.

    An empty text is one empty line."""
    data = [t.encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    first = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))
    count = {k: np.add.reduceat(t[buf].astype(np.int32), starts) for k, t in _TABLES.items()}
    n, letters, words = np.maximum(size, 1), np.maximum(count["upper"] + count["lower"], 1), count["space"] + 1
    lines = b"\n".join(data).split(b"\n")
    seen: set[bytes] = set()
    again, echo, variety = np.zeros(len(lines)), np.zeros(len(lines)), np.ones(len(lines))
    for i, line in enumerate(lines):
        w = line.split()
        if len(w) > 1:
            echo[i] = sum(map(eq, w, w[1:])) / (len(w) - 1)
            variety[i] = len(set(w)) / len(w)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        seen.clear()
        for i in range(a, b):
            if lines[i] in seen:
                again[i] = 1
            seen.add(lines[i])
    own = np.stack(
        [
            count["upper"] / letters,
            count["sign"] / n * 4,
            count["bar"] / n * 8,
            count["shout"] / n * 8,
            count["digit"] / n * 4,
            count["pause"] / words,
            size / words / 10,
            np.log1p(size) / 5,
            (size < 20) * 1.0,
            (count["pause"] == 0) * 1.0,
            again,
            (count["upper"] > 1 + words / 2) * 1.0,
            echo * 3,
            variety,
        ],
        axis=1,
    )
    own = np.minimum(own, 4)
    near = own[:, [0, 1, 2, 3, 9, 10, 12]]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    at_start, at_end = np.zeros((len(own), 1)), np.zeros((len(own), 1))
    at_start[first[:-1]] = 1
    at_end[first[1:] - 1] = 1
    x = np.hstack([own, before * (1 - at_start), after * (1 - at_end), at_start, at_end, np.ones((len(own), 1))])
    return x, size.astype(float), first


@dataclass
class Model:
    weights: np.ndarray
    stay: tuple[float, float]
    slope: float
    offset: float

    def scores(self, texts: list[str]) -> list[float]:
        x, size, first = describe(texts)
        u = (x @ self.weights).tolist()
        f = first.tolist()
        size = size + 1
        out = []
        for a, b in zip(f, f[1:]):
            p = marginals(u[a:b], self.stay)
            w = size[a:b]
            out.append(float(sigmoid(self.slope * float(np.dot(w, p) / w.sum()) + self.offset)))
        return out


def marginals(u: list[float], stay: tuple[float, float]) -> list[float]:
    """P(good) of each line: forward-backward with normalised messages.

    ``u``: score of good against bad; ``stay``: score of staying bad, good."""
    t0, t1 = exp(stay[0]), exp(stay[1])
    n = len(u)
    forward = [0.0] * n
    e = [exp(min(max(v, -30.0), 30.0)) for v in u]
    p = 0.0
    for i in range(n):
        if i:
            good, bad = e[i] * (p * t1 + (1 - p)), p + (1 - p) * t0
        else:
            good, bad = e[0], 1.0
        p = good / (good + bad)
        forward[i] = p
    out = [0.0] * n
    g = b = 0.5
    for i in range(n - 1, -1, -1):
        good, bad = forward[i] * g, (1 - forward[i]) * b
        out[i] = good / (good + bad)
        ge = e[i] * g
        g, b = t1 * ge + b, ge + t0 * b
        s = g + b
        g, b = g / s, b / s
    return out


def chain_gradient(x: np.ndarray, first: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the mean negative log-likelihood of documents whose lines all
    have the document's label; all documents step through their lines together."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length, label = first[:-1][order], length[order], y[order]
    u = x @ w[:-2]
    stay = w[-2:]
    steps, n = int(length.max()), len(length)
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
    alpha = []
    for t in range(steps):
        k = live[t]
        v = u[start[:k] + t]
        if t:
            a0, a1 = alpha[-1][0][:k], alpha[-1][1][:k]
            alpha.append((np.logaddexp(a0 + stay[0], a1), np.logaddexp(a0, a1 + stay[1]) + v))
        else:
            alpha.append((np.zeros(k), v))
    b0, b1 = np.zeros(n), np.zeros(n)
    expected, pairs = np.zeros(len(u)), np.zeros(2)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        a0, a1 = alpha[t]
        z = np.logaddexp(a0 + b0[:k], a1 + b1[:k])
        expected[start[:k] + t] = np.exp(a1 + b1[:k] - z)
        if t:
            p0, p1 = alpha[t - 1][0][:k], alpha[t - 1][1][:k]
            v = u[start[:k] + t]
            pairs += np.exp(p0 + stay[0] + b0[:k] - z).sum(), np.exp(p1 + stay[1] + v + b1[:k] - z).sum()
            n0, n1 = np.logaddexp(stay[0] + b0[:k], v + b1[:k]), np.logaddexp(b0[:k], stay[1] + v + b1[:k])
            b0[:k], b1[:k] = n0, n1
    truth = np.repeat(y, np.diff(first))
    same = np.array([((length - 1) * (label == c)).sum() for c in (0, 1)])
    total = len(u)
    return np.append(x.T @ (expected - truth), pairs - same) / total


def fit_texts(texts: list[str], labels: list[int]) -> Model:
    """Fit on whole texts with a label each."""
    y = np.array(labels, dtype=float)
    x, size, first = describe(texts)

    def gradient(w):
        g = chain_gradient(x, first, y, w)
        keep = np.append(np.full(WIDTH - 1, SHRINK), [0.0, 0.05, 0.05])
        return g + keep * w

    w = descend(gradient, np.zeros(WIDTH + 2), STEPS, 0.1)
    model = Model(w[:-2], (float(w[-2]), float(w[-1])), 1.0, 0.0)
    u = (x @ model.weights).tolist()
    mean = np.array(
        [np.dot(size[a:b] + 1, marginals(u[a:b], model.stay)) / (size[a:b] + 1).sum() for a, b in zip(first.tolist(), first[1:].tolist())]
    )
    model.slope, model.offset = platt(mean, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, fit_fold, label: str = "quality") -> Model:
    """Fit on at most FIT_ROWS labelled documents of at most FIT_LINES lines and
    FIT_LINES * 200 characters, whole texts.

    One task fits the model on this bounded sample; only its weights come to the
    driver.  Without labelled rows every score is 0.5.
    """
    ids = sample_ids(labels, label, fit_fold, FIT_ROWS)
    text = F.coalesce("text", F.lit(""))
    rows = (
        docs.select("doc_id", text.alias("text"))
        .join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
        .filter((F.char_length("text") <= FIT_LINES * 200) & (F.regexp_count("text", F.lit("\n")) < FIT_LINES))
        .select("_id", "label", "text")
    )

    def learn(batches):
        got = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_id", "label", "text"))))
        if got:
            m = fit_texts([t for _, _, t in got], [y for _, y, _ in got])
            yield pa.RecordBatch.from_pydict({"figures": [[*m.weights.tolist(), *m.stay, m.slope, m.offset]]})

    rows = rows.repartition(1).mapInArrow(learn, "figures array<double>").collect()
    if not rows:
        return Model(np.zeros(WIDTH), (0.0, 0.0), 0.0, 0.0)
    *w, a, b, slope, offset = rows[0]["figures"]
    return Model(np.array(w), (a, b), slope, offset)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, ...) with a column ``name``, whole texts.

    A null text is empty, one empty line.  The score depends on the text alone;
    all columns of ``docs`` are passed on, but one of that name is replaced."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        release()
        for b in batches:
            texts, out, part, size = b.column("text").to_pylist(), [], [], 0
            for t in texts:
                part.append(t or "")
                size += len(part[-1])
                if size >= STEP:
                    out += model.scores(part)
                    part, size = [], 0
            if part:
                out += model.scores(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
