"""Runs of words against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic
from tidemark.llm.queries import QUERIES


def slow_runs(w):
    """Every maximal stretch of each period, kept with its smallest period."""
    best = {}
    for q in range(1, len(w) // periodic.LEAST + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(periodic.SHORTEST, periodic.LEAST * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def slow_digest(doc_id, text):
    words = text.encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    table = "".join("%d,%d,%d\n" % r for r in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    more = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return doc_id, len(runs), *more, hashlib.sha256(table.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def sample(seed, n=120):
    rng, out = random.Random(seed), []
    for _ in range(n):
        t = []
        while rng.random() < 0.8:
            unit = rng.choices(range(rng.choice([1, 2, 4, 40])), k=rng.randint(1, 9))
            t += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_the_definition(seed):
    texts = sample(seed)
    texts += texts[:10] + [[], [5], [0] * 5, [0] * 6, [0, 1] * 200, [0] * 700, list(range(300)) * 4 + [7]]
    assert periodic.runs_of(texts) == [slow_runs(t) for t in texts]


def test_extensions():
    rng = random.Random(9)
    texts = [[rng.randint(0, 1) for _ in range(rng.randint(1, 50))] * rng.randint(1, 6) for _ in range(20)]
    words = np.concatenate([np.array([*t, 2 + k]) for k, t in enumerate(texts)])
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    lce = periodic.Extensions(words, text_of)
    pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if text_of[i] == text_of[j]]

    def slow(i, j):
        k = 0
        while j + k < len(words) and words[i + k] == words[j + k]:
            k += 1
        return k

    i, j = np.array(pairs).T
    assert lce(i, j).tolist() == [slow(*p) for p in pairs]
    assert lce(j, i).tolist() == [slow(*p) for p in pairs]


def test_the_cover_meets_every_difference():
    d = periodic.MODULUS
    assert {(a - b) % d for a in periodic.COVER for b in periodic.COVER} == set(range(d))


def test_query_on_a_fixture(spark, tmp_path):
    names = "alpha beta gamma delta".split()
    texts = [" ".join(names[x % 4] for x in t) for t in sample(3, 200)]
    rows = [(i, t, "n_runs", 1) for i, t in enumerate(texts)]
    rows += [(400, None, "x", 2), (401, "", "x", 2), (402, " \n\t ", "x", 2), (403, "\x0ba b\r\na  b a b a\x0cb a b\n", None, 2), (3, texts[3], "x", 3)]
    rows += [(404, "long words " * 30_000, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string, h int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want = [slow_digest(i, t or "") for i, t, _, _ in rows if i != 404]
    assert sorted(map(tuple, (r for r in got if r.doc_id != 404))) == sorted(want)
    long = next(r for r in got if r.doc_id == 404)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 60_000, 2, 30_000_000)
    assert sum(r.exponent_milli is not None for r in got) > 30


def test_null_ids_empty_tables_and_small_blocks(spark, monkeypatch):
    schema = "doc_id long, text string, collapsed string"
    assert periodic.word_runs(spark.createDataFrame([], schema)).count() == 0
    assert periodic.with_planted_runs(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "x x x x x x x y", "a"), (None, None, "b"), (1, "é " * 9, "c"), (1, "é " * 9, "c")]
    df = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(periodic, "BLOCK", 3)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.word_runs(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, 8, [(0, 7, 1)], "x y"), (None, 0, [], ""), (1, 9, [(0, 9, 1)], "é"), (1, 9, [(0, 9, 1)], "é")], key=str
    )
    assert sorted((r.doc_id is None, r.text) for r in periodic.with_planted_runs(df).collect()) == sorted((i is None, t or "") for i, t, _ in rows)
