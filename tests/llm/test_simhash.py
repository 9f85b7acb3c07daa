import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.common import Scratch
from tidemark.llm.simhash import anchors_of, components, fingerprint, links, near_duplicates


def slow_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", " \n\t ", "one", "Two words", "A b C d E f g", "ÉCOLE École école x y", "a a a a a", None])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_every_pair_within_the_threshold_meets_at_a_home():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        i, anchor, home = anchors_of(np.array([x, y], dtype=np.uint64).view(np.int64))
        assert home.sum() == 2 and len(set(zip(i.tolist(), anchor.tolist()))) == len(i)
        of = {k: set(anchor[i == k].tolist()) for k in (0, 1)}
        for k in (0, 1):
            assert set(anchor[(i == k) & home].tolist()) <= of[1 - k]


@pytest.mark.parametrize("crowded", [0, 4, 64])
def test_components_of_links(spark, monkeypatch, crowded):
    """Few, some or all anchors count as crowded: the components are the same."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(200):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
            x ^= 1 << b
        fps.append(x)
    fps = sorted({0, *fps})
    pairs = [(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    want = union(pairs, [signed(f) for f in fps])
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.label for r in components(links(df, scratch), scratch).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_long_chain(spark):
    scratch = Scratch(spark, "test")
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components(edges, scratch).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(60)]
    for t in texts[:30]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += texts[:5] + ["", None, " ", "x"]
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)] + [(None, texts[0], None), (1000, texts[0], "again")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(out) == len(rows)
    fp = {i: slow_fingerprint(t) for i, t, _ in rows if i is not None}
    ids = sorted(fp)
    want = union([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id is not None} == set(want.items())
    assert [r.component_id for r in out if r.doc_id is None] == [want[1000]]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
