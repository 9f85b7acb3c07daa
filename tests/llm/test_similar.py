"""Groups by exact shingle similarity, against brute force over all pairs."""

import random

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from test_simhash import union
from tidemark.llm import simhash, similar

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {b" ".join(w)}


def groups(texts):
    s, ids = {i: shingles(t) for i, t in texts.items()}, sorted(texts)
    near = lambda a, b: 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])
    return union([(a, b) for a in ids for b in ids if a < b and near(a, b)], ids)


def test_stage_keeps_one_of_each_group(spark):
    """Near copies of 0.8, not only those whose fingerprints differ in two bits."""
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = corpus_pipeline.simhash_near_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(groups(docs).values()))


@pytest.mark.parametrize("crowded", [1, 8, 64])
def test_groups(spark, monkeypatch, crowded):
    """Few, some or all shingles count as crowded: the groups are the same."""
    monkeypatch.setattr(similar, "CROWDED", crowded)
    rng = random.Random(5)
    words, line = [f"w{i}" for i in range(300)], "one line that many of the texts have in common"
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(40)]
    for _ in range(120):
        w = rng.choice(texts[:25]).split()
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w) if rng.random() < 0.7 else f"{line} {' '.join(w)}")
    texts += ["", " \n", "Two words", "two WORDS", "É a", "é a"]
    docs = dict(enumerate(texts))
    rows = [*docs.items(), (None, texts[30]), (200, None)]
    out = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = groups(docs | {200: None})
    assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out if r.doc_id is not None} == set(want.items())
    assert [r.component_id for r in out if r.doc_id is None] == [want[30]]


def test_a_common_line_makes_no_pairs(spark, monkeypatch):
    """Texts that share a line and no more reach nothing, however many they are; a
    large group of near copies costs links, not pairs."""
    seen = []
    plain = similar.verified

    def counted(pairs, *more):
        seen.append(pairs.distinct().count())
        return plain(pairs, *more)

    monkeypatch.setattr(similar, "verified", counted)
    rng = random.Random(7)
    line = "this line of boilerplate stands in every one of the texts that follow it here"
    texts = [f"{line} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(rng.randint(4, 9)))}" for _ in range(400)]
    base = [f"b{i}" for i in range(120)]
    for _ in range(300):
        w = base[:]
        w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = dict(enumerate(texts))
    out = similar.similar_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == groups(docs)
    assert sum(seen) < 4 * len(texts)


def test_simhash_proposes_groups(spark, monkeypatch):
    """The stage's SimHash search finds near copies by itself; what it proposes is
    verified by the shingles."""
    plain = similar.postings
    monkeypatch.setattr(similar, "postings", lambda nodes, at_least: plain(nodes, at_least).limit(0))
    base = [f"b{i}" for i in range(3000)]
    copies = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in (700, 1600)]
    line = "A clear sentence about rivers, towns and their long history stands here. "
    # Fingerprints within two bits, shingles far apart.
    apart = [line * 5 + f"Number {i} closes it." for i in (4, 28)]
    docs = dict(enumerate([" ".join(base), *copies, *apart, "nothing like the others at all in here"], 1))
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    fp = [simhash.fingerprint(t) for t in docs.values()]
    assert all((fp[a] ^ fp[b]).bit_count() <= 2 for a, b in ((0, 1), (0, 2), (3, 4)))
    got = corpus_pipeline.simhash_near_dedup(spark, rows, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(groups(docs).values())) == [1, 4, 5, 6]
