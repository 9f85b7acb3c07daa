import random

import numpy as np
import pytest

from tidemark.llm import suffix
from tidemark.llm.suffix import Trie, deep_shallow, remove_repeats


def brute(rows, length):
    """First place of every string of ``length`` bytes, in document order."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edges = np.diff(np.r_[0, gone.view(np.int8), 0])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if data else b""
        out[doc_id] = (len(data), int(gone.sum()), int((edges == 1).sum()), kept)
    return out


def got(spark, rows, length=100):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length).collect()}


def sample_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéüß") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(4)]
    rows = []
    for i in range(160):
        t = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t += " " + p[a:] + text(rng.randint(0, 6))
        if i % 5 == 4:
            t = rows[rng.randrange(len(rows))][1] or ""
        if i % 7 == 6 and t:
            k = rng.randrange(len(t))
            t = t[:k] + "X" + t[k + 1 :]
        rows.append((rng.randrange(10**6) * 200 + i, t))
    return rows + [(3, None), (5, ""), (7, "ab" * 400), (9, "ab" * 300), (11, "x" * 99), (13, "x" * 99), (15, "x" * 100), (17, "x" * 101)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = sample_rows(seed)
    assert got(spark, rows) == brute(rows, 100)


def test_hot_anchor_and_small_sorts(spark, monkeypatch):
    rows = sample_rows(3)
    common = rows[0][1] + " " + "shared passage of many words " * 4
    rows = [(i, f"{t} {common} {i}") if i % 2 else (i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(suffix, "SAMPLE", 1)
    monkeypatch.setattr(suffix, "hot_anchors", lambda d, length, n: [r.khash for r in suffix.find_blocks(d, length).groupBy("khash").count().filter("count > 8").collect()])
    assert got(spark, rows) == brute(rows, 100)


def test_long_text_in_segments(monkeypatch):
    data = random.Random(4).randbytes(5000) * 2
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    windows = []
    for at, piece in suffix.parts(data):
        _, start, packed, _, _ = suffix.blocks_of([piece])
        for s, p in zip((start + at).tolist(), packed.tolist()):
            windows += range(s, s + p % suffix.BYTE)
    assert windows == list(range(len(data) - 99))


def test_sorter_orders_like_sorted():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(48)) for _ in range(300)]
    texts += [b"a" * 40 + bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(200)] + texts[:50]
    group = np.array([i % 3 for i in range(len(texts))])
    strings = np.array([list(t) for t in texts], dtype=np.uint8)
    rows = list(deep_shallow(strings, group))
    want = sorted({(g, t) for g, t in zip(group.tolist(), texts)})
    assert [(int(group[r[0]]), texts[r[0]]) for r in rows] == want
    assert sorted(i for r in rows for i in r) == list(range(len(texts)))


def test_trie_keeps_equal_strings_together():
    t = Trie(b"abc", 0)
    for i, s in enumerate([b"abd", b"abc", b"xbc", b"abd"], 1):
        t.add(s, i)
    assert list(t.leaves()) == [[0, 2], [1, 4], [3]]


def test_edges(spark):
    assert got(spark, []) == {}
    text = "z" * 50 + "".join(chr(97 + i % 26) for i in range(77)) + "é" * 40
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (1, text + "!", "c"), (None, text, "d")], "doc_id long, text string, kept string")
    out = remove_repeats(df).orderBy("doc_id", "n_bytes").collect()
    n = len(text.encode())
    assert [(r.doc_id, r.n_bytes, r.n_removed) for r in out][0] == (None, n, 0)
    assert [(r.doc_id, r.n_bytes) for r in out][1:] == [(1, n), (1, n + 1)]
    assert sum(r.n_removed for r in out) in (2 * n, 2 * n + 1)
    with pytest.raises(ValueError):
        remove_repeats(df, 20)
