"""Fill-in-the-middle: rotations, forms by plain slicing, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(doc_id, text):
    """The form of one document by plain slicing."""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("step", [1, 3, 1 << 16])
def test_rotation(monkeypatch, step):
    monkeypatch.setattr(infill, "SWAP", step)
    rng = random.Random(step)
    for _ in range(200):
        data = rng.randbytes(rng.randint(0, 60))
        a, cut, b = sorted(rng.choices(range(len(data) + 1), k=3))
        buffer = bytearray(data)
        infill.rotate(buffer, a, cut, b)
        assert bytes(buffer) == data[:a] + data[cut:b] + data[a:cut] + data[b:]
    view = np.arange(9, dtype=np.uint8)
    infill.reverse(view, 2, 7)
    assert view.tolist() == [0, 1, 6, 5, 4, 3, 2, 7, 8]


def rows():
    rng = random.Random(8)
    signs = ["a", "é", "漢🙂", " ", "\n", "\t ", "<", "<P", ">", "P>", "S", "\x1c", "\xa0", "word", "<P>", "\x0b"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(600)]
    out = list(enumerate(texts)) + [(900, None), (901, ""), (902, "   "), (903, "x" * 200_000), (904, "a b " * 50_000), (None, "a b c"), (None, None)]
    return out + out[:20] + [(i, "same text twice") for i in range(950, 990)] * 2


def test_forms_and_restored_texts(spark):
    given = rows()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in given], "doc_id long, text string, output string, n int")
    out = infill.restored(infill.fill_in_middle(df)).collect()
    want = [(*slow(i, t or ""), t or "") for i, t in given]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert infill.restored(infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_marks_at_the_seams():
    for text in (b"<P", b"<S<S<M", b"S>M>P>", b"<<>>", b"<P<S<M"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for form in ("psm", "spm"):
                    assert infill.restore(infill.transform(text, a, b, form), form) == text
