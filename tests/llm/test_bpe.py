"""Byte-level BPE against the library on whole texts."""

import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def alphabets():
    yield "ab"
    yield "a"
    yield " \n\t"
    yield "ab '"
    yield "strelvmd' "
    yield "!'s."
    yield "0123 "
    yield "é漢🙂 a"
    yield "the in on er re at a b  \n'!1é"
    yield "\x1c\x1d x \xa0"


@pytest.mark.parametrize("leaf", [5, 17, 64])
@pytest.mark.parametrize("letters", list(alphabets()))
def test_trees_equal_the_library(library, letters, leaf):
    coder, rng = bpe.bpe(PATH), random.Random(len(letters) * leaf)
    for n in [1, 2, 3, 7, 20, 60, 200, 700, 1500]:
        for _ in range(4):
            text = "".join(rng.choices(letters, k=n))
            if rng.random() < 0.5:  # long runs of one sign
                text = "".join(c * rng.choice([1, 1, 1, 9, 40]) for c in text)[:n]
            data, nodes, lo = text.encode(), [], 0
            for piece in bpe.halves(text, leaf):
                nodes.append(coder.node(piece.encode(), lo))
                lo = nodes[-1].hi
            node = bpe.concatenate(coder, data, nodes)
            want = library.encode(text, add_special_tokens=False)
            assert node.ids.tolist() == want.ids
            words = want.word_ids
            assert node.starts.tolist() == [k == 0 or words[k] != words[k - 1] for k in range(len(words))]
            assert (node.lo, node.hi, int(node.ends[-1])) == (0, len(data), len(data))


def test_windows_stay_small(library, monkeypatch):
    coder, seen = bpe.bpe(PATH), []
    text = " ".join(r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if r["text"])[:400_000]
    nodes, lo = [], 0
    for piece in bpe.halves(text, 8192):
        nodes.append(coder.node(piece.encode(), lo))
        lo = nodes[-1].hi
    plain = coder.node
    monkeypatch.setattr(coder, "node", lambda data, at: seen.append(len(data)) or plain(data, at))
    assert bpe.concatenate(coder, text.encode(), nodes).ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(seen) <= 8 * bpe.WINDOW and len(seen) < 2 * len(nodes)


def odd_rows():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab c'sé\n<|endoftext|>", k=rng.randint(0, 300))) for _ in range(40)]
    texts += ["x<|endoftext|>y", "<|endoftext|>" * 40, ("a" * 700 + "<|endoftext|>") * 3, "a" * 5000, " " * 3000 + "x", "漢" * 900, "'ll" * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, "a" * 400), (None, None)]
    return rows + [(7, "b" * 999)] * 3 + [(8, "b" * 999)] + [(7, "short")] * 2


def test_frames_equal_the_library(spark, library):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, tree string")
    out = bpe.decode(bpe.encode(df, PATH, leaf=50), PATH).collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    want = [(i, ids(t), library.decode(ids(t), skip_special_tokens=False)) for i, t in rows]
    assert sorted(((r.doc_id, r.ids, r.text) for r in out), key=str) == sorted(want, key=str)
    assert [t for _, _, t in want] == [t or "" for _, t in rows]
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH), PATH).count() == 0


def test_decode_of_any_ids(spark, library):
    rng = random.Random(6)
    lists = [[rng.randrange(50_257) for _ in range(rng.randint(0, 30))] for _ in range(200)] + [[255, 160, 50_256, 50_300]]
    out = bpe.decode(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>"), PATH).collect()
    assert {r.doc_id: r.text for r in out} == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}
    odd = spark.createDataFrame([(1, None), (2, [None, -5, 90_000, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: "", 2: library.decode([64])}


def test_query(spark, library):
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_bpe_tree"](spark, SF).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        assert got[r["doc_id"]] == (r["doc_id"], len(ids), *sha)
