"""The pipeline, stage by stage, against plain versions on whole small tables."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_operators import similar
from test_similar import groups
from tidemark.llm import mixing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, each written as Parquet and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
        assert i == 4 or docs.columns == COLUMNS
    return out


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_quality_keeps_clean_documents(stages):
    kept = {r.doc_id for r in stages[0]}
    labels = {r["doc_id"]: r["quality"] for r in rows("labels")}
    right = [labels[d] == (d in kept) for d in labels]
    assert sum(right) / len(right) > 0.93 and kept <= {r["doc_id"] for r in rows("documents")}


def test_one_document_of_each_group(stages):
    want = groups({r.doc_id: r.text for r in stages[0]})
    assert sorted(r.doc_id for r in stages[1]) == sorted(set(want.values()))


def test_no_benchmark_passage_is_left(stages):
    items = [r["text"] for r in rows("benchmark")]
    dirty = {r.doc_id for r in stages[1] if any(similar(r.text, t) >= 0.8 for t in items)}
    assert dirty and {r.doc_id for r in stages[2]} == {r.doc_id for r in stages[1]} - dirty


def test_mix_and_tokens(stages):
    from tokenizers import Tokenizer

    size = lambda t: len((t or "").encode().split())
    before, after = Counter(), Counter()
    for r in stages[2]:
        before[r.source] += size(r.text)
    for r in stages[3]:
        after[r.source] += size(r.text)
    goal = mixing.targets(dict(before))
    assert all(abs(after[s] - goal[s]) <= 0.5 for s in goal)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[3]:
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 2], dtype="<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[4]) == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in stages[4])
    assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])]


def test_registered(spark, stages):
    assert "pipeline" in entry.queries()
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[4]))
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14))


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, own_id long, own_key int, _own_words string, words int, shard int"


def odd_rows():
    line = "A clear sentence about rivers, towns and their long history stands here. "
    base = [(i, line * (i % 5 + 1) + f"Number {i} closes it.", "en", "a" if i % 3 else None, 1, "s", 7, 8, "w", 9, 3) for i in range(30)]
    more = [(None, line, "en", "b", 1, "s", 7, 8, "w", 9, 3), (50, None, None, None, None, None, None, None, None, None, None)]
    return base + base[:4] + more + more + [(51, "", "en", "b", 0, "s", 7, 8, "w", 9, 3), (52, line * 4000, "en", "b", 1, "s", 7, 8, "w", 9, 3)]


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows_and_clashing_names(spark, k):
    """Null ids and texts, repeated rows, a long text, columns named like helpers."""
    given = odd_rows()
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(given, ODD), SF)
    got = out.collect()
    if k < 4:
        assert out.columns == [f.split()[0] for f in ODD.split(", ")]
        assert all((r.score, r.own_id, r.own_key, r._own_words, r.words, r.shard) in (("s", 7, 8, "w", 9, 3), (None,) * 6) for r in got)
    if k == 1:
        want = groups({r[0]: r[1] for r in given if r[0] is not None})
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in given if r[0] is None or want[r[0]] == r[0])
    if k == 2:
        assert Counter(map(tuple, got)) == Counter(given)
    if k == 3:
        assert None in {r.source for r in got} and not any(r.doc_id in (50, 51) for r in got)
        assert all(r.n_chars == len(r.text) for r in got)
    if k == 4:
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in given)


@pytest.mark.parametrize("k", range(5))
def test_stages_with_an_empty_table(spark, k):
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], ODD), SF).count() == 0
