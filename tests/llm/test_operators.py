"""Brute-force versions, round trips and edge cases of the operators."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, exact, mixing, quality, tokens, toxicity, warc
from tidemark.llm.common import new_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "The", "an", "it's", "don't", "naïve", "Straße", "x1y2", "42", "…", "a,b", "<|im_end|>", "end.", "é", "ok!!", "über-all"]
    return [rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n)]


# --- exact duplicates -------------------------------------------------------


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    rows = [(i, t, "x") for i, t in enumerate(texts(1, 60) * 2)] + [(500 + i, "hot text", "x") for i in range(400)]
    rows += [(900, None, "x"), (901, "", "x"), (None, "hot text", "x"), (None, "alone", "x"), (500, "hot text", "again")]
    out = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string, keep_id string"), keep=keep, partitions=4).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    for r in out:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert not r.kept or r.doc_id == best
    assert Counter(r.text_sha256 for r in out if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert exact.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- chat -------------------------------------------------------------------


def chat_rows():
    rng, rows = random.Random(2), []
    for c in range(30):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool\nx\\n"])
            rows.append((c, t, role, rng.choice(texts(c, 5)) * rng.randint(0, 4)))
    odd = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (70, 0, "assistant", None), (71, None, None, "<\\|a<\\\\|")]
    rows += [(72, 0, "assistant", "tie"), (72, 0, "assistant", "tie"), (None, 0, "user", "n"), (None, 1, "assistant", "long word " * 300)]
    return rows


@pytest.mark.parametrize("budget,block", [(512, 4096), (60, 2)])
def test_chat_round_trip(spark, monkeypatch, budget, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, i string")
    windows = chat.format_windows(df, budget, history=max(8, budget // 8), system=max(20, budget // 4))
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    chars = Counter()
    for w in windows.collect():
        chars[w.conv_id] += len(w.formatted)
        assert w.tokens <= budget or w.over_budget
        assert 0 <= w.n_repeated < w.n_turns
        assert all(w.formatted[s.start + s.length :].startswith("<|im_end|>\n") for s in w.loss)
    assert set(got) == {r[0] for r in rows}
    for c in got:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        ts = sorted((r for r in rows if r[0] == c), key=key)
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in ts)
        loss = "".join(t or "" for _, _, r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == chars[c]


def test_chat_windows_repeat_system_and_history(spark):
    turns = [("system", "s " * 10)] + [("user" if i % 2 else "assistant", f"w{i} " * 20) for i in range(1, 12)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_windows(df, 120, history=30, system=20).orderBy("window").collect()
    assert len(out) > 2
    for w in out[1:]:
        assert w.formatted.startswith("<|im_start|>system\n") and w.n_repeated == 2 and not w.over_budget
    assert chat.format_windows(df.limit(0)).count() == 0


# --- classifiers ------------------------------------------------------------


def test_marginals_against_enumeration():
    rng = random.Random(3)
    for n in (1, 2, 5):
        u, stay = [rng.uniform(-2, 2) for _ in range(n)], (0.4, 0.9)
        total, good = 0.0, [0.0] * n
        for k in range(1 << n):
            s = [k >> i & 1 for i in range(n)]
            z = sum(a for a, b in zip(u, s) if b) + sum(stay[a] for a, b in zip(s, s[1:]) if a == b)
            total += np.exp(z)
            for i in range(n):
                good[i] += np.exp(z) * s[i]
        assert np.allclose(quality.marginals(u, stay), np.array(good) / total)


def test_chain_gradient_against_differences():
    rng = np.random.default_rng(4)
    first, y = np.array([0, 1, 4, 6]), np.array([1.0, 0.0, 1.0])
    x, w = rng.normal(size=(6, 3)), rng.normal(size=5)

    def loss(w):
        out = 0.0
        for a, b, label in zip(first, first[1:], y):
            scores = []
            for k in range(1 << (b - a)):
                s = [k >> i & 1 for i in range(b - a)]
                z = sum(float(x[a + i] @ w[:3]) * v for i, v in enumerate(s)) + sum(w[3 + p] for p, q in zip(s, s[1:]) if p == q)
                scores.append((z, all(v == label for v in s)))
            out += np.log(sum(np.exp(z) for z, _ in scores)) - next(z for z, same in scores if same)
        return out / 6

    step = [(loss(w + 1e-5 * e) - loss(w - 1e-5 * e)) / 2e-5 for e in np.eye(5)]
    assert np.allclose(quality.chain_gradient(x, first, y, w), step, atol=1e-6)


def labelled(spark, n=200):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        bad = i % 4 == 0
        line = lambda: " ".join(rng.choice(["some", "plain", "words", "here"]) for _ in range(9)) + "."
        rows.append((i, "\n".join(line().upper() + "!!!" if bad else line() for _ in range(rng.randint(1, 6))), "c"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(n, "", "c"), (n + 1, None, "c"), (n + 1, None, "c"), (None, "A " * 50_000, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels, F.col("doc_id") % 5 != 0)
    out = quality.score(docs, model).collect()
    assert len(out) == 204 and all(0 <= r.score <= 1 for r in out)
    assert all((r.score >= 0.7) == (r.doc_id % 4 != 0) for r in out if r.doc_id is not None and r.doc_id < 200)
    assert len({r.score for r in out if r.text in ("", None)}) == 1
    flat = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, flat).collect()} == {0.5}


def test_toxicity_scores(spark):
    docs, labels = labelled(spark)
    rows = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" idiot"))).otherwise(F.lower("text")))
    model = toxicity.fit(rows, labels, F.col("doc_id") % 5 != 0)
    out = toxicity.score(rows, model).collect()
    assert len(out) == 204
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out if r.doc_id is not None and r.doc_id < 200)
    assert toxicity.fit(rows, labels.limit(0), F.lit(True)).score("idiot") == 0.5


def test_swapped_terms_lose_their_weight():
    """A group's name that stands in toxic sentences only must not count by itself."""
    rng = random.Random(6)
    data = []
    for i in range(400):
        bad = i % 2
        words = rng.choices(["house", "tree", "walk", "read"], k=4) + (["muslims"] if bad and i % 4 == 1 or i % 40 == 0 else [])
        data.append((" ".join(words + (["idiots"] if bad and i % 8 != 1 else [])), bad))
    rows = [(toxicity.features(toxicity.words_of(t)), y) for t, y in data]
    pairs = [(toxicity.features(a), toxicity.features(b)) for t, _ in data for a, b in toxicity.swaps(t)]
    change = {}
    for fair in (0.0, 10.0):
        m = toxicity.Model(*toxicity.fit_rows(rows, pairs, fair))
        change[fair] = m.score("muslims walk") - m.score("christians walk")
        assert m.score("idiots read") > 0.5
    assert pairs and abs(change[10.0]) < 0.3 * abs(change[0.0])


def test_fit_reads_its_rows_once():
    """Rows may be a generator, so a fit holds numbers and not the words of all rows."""
    data = [({"idiot", f"w{i}"} if i % 2 else {"kind", f"w{i}"}, i % 2) for i in range(200)]
    assert toxicity.fit_rows((r for r in data), []) == toxicity.fit_rows(data, [])
    assert toxicity.fit_rows(iter(data), [])[0]["idiot"] > 0


def test_induced_terms_and_hashed_swaps(spark, monkeypatch):
    """Slot words under both labels are found; late sentences and high ids give swaps."""
    rng, rows = random.Random(3), []
    for i in range(120):
        colour = rng.choice(["red", "blue", "green"])
        bad = i % 2
        rows.append((i, bad, f"I saw the {colour} house. " + ("you are an idiot here. " if bad else "you are so kind here. ") * 3 + f"Then the {colour} boat left"))
    df = spark.createDataFrame(rows, "_id long, label int, text string")
    terms = toxicity.induced_terms(df)
    assert {"red", "blue", "green"} <= set(terms) and not {"idiot", "kind"} & set(terms)
    assert all(set(terms[w]) <= {"red", "blue", "green"} - {w} for w in ("red", "blue", "green"))
    only = {w: terms[w] for w in ("red", "blue", "green")}
    every = toxicity.swapped(df, only).collect()
    assert len(every) == 2 * 120
    some = toxicity.swapped(df.repartition(3), only, most=50).collect()
    assert [tuple(r) for r in some] == sorted(tuple(r) for r in every)[:50]
    assert toxicity.induced_terms(df.limit(0)) == {}
    # One document with more than a hundred terms: none of its sentences is cut off.
    long = spark.createDataFrame([(1, 1, "the red house. " * 300)], "_id long, label int, text string")
    assert toxicity.swapped(long, only).count() == 300


def test_the_penalty_evens_out_slot_words(spark):
    """A colour that stands in toxic texts more often counts less with the penalty."""
    rng, rows, marks = random.Random(4), [], []
    for i in range(400):
        bad = i % 2
        colour = "red" if rng.random() < (0.8 if bad else 0.2) else "blue"
        rows.append((i, f"I saw the {colour} house. " + ("you idiot" if bad and i % 4 == 1 else "you there")))
        marks.append((i, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    gap = {}
    for fair in (0.0, 10.0):
        m = toxicity.fit(docs, labels, F.lit(True), fair=fair)
        gap[fair] = m.score("the red house") - m.score("the blue house")
    assert gap[0.0] > 0.2 and abs(gap[10.0]) < 0.5 * gap[0.0]


@pytest.mark.parametrize("budget,history,system", [(512, 300, 100), (90, 60, 10), (512, 64, 128)])
def test_history_reaches_over_all_cells(spark, budget, history, system):
    """Every window repeats all turns that begin within the history budget before it."""
    turns = [(1, i, "assistant" if i % 2 else "user", "w " * (3 + i * 7 % 20)) for i in range(60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_windows(df, budget, history=history, system=system).collect()
    start, at = [], 0
    for _, _, _, text in turns:
        start.append(at)
        at += len(text.split()) + 4
    for w in made:
        want = [i for i in range(w.first_turn) if start[w.first_turn] - history <= start[i]]
        assert w.n_repeated == len(want), (w.first_turn, w.n_repeated, want)


# --- mixing -----------------------------------------------------------------


def test_targets_fill_up_to_the_cap():
    sizes = {"a": 10, "b": 1000, "c": 0, None: 90}
    got = mixing.targets(sizes)
    # weights a 1, b 2, c 3, null 1: a is capped at 30, c at 0, null at 270
    assert (got["a"], got["c"], got[None]) == (30, 0, 270) and got["b"] == 800
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}
    free = mixing.targets({"a": 60, "b": 60, "c": 60})
    assert [free[s] for s in "abc"] == [Fraction(30), Fraction(60), Fraction(90)]


def test_split_tree_is_exact_and_fair():
    quota = np.array([1000, 37, 0, 5])
    tree = mixing.split_tree(quota, 7, 1)
    assert (tree.sum(axis=0) == quota).all() and (tree >= 0).all()
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3
    assert (tree == mixing.split_tree(quota, 7, 1)).all() and (tree != mixing.split_tree(quota, 7, 2)).any()


def test_groups_of_sources_split_like_one_tree():
    quota = np.random.default_rng(3).integers(0, 50, 40)
    groups = quota.reshape(8, 5)
    sums = groups.sum(axis=1)

    def beside(g, level):  # blocks of the half beside the way to group g
        half = (g >> (2 - level)) ^ 1
        return sums[[x for x in range(8) if x >> (2 - level) == half]].sum()

    trees = [mixing.split_tree(groups[g], 11, 5, g, [beside(g, level) for level in range(3)]) for g in range(8)]
    whole = np.concatenate(trees, axis=1)
    assert (whole.sum(axis=0) == quota).all() and (whole >= 0).all()
    by_shard = whole.sum(axis=1)
    assert by_shard.max() - by_shard.min() <= 4
    # Shares of a group over many seeds: what a plain draw would give on average.
    got = [mixing.split_tree(groups[5], 2, s, 5, [beside(5, level) for level in range(3)])[0].sum() for s in range(400)]
    assert abs(np.mean(got) - sums[5] / 2) < 4 * sums[5] ** 0.5 / 2 / 20 + 0.5


def test_many_sources_need_no_driver(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 4)
    rng = random.Random(11)
    rows = [(i, "v " * rng.choice([0, 1, 5, 40]), f"s{rng.randint(0, 60)}" if i % 9 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += t.count("v")
    goal = mixing.targets(dict(sizes))
    plan = {r.source: r for r in mixing.targeted(mixing.sized(df)).collect()}
    assert {s: r.target for s, r in plan.items()} == {s: float(g) for s, g in goal.items()}
    assert sorted(plan, key=lambda s: plan[s].sid) == sorted(goal, key=lambda s: (s is None, s or ""))
    taken = Counter()
    for r in mixing.taken_per_document(df, block_words=20, shards=5).collect():
        taken[rows[r.doc_id][2]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= Fraction(1, 2) for s in goal)
    draws, _ = mixing.mix(mixing.sized(df), block_words=20, shards=5)
    shards = Counter(r.shard for r in draws.collect())
    assert set(shards) == set(range(5)) and max(shards.values()) < 2 * min(shards.values())


def mix_docs(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(400, None, "a"), (401, "", "d"), (402, "  x \n y", "z"), (402, "  x \n y", "z"), (None, "q r s", "z")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, words int")


def test_mix_meets_its_targets(spark):
    rows, df = mix_docs(spark)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goal = mixing.targets(dict(sizes))
    run = lambda: mixing.taken_per_document(df, block_words=100, shards=4).collect()
    out, again = run(), run()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == float(goal[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= Fraction(1, 2) for s in goal)
    made = mixing.mixed_documents(df, shards=4)
    assert made.columns == df.columns
    by_source = Counter()
    for r in made.collect():
        by_source[r.source] += size(r.text)
    assert {s: n for s, n in by_source.items() if n} == {s: n for s, n in taken.items() if n}
    assert mixing.taken_per_document(df.limit(0)).count() == mixing.mixed_documents(df.limit(0)).count() == 0


# --- tokens -----------------------------------------------------------------


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(3 * i, t) for i, t in enumerate(texts(8))] + [(1, None), (2, ""), (None, "null id"), (4, "word " * 30_000), (6, "again")]
    tok = Tokenizer.from_file(VOCABULARY)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, tie int").repartition(5)
    files = tokens.write_files(df, VOCABULARY)
    got = tokens.read_files(files).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert tokens.read_files(tokens.write_files(df.limit(0), VOCABULARY)).count() == 0


def test_readers_inflate_only_what_they_need(tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "FRAME_BYTES", 300)
    docs = [(i, np.arange(i % 50, dtype="<u4").tobytes()) for i in range(0, 200, 2)]
    path = f"file://{tmp_path}/a.ids.zst"
    writer = tokens.FrameWriter(path)
    for d in docs:
        writer.add(*d)
    writer.close()
    assert list(tokens.FrameReader(path)) == docs
    one = tokens.FrameReader(path)
    assert list(one.documents({86, 87})) == [docs[43]] and one.inflated <= 2 < len(one.frames)
    # Frames are ordinary Zstandard frames, and damage is seen.
    import zstandard

    data = bytearray((tmp_path / "a.ids.zst").read_bytes())
    at, size, plain, _ = one.frames[1]
    assert len(zstandard.ZstdDecompressor().decompress(bytes(data[at : at + size]))) == plain
    start, size, plain, check = one.frames[0]
    one.frames[0] = (start, size, plain, check ^ 1)
    with pytest.raises(ValueError):
        list(one.frame(0))
    (tmp_path / "b").write_bytes(data[:-1])
    with pytest.raises(ValueError):
        tokens.FrameReader(f"file://{tmp_path}/b")


# --- WARC -------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "x" * 3_000_000 + "é"
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", big)]
    rows += [(6, "u", big), (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (8, "u", "<p>one</p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int").repartition(3)
    files = warc.archive(df)
    got = {r.page_id: r for r in warc.read_archives(files).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        data = (h or "").encode()
        r = got[i]
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
        assert r.html == ((h or "") if r.record_type == "response" else None)
    kept = warc.with_references(df, min_bytes=11).filter("refers_to IS NOT NULL").collect()
    assert {(r.page_id, r.refers_to) for r in kept} == {(6, 5)}
    assert warc.read_archives(warc.archive(df.limit(0))).count() == 0


def test_damaged_archives_are_errors():
    import gzip
    import io

    whole = gzip.compress(warc.record(1, "u", b"abc", None) + warc.record(2, "u", b"", None))
    parts = list(warc.split_records(warc.inflate(io.BytesIO(whole))))
    assert [warc.parse(p)[1] for p in parts] == [b"abc", b""]
    members = b"".join(gzip.compress(p) for p in parts)
    assert list(warc.split_records(warc.inflate(io.BytesIO(members)))) == parts
    for bad in (whole[:-12], gzip.compress(parts[0][:-3]), gzip.compress(b"WARC/1.1\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflate(io.BytesIO(bad))))


# --- decontamination --------------------------------------------------------


def similar(doc, item, k=5):
    """Best weighted Jaccard of any item-sized window, by plain counting."""
    words = lambda t: re.findall(r"[0-9a-z\x80-￿]+", (t or "").lower())
    d, b = words(doc), words(item)
    if not b or len(d) < min(k, len(b)):
        return 0.0
    k = min(k, len(b))
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    best, want = 0.0, grams(b)
    for i in range(max(1, len(d) - len(b) + 1)):
        have = grams(d[i : i + len(b)])
        best = max(best, sum((have & want).values()) / sum((have | want).values()))
    return best


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 5)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)] + ["Éa", "don't"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(8, 50))) for i in range(12)] + [(20, "one two three"), (21, ""), (22, None), (23, "a a a a a a a a a a")]
    docs = []
    for i in range(120):
        t = text(rng.randint(0, 150))
        if i % 3 == 0:
            w = rng.choice(items[:12])[1].split()
            for _ in range(i % 4):
                w[rng.choice([0, -1])] = "changed"
            t = f"{t} {' '.join(w).upper() if i % 2 else ', '.join(w)} {text(20)}"
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "ONE two, three!"), (203, "b a a a a a a a a a a b"), (204, items[0][1]), (204, items[0][1]), (None, items[1][1])]
    want = {(d, i): s for d, t in docs for i, b in items if (s := similar(t, b)) >= 0.8}
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(s, 9) for k, s in want.items()}
    assert len(got) == len(want) + 1 and max(r.hamming for r in got) <= decontam.RADIUS
    left = decontam.decontaminated(df, bench)
    bad = {d for d, _ in want}
    assert left.columns == df.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in docs if d is None or d not in bad)
    assert decontam.contaminated(df, bench.limit(0)).count() == decontam.contaminated(df.limit(0), bench).count() == 0


def test_folder_is_below_the_checkpoint_folder(spark):
    from tidemark.session import checkpoint_dir

    assert new_folder(spark, "x").startswith(checkpoint_dir(spark))


def test_a_lean_encoder_forgets_and_encodes_alike(monkeypatch):
    import public_tokenizers

    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "LEAN", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    lean, whole = tokens.Encoder(path, lean=True), tokens.Encoder(path)
    for i in range(30):
        texts = [f"The common words, and rare{i} Word{i * 7} don't <x> {j}." for j in range(4)] + ["", " é\n"]
        assert lean.encode(texts, 2) == whole.encode(texts, 2)
        held = [lean.words, lean.older_words, lean.pieces, lean.older_pieces]
        assert max(map(len, held)) < 60
    assert len(whole.words) > 60 and b"common" in lean.words
