"""Toxicity by a counterfactual-regularised linear classifier.

The features of a text are its distinct words and the beginnings of its words,
so that unseen inflections of a known stem still count.  The classifier is a
logistic regression with one more penalty: in every labelled sentence that names
a group, the group's term is swapped for another one, and the squared change of
the sentence's score is penalised.  A term that only happens to stand in toxic
sentences thus loses its weight against the others, and neutral mentions of a
group are not taken for abuse.

What may be swapped is data: the fixed lists of identity terms, and terms induced
from the fitting fold, words that fill the same slot (equal neighbours on both
sides) and occur under both labels.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.fitting import descend, sample_ids, sigmoid

#: Identity terms by language; terms of one list are swapped for each other.
TERMS = {
    "en": "women men girls boys muslims christians jews hindus atheists immigrants refugees foreigners "
    "gays lesbians disabled blind deaf elderly africans asians europeans",
    "de": "frauen männer mädchen jungen muslime christen juden einwanderer ausländer schwule behinderte",
    "fr": "femmes hommes filles garçons musulmans chrétiens juifs immigrés étrangers homosexuels handicapés",
    "es": "mujeres hombres niñas niños musulmanes cristianos judíos inmigrantes extranjeros homosexuales discapacitados",
}
#: Lengths of word beginnings that are features.
STEMS = (4, 5, 6)
#: Labelled rows, features, and swapped sentences of a fit, at most.
FIT_ROWS, FIT_FEATURES, FIT_SWAPS = 8_000, 5_000, 20_000
#: Induced terms at most, those with the most slots, and other words of a term.
MOST_TERMS, MOST_OTHERS = 200, 8
#: Rows that a feature must occur in, standard errors that its rate must differ
#: from the labels' by (swapped terms are always features), and the weights of
#: the two penalties.
LEAST_ROWS, LEAST_ERRORS, SHRINK, FAIR = 4, 5.0, 2e-5, 1.0
#: Words whose features a worker remembers.
MEMORY = 300_000

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) >= n)]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    weights: dict[str, float]
    offset: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def score(self, text: str) -> float:
        """Probability of label 1; an empty text has the offset's."""
        found: set[str] = set()
        known = self.known
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                if len(known) > MEMORY:
                    known.clear()
                f = known[w] = tuple(x for x in features_of(w) if x in self.weights)
            if f:
                found.update(f)
        return float(sigmoid(self.offset + sum(self.weights[f] for f in sorted(found))))


def fixed_terms(lists: Mapping[str, str] = TERMS) -> dict[str, list[str]]:
    """Each term of the lists with the others of its list, the next one first."""
    out = {}
    for terms in (t.split() for t in lists.values()):
        for i, w in enumerate(terms):
            out[w] = terms[i + 1 :] + terms[:i]
    return out


def swaps(text: str, terms: Mapping[str, Sequence[str]] | None = None) -> list[tuple[set[str], set[str]]]:
    """For each sentence with a term: its words, and those after a swap; one swap for
    each of its terms.

    Which other term comes in depends on the sentence's length alone, so every term
    meets others over the sentences."""
    terms = fixed_terms() if terms is None else terms
    out = []
    for s in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(s))
        for w in sorted(words & terms.keys()):
            other = terms[w][len(s) % len(terms[w])]
            if other not in words:
                out.append((words, words - {w} | {other}))
    return out


def induced_terms(rows: DataFrame) -> dict[str, list[str]]:
    """Terms that the labelled rows (text, label) suggest: words that occur under both
    labels in at least LEAST_ROWS rows each, with the words that share a slot with them.

    Slots are counted over all sentences of the rows.  Inside a slot each word is paired
    with the next one in order only, so a slot with many words makes as many pairs.  At
    most MOST_TERMS words come to the driver."""

    def slots(batches):
        for b in batches:
            for text, y in zip(*(b.column(c).to_pylist() for c in ("text", "label")), strict=True):
                found = set()
                for s in _SENTENCE.split((text or "").lower()):
                    w = _WORD.findall(s)
                    found.update((x, None, None) for x in w)
                    found.update((x, a, c) for a, x, c in zip(w, w[1:], w[2:]))
                if found:
                    word, left, right = zip(*found)
                    yield pa.RecordBatch.from_pydict(
                        {"word": word, "before": left, "after": right, "label": [y] * len(word)},
                        schema=pa.schema([("word", pa.string()), ("before", pa.string()), ("after", pa.string()), ("label", pa.int32())]),
                    )

    seen = rows.select("text", "label").mapInArrow(slots, "word string, before string, after string, label int")
    seen = seen.groupBy("word", "before", "after").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    under_both = (F.col("bad") >= LEAST_ROWS) & (F.col("n") - F.col("bad") >= LEAST_ROWS)
    common = seen.filter(F.col("before").isNull() & under_both).select("word")
    slot = seen.filter(F.col("before").isNotNull()).join(common, "word").groupBy("before", "after").agg(F.array_sort(F.collect_set("word")).alias("words"))
    slot = slot.filter(F.size("words") > 1)
    follower = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("words", (i + 1) % F.size("words")).alias("other")))
    pairs = slot.select(F.inline(follower)).groupBy("word", "other").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "other")))
    terms = pairs.groupBy("word").agg(F.sum("n").alias("slots"), F.slice(ranked, 1, MOST_OTHERS)["other"].alias("others"))
    return {r["word"]: r["others"] for r in terms.orderBy(F.desc("slots"), "word").limit(MOST_TERMS).collect()}


def fit_rows(
    rows: Iterable[tuple[set[str], int]], pairs: list[tuple[set[str], set[str]]], fair: float = FAIR, steps: int = 400
) -> tuple[dict[str, float], float]:
    """Weights and offset from (features, label) rows and (features, swapped features) pairs.

    The rows are read once; what is held of them is a number per feature."""
    code: dict[str, int] = {}
    coded, labels = [], []
    for f, v in rows:
        coded.append(np.fromiter((code.setdefault(x, len(code)) for x in f), dtype=np.int32))
        labels.append(v)
    n, n1 = len(labels), sum(labels)
    df, pos = np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=np.int64)
    for c, v in zip(coded, labels):
        df[c] += 1
        if v:
            pos[c] += 1
    share = (n1 + 1) / (n + 2)
    swapped = {x for a, b in pairs for x in a ^ b}
    z = {x: abs(int(pos[i]) - int(df[i]) * share) / (int(df[i]) * share * (1 - share)) ** 0.5 for x, i in code.items() if df[i] >= LEAST_ROWS}
    useful = (x for x in z if z[x] >= LEAST_ERRORS or x in swapped)
    names = sorted(useful, key=lambda x: (x not in swapped, -z[x], x))[:FIT_FEATURES]
    at = {x: i for i, x in enumerate(names)}
    place = np.full(len(code), -1, dtype=np.int64)
    for x, i in at.items():
        place[code[x]] = i
    sets = [np.sort(place[c][place[c] >= 0]) for c in coded]
    del coded, code, place
    col = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    y = np.array(labels, dtype=float)
    p_col, p_row, p_sign = [], [], []
    for k, (a, b) in enumerate(pairs):
        for sign, only in ((1.0, a - b), (-1.0, b - a)):
            for i in sorted(at[x] for x in only if x in at):
                p_col.append(i), p_row.append(k), p_sign.append(sign)
    p_col, p_row, p_sign = np.array(p_col, dtype=np.int64), np.array(p_row, dtype=np.int64), np.array(p_sign)
    d = len(names)

    def gradient(w):
        s = np.bincount(row, w[col], minlength=n)[:n] + w[d]
        e = (sigmoid(s) - y) / max(n, 1)
        g = np.append(np.bincount(col, e[row], minlength=d)[:d] + SHRINK * w[:d], e.sum())
        if len(p_col):
            change = np.bincount(p_row, p_sign * w[p_col], minlength=len(pairs))
            g[:d] += fair * np.bincount(p_col, p_sign * change[p_row], minlength=d)[:d] / len(pairs)
        return g

    start = np.zeros(d + 1)
    start[d] = np.log(share / (1 - share))
    w = descend(gradient, start, steps, 0.05)
    return {x: float(v) for x, v in zip(names, w) if v}, float(w[d])


def swapped(rows: DataFrame, terms: Mapping[str, Sequence[str]], most: int = FIT_SWAPS) -> DataFrame:
    """The features that a swap takes away and brings, of ``most`` swapped sentences of
    the rows (_id, text): order, lost, won.

    All sentences take part; those with the lowest hash of row, sentence and term stay.
    A task keeps its own lowest ones, so it never holds more than ``most``."""

    def run(batches):
        kept: list = []
        for b in batches:
            for i, text in zip(*(b.column(c).to_pylist() for c in ("_id", "text")), strict=True):
                for k, (before, after) in enumerate(swaps(text or "", terms)):
                    order = xxhash.xxh64_intdigest(f"{i}:{k}", 7) >> 1
                    if len(kept) < most or -kept[0][0] > order:
                        one, two = features(before), features(after)
                        row = (-order, "\n".join(sorted(one - two)), "\n".join(sorted(two - one)))
                        heapq.heappush(kept, row) if len(kept) < most else heapq.heapreplace(kept, row)
        if kept:
            order, lost, won = zip(*sorted(kept, reverse=True))
            yield pa.RecordBatch.from_pydict({"order": [-o for o in order], "lost": lost, "won": won})

    return rows.select("_id", "text").mapInArrow(run, "order long, lost string, won string").orderBy("order", "lost", "won").limit(most)


def labelled(docs: DataFrame, labels: DataFrame, fit_fold, label: str = "toxic") -> DataFrame:
    """At most FIT_ROWS labelled rows of the fitting fold: _id, label, text."""
    ids = sample_ids(labels, label, fit_fold, FIT_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("_id", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, fit_fold, label: str = "toxic", fair: float = FAIR) -> Model:
    """Fit on at most FIT_ROWS labelled documents, whole texts.

    Their features and swaps are taken on the executors, and one task fits the
    model; its input is bounded by FIT_ROWS rows and FIT_SWAPS swapped sentences, the
    model by FIT_FEATURES weights.  Only terms and weights come to the driver.
    Without labelled rows every score is 0.5.
    """
    rows = labelled(docs, labels, fit_fold, label)
    terms = induced_terms(rows) | fixed_terms()

    def extract(batches):
        for b in batches:
            found = ["\n".join(sorted(words_of(t or ""))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), b.column("label"), pa.array(found, pa.string())], names=["id", "label", "one"])

    def learn(batches):
        got, pairs = [], []
        for b in batches:
            for i, y, one, two in zip(*(b.column(c).to_pylist() for c in ("id", "label", "one", "two")), strict=True):
                if y is None:
                    pairs.append((i, set(one.split("\n")) - {""}, set(two.split("\n")) - {""}))
                else:
                    got.append((i, int(y), one))
        train = ((features(set(f.split("\n")) - {""}), y) for _, y, f in sorted(got))
        found = [(a, c) for _, a, c in sorted(pairs, key=lambda p: (p[0], sorted(p[1]), sorted(p[2])))]
        weights, offset = fit_rows(train, found, fair) if got else ({}, 0.0)
        names = list(weights)
        yield pa.RecordBatch.from_pydict({"name": ["", *names], "weight": [offset, *(weights[x] for x in names)]})

    made = rows.mapInArrow(extract, "id long, label int, one string").withColumn("two", F.lit(None).cast("string"))
    pairs = swapped(rows, terms).select(F.col("order").alias("id"), F.lit(None).cast("int").alias("label"), F.col("lost").alias("one"), F.col("won").alias("two"))
    learned = made.unionByName(pairs).repartition(1).mapInArrow(learn, "name string, weight double")
    got = {r["name"]: r["weight"] for r in learned.collect()}
    return Model(got, got.pop("", 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text), whole texts.

    A null text is empty.  The score depends on the text alone.  The model's size
    is bounded by FIT_FEATURES weights."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.offset))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            scores = [m.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
