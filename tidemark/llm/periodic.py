"""Runs: stretches of words that repeat with a period, found by longest common extensions.

The texts of a block are one array of word numbers with a separator of its own
behind each text.  A difference cover D of the numbers below ``MODULUS`` holds,
for any two positions, an offset below the modulus that takes both to sampled
positions.  Only the sampled suffixes are sorted: by their first words, then by
doubling.  The extension of two positions compares the few words up to the
synchronised samples and reads the rest as a range minimum of neighbouring common
prefixes from a sparse table.

For each period q the positions 0, g, 2g, ... with g = (LEAST - 1) q form a grid,
some N / (g) positions a period, a harmonic sum over all.  A run of length
LEAST * q or more matches itself at distance q over at least g positions, so one
of them is on the grid; the extensions of that position and its partner in both
directions give the whole run.  The backward ones come from the reversed array.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of

#: A run holds its period at least LEAST times and at least SHORTEST words.
LEAST, SHORTEST = 4, 6
#: A perfect difference cover of the numbers below 13.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words of a block (one text at least).
BLOCK = 200_000

# Least offset below MODULUS that takes positions of residues (a, b) into the cover.
_SYNC = np.array(
    [[min(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER) for b in range(MODULUS)] for a in range(MODULUS)]
)
_PLACE = np.array([COVER.index(r) if r in COVER else 0 for r in range(MODULUS)])


class Extensions:
    """Longest common extensions to the right in an array of numbers.

    ``text_of`` numbers the texts of the positions, in ascending order; every text
    ends in a number that occurs nowhere else.  Memory is some hundred bytes a
    sampled position.
    """

    def __init__(self, words: np.ndarray, text_of: np.ndarray):
        n = len(words)
        # Numbers of their own behind the end, so that every sample has MODULUS words.
        self.words = np.concatenate([words, int(words.max(initial=0)) + 1 + np.arange(4 * MODULUS)])
        blocks = n // MODULUS + 2
        self.samples = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        ranks = self._sort(np.append(text_of, [int(text_of[-1]) + 1 if n else 0] * 4 * MODULUS))
        self.rank = ranks[-1]
        self._table(ranks)

    def _sort(self, text_of: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first MODULUS * 2^k words, for every
        k until all differ.  A rank is the place of the first of its equals."""
        m, s = len(self.samples), self.samples
        keys = [text_of[s]]
        bits = int(self.words.max()).bit_length()
        some = 63 // bits  # words that one key holds
        for at in range(0, MODULUS, some):
            part = np.zeros(m, dtype=np.int64)
            for k in range(at, min(at + some, MODULUS)):
                part = (part << bits) | self.words[s + k]
            keys.append(part)
        order = np.lexsort(keys[::-1])
        new = np.ones(m, dtype=bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        ranks, step = [rank], len(COVER)
        tied = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
        while len(tied):
            # Equals lie in one text and end before its separator, so the next sample exists.
            after = rank[np.minimum(tied + step, m - 1)]
            order = np.lexsort((after, rank[tied]))
            of, nxt = rank[tied][order], after[order]
            first = np.append(True, of[1:] != of[:-1])
            inside = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
            new = first | np.append(True, nxt[1:] != nxt[:-1])
            rank = rank.copy()
            rank[tied[order]] = np.maximum.accumulate(np.where(new, of + inside, 0))
            ranks.append(rank)
            step *= 2
            tied = tied[np.bincount(rank[tied], minlength=m)[rank[tied]] > 1]
        return ranks

    def _table(self, ranks: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in the order, and their minima over 2^k places."""
        m = len(self.samples)
        place = np.empty(m, dtype=np.int64)
        place[self.rank] = np.arange(m)
        a, b = place[:-1].copy(), place[1:].copy()
        common = np.zeros(max(m - 1, 0), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            step = len(COVER) << k
            same = ranks[k][a] == ranks[k][b]
            common += np.where(same, MODULUS << k, 0)
            a, b = np.where(same, np.minimum(a + step, m - 1), a), np.where(same, np.minimum(b + step, m - 1), b)
        common += self._direct(self.samples[a], self.samples[b], np.full(len(common), MODULUS))
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, at most ``most``."""
        found = np.zeros(len(i), dtype=np.int64)
        live = np.arange(len(i))
        for k in range(MODULUS):
            live = live[most[live] > k]
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
            if not len(live):
                break
            found[live] += 1
        return found

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal from i and j on; i and j differ and lie in one text
        (else the result may be too small)."""
        sync = _SYNC[i % MODULUS, j % MODULUS]
        found = self._direct(i, j, sync)
        on = np.flatnonzero(found == sync)
        a, b = i[on] + sync[on], j[on] + sync[on]
        a, b = (self.rank[x // MODULUS * len(COVER) + _PLACE[x % MODULUS]] for x in (a, b))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1  # floor of the binary logarithm
        for k in np.unique(level):
            at = level == k
            found[on[at]] += np.minimum(self.minima[k][lo[at]], self.minima[k][hi[at] - (1 << int(k))])
        return found


def runs_of(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text of word numbers, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(starts[-1])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = int(sizes.max(initial=0))
    if longest < SHORTEST:
        return found
    top = 1 + max(max(t, default=0) for t in texts)
    words = np.concatenate([np.array([*t, top + k], dtype=np.int64) for k, t in enumerate(texts)])
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    at, period = [], []
    for q in range(1, longest // LEAST + 1):
        grid = (LEAST - 1) * q if q > 1 else SHORTEST - 1
        hit = np.flatnonzero(words[: n - q : grid] == words[q::grid]) * grid
        if len(hit):
            at.append(hit)
            period.append(np.full(len(hit), q))
    if not at:
        return found
    i, q = np.concatenate(at), np.concatenate(period)
    ahead = Extensions(words, text_of)(i, i + q)
    # Position p of the array is position n - 1 - p of the reversed one.
    back = Extensions(words[::-1], text_of[-1] - text_of[::-1])(n - 1 - i, n - 1 - i - q)
    start, length = i - back + 1, back + ahead - 1 + q
    keep = length >= np.maximum(SHORTEST, LEAST * q)
    start, length, q = start[keep], length[keep], q[keep]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    # Of equal stretches the smallest period is the run's; the others are its multiples.
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    for s, size, p in sorted(zip(start[first].tolist(), length[first].tolist(), q[first].tolist(), strict=True), key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(starts, s, "right")) - 1
        found[k].append((s - int(starts[k]), size, p))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for s, size, q in runs:
        change[s + q] += 1
        change[s + size] -= 1
    return np.cumsum(change)[:n] == 0


def word_runs(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed.

    Words are runs without ASCII white space, numbered from 0.  ``runs`` lists
    (start, length, period) of every maximal stretch with a smallest period q, at
    least four periods and six words, by start, then period.  ``collapsed`` is the
    text of the words that no run holds behind its first period, joined by one
    space.  A null or empty text has no words and no runs, an empty collapsed text.
    Repeated rows and null ids are rows like any other; other columns are not read;
    an empty table gives an empty result.  A text is handled whole, in one task,
    with memory in proportion to its words.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
            ("collapsed", pa.binary()),
        ]
    )

    def finish(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        number: dict[bytes, int] = defaultdict(count().__next__)
        found = runs_of([list(map(number.__getitem__, t)) for t in texts])
        left = [
            b" ".join(t if not r else [w for w, k in zip(t, kept_words(len(t), r).tolist(), strict=True) if k])
            for t, r in zip(texts, found, strict=True)
        ]
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
        columns = [ids, [len(t) for t in texts], runs, left]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        ids, texts, size = [], [], 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids.append(doc_id)
            texts.append(text.split())
            size += len(texts[-1])
            if size >= BLOCK or len(ids) >= 10_000:
                yield finish(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield finish(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    fields = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return rows.mapInArrow(run, fields).withColumn("collapsed", F.col("collapsed").cast("string"))


def run_table(runs: str = "runs") -> Column:
    """One line ``start,length,period`` per run."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def longest_run(runs: str = "runs") -> Column:
    """The longest run; of equals the one that starts first, then the shorter period.
    Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["l"].alias("length"), (-best["p"]).alias("period")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row; one in ten texts repeats a part of itself.

    With h the crc32 of the decimal doc_id: where h is a multiple of 10 and the text
    has n words, words from a = floor(h / 10) mod n on are the p words from there
    over and over, p = 1 + floor((n - a) / (3 + floor(h / 10) mod 8)), joined by one
    space.  Other texts, and those of null ids, stay as they are.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out = []
                for h, text in rows_of([part], "h", "text"):
                    if h is not None and h % 10 == 0 and (words := text.split()):
                        n, g = len(words), h // 10
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        text = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
                    out.append(text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "text"])

    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.crc32(F.col("doc_id").cast("string")).alias("h"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
