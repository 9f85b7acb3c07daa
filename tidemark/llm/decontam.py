"""Benchmark decontamination by SimHash of item-sized windows.

For a benchmark item of m words, every window of m words of a document is a
candidate.  Windows and items get a SimHash of their word shingles; items of a
size are indexed by RADIUS + 1 blocks of the fingerprint, so any item within the
radius agrees with the window in some block and none is missed; candidates are
verified by the exact weighted Jaccard similarity of their shingles (weight: the
number of times a shingle occurs).

A window that shares no shingle with any item has similarity zero, so windows
are only laid around positions whose shingle some item has: this leaves out
nothing that could reach the threshold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import REMEMBERING, Emitter, file_system, free_prefix, new_folder

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: Benchmark items, and their characters, per pass over the documents on average;
#: a worker holds the index of one such block.
ITEM_BLOCK, ITEM_CHARS = 20_000, 8_000_000
#: Characters of documents that are cut into words at a time (one document at least).
STEP = 1 << 20
#: Window starts of one document that are fingerprinted at a time.
STARTS = 1 << 14

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
# Letters and digits of ASCII and every byte of a longer character.
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text where its words begin
    (one more entry for the end).  Words are lower-cased runs of letters and digits."""
    return run_hashes([t.lower().encode("utf-8", "replace") for t in texts], _IS_WORD)


def run_hashes(data: list[bytes], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for runs of the bytes that ``word_bytes`` marks (not the space)."""
    buf = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    is_word = word_bytes[buf]
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    size = 1 << max(20, int(len(buf)).bit_length())
    up, down = powers(size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((buf + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    offsets = np.cumsum([0, *(len(d) + 1 for d in data)])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(_BASE) + words[j : j + n])
    return h


def window_fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(h) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[size:] - sums[:-size]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of the least over sum of the greatest weights."""
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least)


class Index:
    """A block of items: shingles that occur, and per size a multi-index."""

    def __init__(self, items: list[tuple[int, str]]):
        self.blocks = [(64 * i // (RADIUS + 1), 64 * (i + 1) // (RADIUS + 1)) for i in range(RADIUS + 1)]
        self.items: list[tuple[int, int, int, Counter]] = []  # id, words, fingerprint, shingles
        self.sizes: dict[int, dict[tuple[int, int], list[int]]] = {}
        owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        words, at = word_hashes([t for _, t in items])
        for (item_id, _), a, b in zip(items, at, at[1:]):
            m = int(b - a)
            if not m:
                continue
            k = min(SHINGLE, m)
            h = shingle_hashes(words[a:b], k)
            fp = int(window_fingerprints(h, len(h))[0])
            index = self.sizes.setdefault(m, defaultdict(list))
            for i, v in enumerate(self.cut(fp)):
                index[i, v].append(len(self.items))
            self.items.append((item_id, m, fp, Counter(h.tolist())))
            for x in h.tolist():
                owners[k][x].add(m)
        self.known = {k: np.array(sorted(o), dtype=np.uint64) for k, o in owners.items()}
        self.owners = {k: {x: tuple(s) for x, s in o.items()} for k, o in owners.items()}
        self.bits = {}
        for k, v in self.known.items():
            self.bits[k] = np.zeros(1 << 20, dtype=bool)
            self.bits[k][v & np.uint64((1 << 20) - 1)] = True

    def cut(self, fp: int) -> list[int]:
        return [fp >> a & (1 << (b - a)) - 1 for a, b in self.blocks]

    def hits(self, h: np.ndarray, k: int) -> np.ndarray:
        """Positions of shingles that some item has."""
        maybe = np.flatnonzero(self.bits[k][h & np.uint64((1 << 20) - 1)])
        known, x = self.known[k], h[maybe]
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return maybe[known[at] == x]

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """Best window per item: similarity, start word, words, bits that differ."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for k in self.known:
            h = shingle_hashes(words, k)
            near: dict[int, list[int]] = defaultdict(list)
            for p in self.hits(h, k).tolist():
                for m in self.owners[k][int(h[p])]:
                    near[m].append(p)
            for m, at in near.items():
                self.windows(h, k, m, at, best)
        return best

    def windows(self, h: np.ndarray, k: int, m: int, at: list[int], best: dict) -> None:
        size = min(m - k + 1, len(h))  # a shorter document is one window
        last = len(h) - size
        spans: list[list[int]] = []
        for p in at:
            a, b = max(0, p - size + 1), min(p, last)
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        for lo, hi in spans:
            for a in range(lo, hi + 1, STARTS):
                b = min(hi + 1, a + STARTS)
                for start, fp in enumerate(window_fingerprints(h[a : b - 1 + size], size).tolist(), a):
                    found = {i for kv in enumerate(self.cut(fp)) for i in self.sizes[m].get(kv, ())}
                    for i in found:
                        item_id, _, item_fp, shingles = self.items[i]
                        d = (fp ^ item_fp).bit_count()
                        if d > RADIUS:
                            continue
                        s = similarity(Counter(h[start : start + size].tolist()), shingles)
                        if s >= SIMILARITY and (i not in best or (s, -start) > (best[i][0], -best[i][1])):
                            best[i] = (s, start, size + k - 1, d)


@lru_cache(maxsize=1)
def block_index(folder: str) -> Index:
    """Index of a block of items in the shared folder; a worker keeps the last one."""
    fs, path = file_system(folder)
    rows = pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["item_id", "text"])
    return Index(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())))


class _Held:
    forget = staticmethod(block_index.cache_clear)


REMEMBERING.append(_Held)


def item_blocks(benchmark: DataFrame) -> list[str]:
    """Writes the items to the shared folder in blocks; the folders of the blocks."""
    text = F.coalesce("text", F.lit(""))
    n, chars = benchmark.agg(F.count(F.lit(1)), F.sum(F.char_length(text))).first()
    if not n:
        return []
    blocks = max(-(-n // ITEM_BLOCK), -(-chars // ITEM_CHARS), 1)
    # Dealt by the row's number, so that repeated items spread too.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    root = new_folder(benchmark.sparkSession, "items")
    dealt = benchmark.select("item_id", text.alias("text"), block.alias("block"))
    dealt.repartition("block").write.partitionBy("block").parquet(root)
    used = benchmark.sparkSession.read.parquet(root).select("block").distinct().collect()
    return [f"{root}/block={b}" for b in sorted(r["block"] for r in used)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a window like a benchmark item, one row per row of
    ``docs`` (doc_id, text) and item: doc_id, item_id, similarity, start_word,
    window_words, hamming (of the best, then first, window).

    Items without words match nothing; an item with fewer than five words is one
    shingle; a document with fewer words than an item is one window.  Null texts
    have no words.  Repeated rows give repeated results; repeated items count
    once per row.  Other columns are not read.  The benchmark is dealt into blocks
    of about ITEM_BLOCK items and ITEM_CHARS characters at most, written to the
    shared folder; each is one pass over the documents, whose tasks read the block.
    """
    spark = docs.sparkSession
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("item_id", pa.int64()),
            ("similarity", pa.float64()),
            ("start_word", pa.int64()),
            ("window_words", pa.int64()),
            ("hamming", pa.int32()),
        ]
    )
    ddl = "doc_id long, item_id long, similarity double, start_word long, window_words long, hamming int"

    def search(folder):
        def run(batches):
            index, give = block_index(folder), Emitter(schema)

            def some(ids, texts):
                words, at = word_hashes(texts)
                at = at.tolist()
                suspects: set[int] = set()
                for k in index.known:
                    # Shingles over a border only cost a look at their document.
                    p = index.hits(shingle_hashes(words, k), k)
                    suspects.update(np.searchsorted(at, p, side="right").tolist())
                for j in suspects:
                    for i, (s, start, n, d) in sorted(index.matches(words[at[j - 1] : at[j]]).items()):
                        give.add((ids[j - 1], index.items[i][0], s, start, n, d))

            for b in batches:
                ids, texts, size = [], [], 0
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids.append(doc_id)
                    texts.append(text or "")
                    size += len(texts[-1])
                    if size >= STEP:
                        some(ids, texts)
                        ids, texts, size = [], [], 0
                if ids:
                    some(ids, texts)
                if give.rows:
                    yield give.take()

        return docs.select("doc_id", "text").mapInArrow(run, ddl)

    found = [search(folder) for folder in item_blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], ddl)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    A row with a null doc_id can't be named by a result and is kept."""
    name = f"{free_prefix(docs.columns)}id"
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"] == bad[name], "left_anti")
