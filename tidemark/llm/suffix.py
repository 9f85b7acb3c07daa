"""Repeated byte strings by sorting suffixes: deep-shallow sort on a cluster.

Every byte that lies in a string of LENGTH bytes which also starts earlier is
removed.  Sorting all suffixes of a corpus would move LENGTH bytes per byte, so
suffixes are brought together in two steps that lose nothing:

1. Each window of LENGTH bytes has an anchor, the least-hashed GRAM bytes inside
   it.  Equal windows have equal anchors at equal places.  Neighbouring windows
   with one anchor form a block; a text has one block per about 35 bytes.  Blocks
   meet by their anchor's hash.  Blocks with nothing else at their anchor are
   done, and of blocks with equal content (two independent 64-bit hashes) all but
   the earliest are repeats as a whole.
2. Where different blocks share an anchor, the earliest block of each content
   sends its bytes, and its windows are sorted as suffixes: a multikey sort by
   eight bytes at a time to a shallow depth, then a blind trie for each group
   that still ties, which compares whole strings once per insertion.  Of equal
   windows all but the earliest are repeats.

An anchor with a large share of all blocks is dealt over salts: each salt keeps
its first block of each content, and windows that stay open are settled by one
more grouping of the salts' distinct windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Emitter, Scratch, rows_of, shuffle_partitions

LENGTH, GRAM = 100, 32
#: Bytes whose blocks are found at a time; positions in it fit POS_BITS.
SEGMENT, POS_BITS = 1 << 20, 21
#: A start, the anchor's distance from it and a number of windows share one long.
PACK, BYTE = 1 << 16, 1 << 8
#: Documents in the sample that looks for hot anchors: one of so many.
SAMPLE = 64
#: Windows sorted at a time, and words of eight bytes that the multikey sort sees.
SORT_WINDOWS, SHALLOW = 60_000, 4

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo 2**64, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        out = []
        for b in (_BASES[0], pow(_BASES[0], -1, 1 << 64), _BASES[1], pow(_BASES[1], -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = out
    return _powers[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    return out


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    n = len(x)
    a = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    a[:n] = x
    a = a.reshape(-1, w)
    ahead = np.minimum.accumulate(a, axis=1).ravel()
    behind = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def blocks_of(data: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Blocks of byte strings: which string, start, anchor's distance from the
    start and windows (packed), hash of the anchor, hash of the content."""
    buf = np.frombuffer(b"".join(data), dtype=np.uint8)
    ends = np.cumsum([len(d) for d in data])
    if len(buf) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down, up2, down2 = powers(len(buf) + 1)
    wide = buf + np.uint64(1)
    s = sums(wide * up[: len(buf)])
    n = len(buf) - gram + 1
    g = mixed((s[gram:] - s[:-gram]) * down[:n])
    low = np.uint64((1 << POS_BITS) - 1)
    anchor = (sliding_least(g & ~low | np.arange(n, dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    room = np.repeat(ends, [len(d) for d in data])[: len(anchor)] - np.arange(len(anchor))
    windows = np.flatnonzero(room >= length)
    if not len(windows):
        return blocks_of([], length, gram)
    a = anchor[windows]
    first = np.flatnonzero(np.r_[True, (np.diff(windows) != 1) | (np.diff(a) != 0)])
    starts, count = windows[first], np.diff(np.r_[first, len(windows)])
    s2 = sums(wide * up2[: len(buf)])
    content = mixed((s2[starts + count + length - 1] - s2[starts]) * down2[starts] + count.astype(np.uint64))
    which = np.searchsorted(ends, starts, side="right")
    packed = (a[first] - starts) * BYTE + count
    return which, starts - np.r_[0, ends][which], packed, g[a[first]], content


def parts(data: bytes, length: int = LENGTH) -> Iterator[tuple[int, bytes]]:
    """Pieces of a long string that together have each of its windows once."""
    for at in range(0, max(1, len(data) - length + 1), SEGMENT):
        yield at, data[at : at + SEGMENT + length - 1]


def find_blocks(docs: DataFrame, length: int) -> DataFrame:
    """Blocks of all documents: khash, chash, doc_id, tie, pos (start and windows)."""

    def run(batches):
        held: list[tuple[int | None, int, int, bytes]] = []

        def flush():
            which, start, packed, khash, chash = blocks_of([h[3] for h in held], length)
            ids = pa.array([h[0] for h in held], pa.int64()).take(pa.array(which))
            tie = np.array([h[1] for h in held], dtype=np.int32)[which]
            at = np.array([h[2] for h in held], dtype=np.int64)[which]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(khash.view(np.int64)), pa.array(chash.view(np.int64)), ids, pa.array(tie), pa.array((at + start) * PACK + packed)],
                names=["khash", "chash", "doc_id", "tie", "pos"],
            )

        size = 0
        for doc_id, tie, text in rows_of(batches, "doc_id", "tie", "text"):
            data = text.encode()
            if len(data) < length:
                continue
            for at, piece in parts(data, length):
                if held and size + len(piece) > SEGMENT:
                    yield flush()
                    size = 0
                held.append((doc_id, tie, at, piece))
                size += len(piece)
        if held:
            yield flush()

    return docs.mapInArrow(run, "khash long, chash long, doc_id long, tie int, pos long")


class Trie:
    """Blind trie over strings of one length: a way down looks at single bytes
    only; the leaf it ends at is compared in full, once."""

    def __init__(self, text: bytes, item: int):
        self.root: list = [None, text, [item]]

    # A leaf is [None, text, items]; an inner node is [depth, children].

    def add(self, text: bytes, item: int) -> None:
        node = self.root
        while node[0] is not None:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == text:
            node[2].append(item)
            return
        lo, hi = 0, len(text)  # length of the common prefix
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if text[:mid] == other[:mid]:
                lo = mid
            else:
                hi = mid - 1
        node, leaf = self.root, [None, text, [item]]
        while node[0] is not None and node[0] < lo:
            node = node[1][text[node[0]]]
        if node[0] == lo:
            node[1][text[lo]] = leaf
        else:
            below = node[:]
            node[:] = [lo, {other[lo]: below, text[lo]: leaf}]

    def leaves(self) -> Iterator[list[int]]:
        """Items of each string, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))


def deep_shallow(strings: np.ndarray, group: np.ndarray) -> Iterator[list[int]]:
    """Rows of ``strings`` (bytes, one string per row) in order of (group, string),
    as lists of the rows of each string.

    Level by level, rows that tie are ordered by their next eight bytes; after
    SHALLOW levels a blind trie orders each group that still ties.
    """
    m, length = strings.shape
    padded = np.zeros((m, -(-length // 8) * 8), dtype=np.uint8)
    padded[:, :length] = strings
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((words[:, 0], group))
    key = np.stack([group[order].astype(np.uint64), words[order, 0]], axis=1)
    cls = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
    for level in range(1, min(SHALLOW, words.shape[1])):
        size = np.bincount(cls)
        tied = np.flatnonzero(size[cls] > 1)
        if not len(tied):
            break
        w = words[order[tied], level]
        again = np.lexsort((w, cls[tied]))
        order[tied] = order[tied][again]
        w = w[again]
        new = np.zeros(len(order), dtype=bool)
        new[1:] = cls[1:] != cls[:-1]
        new[tied[1:]] |= (w[1:] != w[:-1]) & (cls[tied[1:]] == cls[tied[:-1]])
        cls = np.cumsum(new)
    edge = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1], True]).tolist()
    rows = order.tolist()
    flat = np.ascontiguousarray(strings).tobytes()
    for a, b in zip(edge, edge[1:]):
        if b - a == 1:
            yield rows[a:b]
            continue
        items = sorted(rows[a:b])
        trie = Trie(flat[items[0] * length : (items[0] + 1) * length], items[0])
        for i in items[1:]:
            trie.add(flat[i * length : (i + 1) * length], i)
        yield from trie.leaves()


def halves(content: bytes, off: int, n: int, length: int, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(key, first window, windows) for the two kinds of windows of a block.

    Windows with at most ``half`` bytes before the anchor share the bytes right
    of it, the others the bytes left of it; the key hashes anchor and those.
    """
    half = (length - gram) // 2
    cut = min(max(off - half, 0), n)
    out = []
    if cut:
        out.append((key_of(b"l" + content[off - half - 1 : off + gram]), 0, cut))
    if cut < n:
        out.append((key_of(b"r" + content[off : off + length - half]), cut, n - cut))
    return out


def key_of(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def send_blocks(docs_with_blocks: DataFrame, length: int) -> DataFrame:
    """Bytes of the blocks listed per document, once for each half key."""
    schema = pa.schema(
        [
            ("key", pa.int64()),
            ("open", pa.bool_()),
            ("doc_id", pa.int64()),
            ("tie", pa.int32()),
            ("start", pa.int64()),
            ("content", pa.binary()),
        ]
    )

    def run(batches):
        give = Emitter(schema)
        for doc_id, tie, text, blocks in rows_of(batches, "doc_id", "tie", "text", "blocks"):
            data = text.encode()
            for b in blocks:
                at, packed = divmod(b["pos"], PACK)
                off, n = divmod(packed, BYTE)
                content = data[at : at + n + length - 1]
                for key, first, count in halves(content, off, n, length):
                    part = content[first : first + count + length - 1]
                    if give.add((key, b["open"], doc_id, tie, at + first, part), 80 + len(part)):
                        yield give.take()
        if give.rows:
            yield give.take()

    return docs_with_blocks.mapInArrow(
        run, "key long, open boolean, doc_id long, tie int, start long, content binary"
    )


def sort_windows(sent: DataFrame, length: int) -> DataFrame:
    """Sort the windows of each key; rows must come grouped by (key, salt) and in
    order of (doc_id, tie, start) inside.

    Returns doc_id, tie, pos, digest: repeats with a null digest, and for open
    groups each distinct window's first place with the digest of its bytes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int32()), ("pos", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        give = Emitter(schema)

        def settle(rows, group, is_open):
            """Sort the windows of some rows; rows of a group are whole unless open."""
            if not rows:
                return
            sizes = np.array([len(r[3]) - length + 1 for r in rows])
            buf = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
            at = np.r_[0, np.cumsum([len(r[3]) for r in rows])[:-1]]
            row = np.repeat(np.arange(len(rows)), sizes)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            strings = buf[(at[row] + inner)[:, None] + np.arange(length)]
            row_l, inner_l = row.tolist(), inner.tolist()
            repeats: dict[int, list[int]] = {}
            for same in deep_shallow(strings, np.asarray(group)[row]):
                if is_open[row_l[same[0]]]:
                    i = same[0]
                    doc_id, tie, start, _ = rows[row_l[i]]
                    digest = hashlib.blake2b(strings[i].tobytes(), digest_size=16).digest()
                    give.add((doc_id, tie, (start + inner_l[i]) * PACK + 1, digest), 80)
                for i in same[1:]:
                    repeats.setdefault(row_l[i], []).append(inner_l[i])
            for r, js in repeats.items():
                doc_id, tie, start, _ = rows[r]
                js.sort()
                a = js[0]
                for x, y in zip(js, [*js[1:], -1]):
                    if y != x + 1:
                        give.add((doc_id, tie, (start + a) * PACK + x - a + 1, None))
                        a = y

        rows, group, is_open = [], [], []  # whole groups
        own, own_open, last = [], False, None  # the group being read

        def close():
            nonlocal own
            if len(own) > 1 or own_open:
                rows.extend(own)
                group.extend([len(group)] * len(own))
                is_open.extend([own_open] * len(own))
            own = []

        def size(x):
            return sum(len(r[3]) - length + 1 for r in x)

        held = 0
        for key, salt, hot, doc_id, tie, start, content in rows_of(
            batches, "key", "salt", "open", "doc_id", "tie", "start", "content"
        ):
            if (key, salt) != last:
                held += size(own)
                close()
                last, own_open, in_own = (key, salt), hot, 0
                if held >= SORT_WINDOWS:
                    settle(rows, group, is_open)
                    rows, group, is_open, held = [], [], [], 0
            own.append((doc_id, tie, start, content))
            in_own += len(content) - length + 1
            if in_own >= SORT_WINDOWS:  # too large for one sort: its windows stay open
                own_open, in_own = True, 0
                settle(own, [0] * len(own), [True] * len(own))
                own = []
            if give.size >= give.limit:
                yield give.take()
        close()
        settle(rows, group, is_open)
        if give.rows:
            yield give.take()

    return sent.mapInArrow(run, "doc_id long, tie int, pos long, digest binary")


def cut_documents(docs_with_marks: DataFrame, length: int) -> DataFrame:
    """Apply the marks (array of pos per document)."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept", pa.binary()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def run(batches):
        give = Emitter(schema)
        for doc_id, text, marks in rows_of(batches, "doc_id", "text", "marks"):
            data, spans = text.encode(), []
            for pos in sorted(marks or ()):
                at, packed = divmod(pos, PACK)
                end = at + packed % BYTE + length - 1
                if spans and at <= spans[-1]["end"]:
                    spans[-1]["end"] = max(end, spans[-1]["end"])
                else:
                    spans.append({"start": at, "end": end})
            edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            row = (doc_id, len(data), len(data) - len(kept), len(spans), kept, spans)
            if give.add(row, 100 + len(kept)):
                yield give.take()
        if give.rows:
            yield give.take()

    return docs_with_marks.mapInArrow(
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>",
    )


def hot_anchors(docs: DataFrame, length: int, n: int) -> list[int]:
    """Anchors with more than a fourth of a partition's share of the blocks, by a
    sample of documents.  The sample only decides what is salted, never a result;
    at most 4 n anchors can be that frequent."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SAMPLE)) == 0)
    counts = find_blocks(some, length).groupBy("khash").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(8, total // (4 * n))
    return [r["khash"] for r in counts.filter(F.col("count") > least).select("khash").collect()]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) without repeated byte strings:
    doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (removed, in bytes).

    A string counts as repeated if it also starts in a row with a smaller doc_id
    or earlier in the same row.  Null ids come first; rows that share an id are
    ordered by a hash of their text, and rows that repeat id and text are one
    document and give one row.  A null text is empty; a text of fewer than ``length`` bytes keeps
    everything.  Other columns are not read; an empty table gives no rows.
    ``length`` must exceed the anchor's bytes by two at least and 127 at most.
    """
    if not GRAM + 2 <= length <= GRAM + 127:
        raise ValueError(f"length must be in {GRAM + 2} .. {GRAM + 127}")
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    shared_ids = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", (F.hash(text) if shared_ids else F.lit(0)).alias("tie"), text.alias("text"))
    if shared_ids:
        d = d.distinct()
    scratch = Scratch(spark, "suffix")
    hot = hot_anchors(d, length, n)
    is_hot = F.col("khash").isin(hot) if hot else F.lit(False)
    place = [F.col("doc_id").asc_nulls_first(), "tie", "pos"]
    found = find_blocks(d, length).withColumn(
        "salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id", "pos"), F.lit(n)) + 1).otherwise(F.lit(0))
    )
    w = Window.partitionBy("khash", "salt").orderBy("chash", *place)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = found.select(
        "khash",
        "chash",
        "salt",
        "doc_id",
        "tie",
        "pos",
        F.count(F.lit(1)).over(whole).alias("n"),
        F.coalesce(F.lag("chash").over(w) == F.col("chash"), F.lit(False)).alias("repeat"),
        (F.first("chash").over(whole) != F.last("chash").over(whole)).alias("several"),
    ).filter("n > 1 OR salt > 0")
    keys = F.col("salt") > 0
    known = scratch.put(
        level.select(
            "doc_id",
            "tie",
            "pos",
            "repeat",
            (~F.col("repeat") & (F.col("several") | keys)).alias("mixed"),
            keys.alias("open"),
            F.when(keys & ~F.col("repeat"), F.col("khash")).alias("khash"),
            F.when(keys & ~F.col("repeat"), F.col("chash")).alias("chash"),
        ).filter("repeat OR mixed")
    )
    # The salts' first blocks of a content: at most one per salt.
    salted = known.filter("open AND NOT repeat").withColumn(
        "rank", F.row_number().over(Window.partitionBy("khash", "chash").orderBy(*place))
    )
    of_doc = ["doc_id", "tie"]
    marks = known.filter("repeat").select(*of_doc, "pos").unionByName(salted.filter("rank > 1").select(*of_doc, "pos"))
    mixed_blocks = (
        known.filter("mixed AND NOT open").select(*of_doc, "pos", "open")
        .unionByName(salted.filter("rank = 1").select(*of_doc, "pos", "open"))
        .groupBy(*of_doc)
        .agg(F.collect_list(F.struct("pos", "open")).alias("blocks"))
    )

    def at_docs(lists: DataFrame, how: str) -> DataFrame:
        r = lists.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
        return d.join(r, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), how).drop("_id", "_tie")

    sent = send_blocks(at_docs(mixed_blocks, "inner"), length).withColumn(
        "salt", F.when(F.col("open"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)) + 1).otherwise(F.lit(0))
    )
    dealt = sent.repartition(n, "key", "salt").sortWithinPartitions(
        "key", "salt", F.col("doc_id").asc_nulls_first(), "tie", "start"
    )
    result = scratch.put(sort_windows(dealt, length))
    # Distinct windows of each chunk or salt: few rows per digest.
    late = result.filter("digest IS NOT NULL").withColumn(
        "rank", F.row_number().over(Window.partitionBy("digest").orderBy(*place))
    )
    marks = (
        marks.unionByName(result.filter("digest IS NULL").select(*of_doc, "pos"))
        .unionByName(late.filter("rank > 1").select(*of_doc, "pos"))
        .groupBy(*of_doc)
        .agg(F.collect_list("pos").alias("marks"))
    )
    return cut_documents(at_docs(marks, "left"), length)
