"""Byte-level BPE of whole texts, long ones by tree concatenation, and back.

A long text is cut at code points into a tree of halves.  The leaves are rows and
are encoded in parallel, wherever Spark puts them.  Two neighbouring halves are
joined by encoding a small window around the join again; the window grows until
it agrees with both sides, and the three parts are spliced where they agree.

Why the splice is exact.  The split into words (``starts`` marks the first token
of each) is found from left to right and looks at most a few characters ahead, so
from a true word start on it does not depend on what stands before, and before the
last ``MARGIN`` bytes of a part not on what follows.  Inside a word, a sequence of
tokens is the encoding of its bytes if and only if each neighbouring pair is the
encoding of the pair's bytes.  So two encodings may be spliced

* at a word start that both have, outside the margin of the part that ends, or
* at a token that both have, inside a run of characters of one class (letters,
  digits, white space, other) that goes on in the part that ends: all pairs are
  then neighbours in one of the two.

Encoding a window that has grown to both halves is exact by itself.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import REMEMBERING, rows_of

#: Code points of a leaf at most; texts longer than two leaves become trees.
LEAF = 8192
#: Bytes on each side of a join in the first window.
WINDOW = 64
#: Bytes before the end of a part in which its split into words may still change:
#: four characters of four bytes.
MARGIN = 16
#: Bit of the first token of a word; ids are smaller.
START = 1 << 30
#: Cells that a worker remembers, then it starts afresh, and characters of one.
MEMORY, LONG_CELL = 500_000, 48
#: Bytes of tokens and text that a task holds before it hands out a batch.
BATCH = 4_000_000

# White space is a word break wherever other signs follow: one blank belongs to what
# follows it, any other last sign of white space stands alone.  So words break before
# a blank and its signs, and before white space that follows a sign.
_SPACE = " \t\n\x0b\x0c\r"
_CELL = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?= [^ \t-\r])|[ \t-\r]+[^ \t-\r]*")
# Signs that may count as white space as well: their texts are encoded as a whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


@dataclass
class Node:
    """Encoding of data[lo:hi]: token ids, their end offsets and word starts."""

    lo: int
    hi: int
    ids: np.ndarray
    ends: np.ndarray
    starts: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.concatenate([[self.lo], self.ends[:-1]]) if len(self.ends) else self.ends


class Bpe:
    """A tokenizer file of the ``tokenizers`` library with byte-level BPE."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        split = self.tok.pre_tokenizer
        if self.tok.normalizer is not None or not isinstance(split, ByteLevel) or split.add_prefix_space:
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path} has added tokens that take in their neighbours")
        marks = sorted((t.content for t in added), key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        byte_of = byte_alphabet()
        self.bytes = np.full(1 + max(self.tok.get_vocab().values(), default=0), b"", dtype=object)
        for token, i in self.tok.get_vocab().items():
            known = all(c in byte_of for c in token)
            self.bytes[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.cells: dict[str, bytes] = {}
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        REMEMBERING.append(self)

    def forget(self) -> None:
        self.cells = {}

    def _encoded(self, text: str) -> np.ndarray:
        """The library's ids of the text with START on the first of each word."""
        e = self.tok.encode(text, add_special_tokens=False)
        ids, words = np.array(e.ids, dtype=np.int32), np.array(e.word_ids, dtype=np.int64)
        return ids | np.append(True, words[1:] != words[:-1])[: len(ids)] * np.int32(START)

    def _learn(self, cells: list[str]) -> None:
        """Remember the cells' ids, those of many cells from one call.

        Cells that begin with white space and end without stay what they are in a
        row; their places in the result follow from their lengths."""
        row = [c for c in cells if c[0] in _SPACE and c[-1] not in _SPACE]
        for at in range(0, len(row), 4096):
            some = row[at : at + 4096]
            found = self._encoded("".join(some))
            ends = np.cumsum([len(c.encode()) for c in some])
            reached = np.cumsum(self.lengths[found & ~START])
            cuts = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[cuts - 1], ends):
                raise ValueError("the tokenizer does not break words at white space")
            data, last = found.tobytes(), 0
            for c, cut in zip(some, (cuts * 4).tolist(), strict=True):
                self.cells[c] = data[last:cut]
                last = cut
        for c in cells:
            if c not in self.cells:
                self.cells[c] = self._encoded(c).tobytes()

    def marked(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with START on the first of each word.

        Cells of a text lie between places where every word split falls, so a
        text's ids are its cells' ids in a row; a short cell goes to the library
        once and is remembered.
        """
        if len(self.cells) > MEMORY:
            self.cells = {}
        known = self.cells
        plain = [not _ODD.search(t) and not (self.marks and self.marks.search(t)) for t in texts]
        parts = [_CELL.findall(t) if p else [t] for t, p in zip(texts, plain, strict=True)]
        new = {c for c in set().union(*parts) if c not in known}
        self._learn([c for c in new if len(c) <= LONG_CELL])
        once = {c: self._encoded(c).tobytes() for c in new if len(c) > LONG_CELL}
        out = []
        for p in parts:
            packed = b"".join([known.get(c) or once[c] for c in p] if once else map(known.__getitem__, p))
            out.append(np.frombuffer(packed, dtype=np.int32))
        return out

    def node(self, data: bytes, lo: int) -> Node:
        """Encoding of a part that starts at ``lo`` of its text."""
        return self.known(self.marked([data.decode()])[0], lo)

    def known(self, marked: np.ndarray, lo: int) -> Node:
        ids, starts = marked & ~START, (marked & START) != 0
        ends = lo + np.cumsum(self.lengths[ids])
        return Node(lo, int(ends[-1]) if len(ends) else lo, ids, ends, starts)

    def segments(self, text: str) -> list[str]:
        """The text cut at added tokens, which stand alone."""
        return [s for s in (self.marks.split(text) if self.marks else [text]) if s]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes in a row; ids outside the vocabulary say nothing."""
        inside = (ids >= 0) & (ids < len(self.bytes))
        return b"".join(self.bytes[ids if inside.all() else ids[inside]].tolist()).decode("utf-8", "replace")


def byte_alphabet() -> dict[str, int]:
    """Character of byte-level vocabularies -> byte.  Printable bytes of Latin-1 are
    themselves, the others follow from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_bpes: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The worker's own tokenizer of a file; it outlives the task."""
    if path not in _bpes:
        _bpes[path] = Bpe(path)
    return _bpes[path]


def halves(text: str, leaf: int) -> list[str]:
    """Leaves of the tree of halves, from left to right."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def _kind(data: bytes, at: int) -> str | None:
    """Class of the characters of the word that starts at ``at``; none for a
    contraction, whose end does not follow from a class."""
    head = data[at : at + MARGIN].decode("utf-8", "ignore")[:3]
    if head[:1] == "'" and head[1:2].isalpha():
        return None
    c = head[1] if head[:1] == " " and len(head) > 1 and not head[1].isspace() else head[:1]
    return "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isnumeric() else "other"


def _in_run(data: bytes, a: Node, i: int, b: Node, j: int) -> bool:
    """Whether token i of a and token j of b are one token inside a run of one
    class that goes on behind it in both."""
    if a.ids[i] != b.ids[j]:
        return False
    kinds = []
    for node, k in ((a, i), (b, j)):
        first = int(np.flatnonzero(node.starts[: k + 1])[-1])
        at = int(node.ends[first - 1]) if first else node.lo
        later = np.flatnonzero(node.starts[k + 1 :])
        end = int(node.ends[k + later[0]]) if len(later) else node.hi
        kinds.append((_kind(data, at), end > node.ends[k] or node is a and end == node.hi))
    return kinds[0][0] is not None and kinds[0][0] == kinds[1][0] and kinds[0][1] and kinds[1][1]


def _meet(data: bytes, a: Node, b: Node, lo: int) -> tuple[int, int] | None:
    """How many tokens of a, and of b, stand before the place from which on b's tokens
    may follow a's: a word start of both behind ``lo``, or behind a token of both."""
    one, two = a.begins, b.begins
    for j in range(int(np.searchsorted(two, lo)), len(two)):
        i = int(np.searchsorted(one, two[j]))
        if i == len(one):
            return None
        if one[i] != two[j]:
            continue
        if a.starts[i] and b.starts[j] and one[i] <= a.hi - MARGIN:
            return i, j
        first = np.flatnonzero(a.starts[: i + 1])[-1]
        if one[first] <= a.hi - MARGIN and _in_run(data, a, i, b, j):
            return i + 1, j + 1
    return None


def _boundary(data: bytes, at: np.ndarray, wanted: int, up: bool) -> int:
    """The nearest of the offsets at or beyond ``wanted`` that no character spans."""
    k = int(np.searchsorted(at, wanted, "left" if up else "right")) - (0 if up else 1)
    while at[k] < len(data) and data[at[k]] & 0xC0 == 0x80:  # the outermost offset is a boundary
        k += 1 if up else -1
    return int(at[k])


def join(coder: Bpe, data: bytes, left: Node, right: Node) -> Node:
    """The encoding of data[left.lo:right.hi] from those of its two parts."""
    size = WINDOW
    while True:
        lo = _boundary(data, left.begins, max(left.lo, left.hi - size), False)
        hi = _boundary(data, right.ends, min(right.hi, right.lo + size), True)
        window = coder.node(data[lo:hi], lo)
        a = (0, 0) if lo == left.lo else _meet(data, left, window, lo)
        b = (len(window.ids), len(right.ids)) if hi == right.hi else _meet(data, window, right, right.lo)
        if a and b and a[1] <= b[0]:
            parts = ((left, 0, a[0]), (window, a[1], b[0]), (right, b[1], len(right.ids)))
            cut = [(n.ids[i:j], n.ends[i:j], n.starts[i:j]) for n, i, j in parts]
            return Node(left.lo, right.hi, *(np.concatenate(c) for c in zip(*cut, strict=True)))
        size *= 2


def concatenate(coder: Bpe, data: bytes, nodes: list[Node]) -> Node:
    """One node of neighbouring ones, joined pair by pair, level by level."""
    while len(nodes) > 1:
        pairs = [join(coder, data, *nodes[i : i + 2]) for i in range(0, len(nodes) - 1, 2)]
        nodes = pairs + nodes[2 * len(pairs) :]
    return nodes[0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def _short(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Texts that need no tree: doc_id, ids."""

    def run(batches):
        coder = bpe(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [m & ~START for m in coder.marked([t.decode("utf-8", "replace") for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _lists(ids)], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def _long(docs: DataFrame, tokenizer: str, leaf: int) -> DataFrame:
    """Texts as trees: doc_id, ids.

    Leaves are grouped by their whole content, so a row repeated many times is
    one tree with a number of copies, counted before the shuffle that also deals
    the leaves of a text to many tasks.  The joins of one text are one group, of
    the size of the text and its tokens.
    """

    def cut(batches):
        coder = bpe(tokenizer)
        rows, size = [], 0
        for doc_id, text, tree in rows_of(batches, "doc_id", "text", "tree"):
            found = coder.segments(text.decode("utf-8", "replace"))
            for segment, s in enumerate(found):
                for k, piece in enumerate([s] if coder.marks and coder.marks.fullmatch(s) else halves(s, leaf)):
                    rows.append((tree, doc_id, segment, k, piece))
                    size += len(piece) + 64
            if size >= BATCH:
                yield _batch(rows, pieces)
                rows, size = [], 0
        if rows:
            yield _batch(rows, pieces)

    def encode(batches):
        coder = bpe(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                marked = coder.marked(part.column("piece").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(marked)], names=[*part.schema.names, "marked"])

    def grow(table: pa.Table) -> pa.Table:
        coder = bpe(tokenizer)
        table = table.sort_by([("segment", "ascending"), ("leaf", "ascending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("segment", "piece")), strict=True))
        marked = [x.values.to_numpy() for x in table.column("marked")]
        out, at = [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            data, nodes, lo = "".join(r[1] for r in rows[at:end]).encode(), [], 0
            for m in marked[at:end]:
                nodes.append(coder.known(m, lo))
                lo = nodes[-1].hi
            out.append(concatenate(coder, data, nodes).ids)
            at = end
        first = table.slice(0, 1)
        return pa.Table.from_arrays(
            [first.column("doc_id"), first.column("copies"), pa.chunked_array([_lists([np.concatenate(out)])])], names=["doc_id", "copies", "ids"]
        )

    pieces = pa.schema([("tree", pa.string()), ("doc_id", pa.int64()), ("segment", pa.int32()), ("leaf", pa.int32()), ("piece", pa.string())])
    leaves = docs.withColumn("tree", F.sha2("text", 256)).mapInArrow(cut, "tree string, doc_id long, segment int, leaf int, piece string")
    leaves = leaves.groupBy("tree", "doc_id", "segment", "leaf", "piece").agg(F.count(F.lit(1)).alias("copies"))
    schema = "tree string, doc_id long, segment int, leaf int, piece string, copies long, marked array<int>"
    grown = leaves.mapInArrow(encode, schema).groupBy("tree", "doc_id").applyInArrow(grow, "doc_id long, copies long, ids array<int>")
    return grown.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema)], schema=schema)


def encode(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, ids.

    The ids are those of the library for the whole text without special tokens
    added; strings of added tokens inside a text become their ids, as there.
    ``tokenizer`` is the path of a byte-level vocabulary file on every executor.
    A null text is empty and gives no ids; repeated rows and null ids are rows
    like any other; other columns are not read; an empty table gives an empty
    result.  Texts of more than two leaves (``leaf`` code points each) are
    encoded as trees.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tall = F.length("text") > 2 * leaf
    cast = F.col("text").cast("binary").alias("text")
    return _short(rows.filter(~tall).select("doc_id", cast), tokenizer).unionByName(
        _long(rows.filter(tall).select("doc_id", cast), tokenizer, leaf)
    )


def decode(frame: DataFrame, tokenizer: str) -> DataFrame:
    """The rows (doc_id, ids) with ``text``, special tokens included.

    Null ids, a null list and numbers outside the vocabulary say nothing; bytes
    that are no UTF-8 become replacement characters.
    """

    def run(batches):
        coder = bpe(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                lists = part.column("ids")
                if lists.null_count:
                    lists = lists.fill_null([])
                flat, at_of = pc.fill_null(lists.flatten(), -1).to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
                texts = [coder.decode(flat[a:b]) for a, b in zip(at_of, at_of[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return frame.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
