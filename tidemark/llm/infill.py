"""Fill-in-the-middle documents by block rotation in one buffer.

A text is cut into prefix, middle and suffix.  Its bytes go into a bytearray, the
marks are inserted before the three segments, and two neighbouring blocks change
places by three reversals: with A B reversed one by one and then as a whole, the
buffer holds B A.  No second copy of the text is made; a reversal swaps blocks of
bounded size from both ends.

    <P>prefix <M>middle <S>suffix
    psm: the last two blocks change places      <P>prefix <S>suffix <M>middle
    spm: the first two and the last one do      <S>suffix <P>prefix <M>middle

The marks neither begin nor end with a part of one another, and a text that holds
one stays plain, so the first mark of each kind is the inserted one: restoring
finds them, rotates back and deletes them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Emitter, rows_of

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that a reversal swaps at a time.
SWAP = 1 << 16

_IS_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverse view[a:b] in place, some bytes from both ends at a time."""
    while b - a > 1:
        k = min(SWAP, (b - a) // 2)
        left = view[a : a + k][::-1].copy()
        view[a : a + k] = view[b - k : b][::-1]
        view[b - k : b] = left
        a, b = a + k, b - k


def rotate(buffer: bytearray, a: int, cut: int, b: int) -> None:
    """Exchange the neighbouring blocks buffer[a:cut] and buffer[cut:b]."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    reverse(view, a, cut)
    reverse(view, cut, b)
    reverse(view, a, b)


def token_ends(text: bytes) -> np.ndarray:
    """Byte offsets where tokens end: a word with the white space before it is a
    token, white space at the end of the text is one."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    space = _IS_SPACE[np.frombuffer(text, dtype=np.uint8)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(text)) if space[-1] else ends


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def transform(text: bytes, prefix: int, middle: int, form: str) -> bytes:
    """Put text[:prefix], text[prefix:middle] and text[middle:] in the form's order."""
    buffer = bytearray(text)
    for at, mark in ((middle, SUFFIX), (prefix, MIDDLE), (0, PREFIX)):  # from behind, offsets stay right
        buffer[at:at] = mark
    first = prefix + len(PREFIX)
    second = middle + len(PREFIX) + len(MIDDLE)
    rotate(buffer, first if form == "psm" else 0, second, len(buffer))
    return bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    # Marks are searched in the order in which they stand.
    at = 0
    where = {}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        where[mark] = at = buffer.index(mark, at)
    # The block of the suffix moves back to the end.
    a = where[SUFFIX]
    cut = where[MIDDLE] if form == "psm" else where[PREFIX]
    size = cut - a
    rotate(buffer, a, cut, len(buffer))
    prefix, middle, suffix = 0, where[MIDDLE] - size, len(buffer) - size
    for at in (suffix, middle, prefix):
        del buffer[at : at + 3]
    return bytes(buffer)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the seed and the id; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) in its form.

    Returns doc_id, n (tokens), form (plain, psm or spm), prefix_chars,
    middle_chars (code points, null if plain) and output.  ``rate`` per cent of the
    documents are changed, ``spm`` per cent of those with the suffix first; both
    and the cuts come from ``seed`` and doc_id alone, so reruns and rows with equal
    ids agree.  A null text is empty; an empty text and one that holds a mark stay
    plain.  Cuts fall behind tokens, never inside a character.  Other columns are
    not read.  An empty table gives an empty result.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        give = Emitter(schema)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            h1, h2, h3, h4 = draws(doc_id, seed)
            ends = token_ends(text)
            n = len(ends)
            row = (doc_id, n, "plain", None, None, text)
            if text and h3 % 100 < rate and not any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                one, two = (0 if c == 0 else int(ends[c - 1]) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
                form = "spm" if h4 % 100 < spm else "psm"
                row = (doc_id, n, form, code_points(text[:one]), code_points(text[one:two]), transform(text, one, two, form))
            if give.add(row, len(text) + 64):
                yield give.take()
        if give.rows:
            yield give.take()

    bytes_of = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    out = bytes_of.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(frame: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``, rebuilt from output and form only."""
    columns = frame.columns

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [restore(o, f) for o, f in rows_of([part], "output", "form")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*columns, "restored"])

    given = frame.withColumn("output", F.col("output").cast("binary"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    out = given.mapInArrow(run, f"{fields}, restored binary")
    return out.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})
