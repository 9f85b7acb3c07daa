"""Token ids in seekable binary files.

A file is a run of independent Zstandard frames and, at its end, a seek table:

    frame 0 | frame 1 | ... | index (skippable frame) | seek table (skippable frame)

The seek table is the public seekable format: per frame its compressed size, its
plain size and the low 32 bits of the XXH64 of its plain bytes, then the number
of frames, a descriptor byte and the magic number.  The index frame holds each
frame's first document id and documents, so a reader finds and inflates only the
frames that hold the documents it wants.

A frame's plain bytes: number of documents (u32), their ids (i64 each), a bit for
each null id (u8 each), their numbers of tokens (u32 each), all token ids (u32
each), little-endian.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import REMEMBERING, Emitter, Output, file_system, new_folder, rows_of, shuffle_partitions

#: Fixed values of the seekable format.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: Plain bytes after which a frame is closed.
FRAME_BYTES = 1 << 20
#: Distinct words remembered by a worker; then it starts afresh.
MEMORY = 1_000_000
#: The same where memory is scarce: a full memory is kept as the older one.
LEAN = 250_000

# Words of these characters only fall apart in the same places for any tokenizer
# pattern of letter runs, single digits and runs of other signs; an apostrophe or
# a special token's "<" could join them, and a mark could compose.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")


def unknown(wanted: set, younger: dict, older: dict) -> list:
    """What neither memory holds; what the older one holds moves to the younger."""
    new = []
    for w in wanted:
        if w not in younger:
            if (ids := older.pop(w, None)) is None:
                new.append(w)
            else:
                younger[w] = ids
    return new


class Encoder:
    """The tokenizer behind a memory of words.

    White space always separates tokens, so a text's ids are its words' ids in a
    row; a word is encoded by the library once and remembered as packed ids.  A
    ``lean`` encoder forgets sooner and in two steps: words of the older memory move
    to the younger when they come again, so common ones stay and rare ones go.
    """

    def __init__(self, path: str, lean: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit, self.lean = (LEAN if lean else MEMORY), lean
        self.forget()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

        REMEMBERING.append(self)

    def forget(self) -> None:
        self.words: dict[bytes, bytes] = {}  # by UTF-8 bytes
        self.pieces: dict[str, bytes] = {}
        self.older_words, self.older_pieces = {}, {}

    def age(self) -> None:
        """A full memory goes, or becomes the older one."""
        if len(self.words) > self.limit:
            self.words, self.older_words = {}, self.words if self.lean else {}
        if len(self.pieces) > self.limit:
            self.pieces, self.older_pieces = {}, self.pieces if self.lean else {}

    def raw(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Encode words that are not yet known, many in one call."""
        texts = {w: w.decode() for w in words}
        split = {w: [p.lower() for p in _PIECE.findall(t)] for w, t in texts.items() if _PLAIN.fullmatch(t)}
        new = unknown({p for ps in split.values() for p in ps}, self.pieces, self.older_pieces)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and (not len(cuts) or cuts[-1] == len(ids)):
                data, at = ids.tobytes(), 0
                for p, end in zip(part, (cuts * 4).tolist(), strict=True):
                    self.pieces[p] = data[at:end]
                    at = end
            else:  # some piece is more or less than one pre-token
                for p in part:
                    self.pieces[p] = self.raw(p)
        get = self.pieces.__getitem__
        for w in words:
            self.words[w] = b"".join(map(get, split[w])) if w in split else self.raw(texts[w])

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Packed ids of each text, with the end id."""
        self.age()
        parts = [t.encode().split() for t in texts]  # at ASCII white space only
        self.learn(unknown(set().union(*parts), self.words, self.older_words))
        get, tail = self.words.__getitem__, struct.pack("<I", end_id)
        return [b"".join(map(get, p)) + tail for p in parts]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lean: bool = False) -> Encoder:
    """The worker's own encoder of a vocabulary file; it outlives the task."""
    if (path, lean) not in _encoders:
        _encoders[path, lean] = Encoder(path, lean)
    return _encoders[path, lean]


class FrameWriter:
    """Writes documents into one seekable file."""

    def __init__(self, uri: str):
        self.out, self.z = Output(uri), zstandard.ZstdCompressor(level=1)
        self.docs: list[tuple[int | None, bytes]] = []
        self.size = self.tokens = self.count = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        self.size += len(ids) + 13
        self.tokens += len(ids) // 4
        self.count += 1
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if not self.docs:
            return
        ids = np.array([i or 0 for i, _ in self.docs], dtype="<i8").tobytes()
        nulls = bytes(i is None for i, _ in self.docs)
        sizes = np.array([len(x) // 4 for _, x in self.docs], dtype="<u4").tobytes()
        plain = b"".join([struct.pack("<I", len(self.docs)), ids, nulls, sizes, *(x for _, x in self.docs)])
        packed = self.z.compress(plain)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.index.append((self.docs[0][0] or 0, len(self.docs)))
        self.out.write(packed)
        self.docs, self.size = [], 0

    def close(self) -> None:
        self.close_frame()
        index = b"".join(struct.pack("<qI", *x) for x in self.index)
        index = struct.pack("<II", SKIPPABLE, len(index)) + index
        self.out.write(index)
        # The index is a frame of the table too: it has no plain bytes.
        entries = [*self.frames, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *x) for x in entries)
        body += struct.pack("<IBI", len(entries), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(body)) + body)
        self.out.commit()


class FrameReader:
    """Random access to one seekable file."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.stream = fs.open_input_file(path)
        end = self.stream.size()
        n, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or not descriptor & CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = self._at(end - 9 - 12 * n, 12 * n)
        self.frames, at = [], 0
        for packed, plain, check in struct.iter_unpack("<III", table):
            self.frames.append((at, packed, plain, check))
            at += packed
        where, packed, _, _ = self.frames.pop()
        self.index = list(struct.iter_unpack("<qI", self._at(where + 8, packed - 8)))
        self.z = zstandard.ZstdDecompressor()
        self.inflated = 0

    def _at(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def frame(self, k: int) -> Iterator[tuple[int | None, bytes]]:
        """Documents of frame ``k``; its checksum must hold."""
        at, packed, plain, check = self.frames[k]
        data = self.z.decompress(self._at(at, packed), max_output_size=plain)
        self.inflated += 1
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        n = struct.unpack_from("<I", data)[0]
        ids = np.frombuffer(data, "<i8", n, 4).tolist()
        nulls, sizes = data[4 + 8 * n : 4 + 9 * n], np.frombuffer(data, "<u4", n, 4 + 9 * n).tolist()
        pos = 4 + 13 * n
        for doc_id, null, size in zip(ids, nulls, sizes, strict=True):
            yield None if null else doc_id, data[pos : pos + 4 * size]
            pos += 4 * size

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, bytes]]:
        """Only the wanted documents, from only the frames that can hold them."""
        firsts = [i for i, _ in self.index]
        for k, first in enumerate(firsts):
            last = firsts[k + 1] if k + 1 < len(firsts) else None
            if any(w >= first and (last is None or w <= last) for w in wanted):
                yield from ((i, x) for i, x in self.frame(k) if i in wanted)

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.frames)):
            yield from self.frame(k)


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, lean: bool = False) -> DataFrame:
    """Encode (doc_id, text) into seekable files in ascending doc_id order.

    Returns one row per file: file (its number), path, docs, tokens, start (ids
    in all files before).  Files are ranges of doc_id, nulls first; rows with
    equal ids follow by the hash of their text.  A null text is empty and gives
    the end id alone.  Other columns are not read.  An empty table gives no file.
    ``tokenizer`` is the path of the vocabulary on every executor; ``lean`` encoders
    take less memory and somewhat more time.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    n = shuffle_partitions(spark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def write(batches):
        out, k = None, TaskContext.get().partitionId()
        path = f"{folder}/part-{k:06d}.ids.zst"
        enc = encoder(tokenizer, lean)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out = out or FrameWriter(path)
                packed = enc.encode(part.column("text").to_pylist(), end_id)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), packed, strict=True):
                    out.add(doc_id, ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [k], "path": [path], "docs": [out.count], "tokens": [out.tokens]})

    dealt = base.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.mapInArrow(write, "file long, path string, docs long, tokens long").write.parquet(f"{folder}/list")
    start, rows = 0, []
    for r in spark.read.parquet(f"{folder}/list").orderBy("file").collect():  # one short row per file
        rows.append((r["file"], r["path"], r["docs"], r["tokens"], start))
        start += r["tokens"]
    schema = "file long, path string, docs long, tokens long, start long"
    return spark.createDataFrame(rows, schema).repartition(n, "file")


def read_files(files: DataFrame) -> DataFrame:
    """Documents read back: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        give = Emitter(schema)
        for path, start in rows_of(batches, "path", "start"):
            for doc_id, ids in FrameReader(path):
                n = len(ids) // 4
                full = give.add((doc_id, start, n, zlib.crc32(ids)))
                start += n
                if full:
                    yield give.take()
        if give.rows:
            yield give.take()

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
