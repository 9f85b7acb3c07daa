"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader.

Some archives are one gzip stream around all records, which nobody can seek in.
The normaliser inflates such a stream once, rewrites every record as a gzip
member of its own and writes a sidecar index of the members' offsets, so that a
reader inflates only the records it wants.  Every file is one task's work, holds
one chunk or one record in memory at a time, and appears under its name only
when it is whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Emitter, Output, file_system, new_folder, rows_of, shuffle_partitions

#: Bytes read from a compressed file at a time.
CHUNK = 1 << 20
#: A fixed date keeps reruns byte-equal.
DATE = "2020-01-01T00:00:00Z"
RECORD_ID = "<urn:page:{}>"
GZIP = 16 + zlib.MAX_WBITS


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str | None) -> str:
    """A value on one line: control characters become percent codes."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block but the full payload's size and digest."""
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {RECORD_ID.format(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    return fields, rest[:size]


def inflate(stream) -> Iterator[bytes]:
    """Plain bytes of a gzip file of any number of members, chunk by chunk."""
    d, pending = zlib.decompressobj(GZIP), stream.read(CHUNK)
    while pending or not d.eof:
        out = d.decompress(pending, CHUNK)
        if out:
            yield out
        pending = d.unconsumed_tail
        if d.eof:
            pending = d.unused_data or stream.read(CHUNK)
            if not pending:
                return
            d = zlib.decompressobj(GZIP)
        elif not pending and len(out) < CHUNK:
            pending = stream.read(CHUNK)
            if not pending:
                raise ValueError("the gzip stream ends early")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of bytes into whole records by their Content-Length."""
    buffer = bytearray()
    for chunk in chunks:
        buffer += chunk
        while True:
            at = buffer.find(b"\r\n\r\n")
            if at < 0:
                break
            m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", buffer[:at])
            if not m:
                raise ValueError("a record without Content-Length")
            end = at + 4 + int(m[1]) + 4
            if len(buffer) < end:
                # Take what the record still lacks before looking again.
                missing = end - len(buffer)
                more = io.BytesIO()
                while missing > 0:
                    part = next(chunks, b"")
                    if not part:
                        raise ValueError("the last record is cut off")
                    more.write(part)
                    missing -= len(part)
                buffer += more.getvalue()
            yield bytes(buffer[:end])
            del buffer[:end]
    if buffer:
        raise ValueError("the last record is cut off")


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the smallest page_id of
    equal payloads, for every other page whose payload has ``min_bytes`` or more.

    Groups are counted by digest and length, combined before the shuffle; only
    ids and digests meet, so one page that a third of all rows copy stays cheap.
    A null html is empty; rows that repeat a page_id are copies of one page, and
    each refers to the first page of its payload only if the id differs.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    key = p.filter(F.octet_length("html") >= min_bytes).select("page_id", F.sha2("html", 256).alias("k"))
    firsts = key.groupBy("k").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = (
        key.join(firsts.select("k", "first"), "k")
        .filter(F.col("page_id") != F.col("first"))
        .groupBy("page_id")
        .agg(F.min_by("first", "k").alias("refers_to"), F.collect_set("k").alias("ks"))
        .select(F.col("page_id").alias("copy_id"), "refers_to", "ks")
    )
    # Always by shuffle, so that the pages come out dealt by page_id for the writer.
    j = p.join(copies.hint("merge"), F.col("page_id") == F.col("copy_id"), "left")
    # A repeated page_id with another payload is not a copy.
    same = F.array_contains("ks", F.sha2("html", 256))
    return j.select("page_id", "url", "html", F.when(same, F.col("refers_to")).alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html, refers_to) as whole-file gzip archives.

    One file per partition of ``pages``, in order of page_id; returns one row per
    file.
    """

    def write(batches):
        out = z = None
        count = 0
        for page_id, url, html, refers_to in rows_of(batches, "page_id", "url", "html", "refers_to"):
            if out is None:
                out = Output(f"{folder}/mono/part-{TaskContext.get().partitionId():06d}.warc.gz")
                z = zlib.compressobj(1, zlib.DEFLATED, GZIP)
            data = record(page_id, url, (html or "").encode(), refers_to)
            out.write(z.compress(data))
            count += 1
        if out is not None:
            out.write(z.flush())
            out.commit()
            path = f"{folder}/mono/part-{TaskContext.get().partitionId():06d}.warc.gz"
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return pages.sortWithinPartitions("page_id").mapInArrow(write, "path string, records long")


def normalise(files: DataFrame) -> DataFrame:
    """Rewrite each file (column path) with one gzip member per record.

    Next to ``NAME.warc.gz`` in folder mono come ``members/NAME.warc.gz`` and the
    sidecar ``members/NAME.index``: one JSON line per record with its offset,
    length, type and id.  Returns path, index, records per file.
    """

    def rewrite(batches):
        for (path,) in rows_of(batches, "path"):
            fs, p = file_system(path)
            target = path.replace("/mono/", "/members/")
            out, index, n = Output(target), Output(target.removesuffix(".warc.gz") + ".index"), 0
            with fs.open_input_stream(p, compression=None) as stream:
                for data in split_records(inflate(stream)):
                    fields, _ = parse(data)
                    z = zlib.compressobj(4, zlib.DEFLATED, GZIP)
                    member = z.compress(data) + z.flush()
                    line = {"at": out.at, "size": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"]}
                    index.write(json.dumps(line).encode() + b"\n")
                    out.write(member)
                    n += 1
            out.commit()
            index.commit()
            row = {"path": [target], "index": [target.removesuffix(".warc.gz") + ".index"], "records": [n]}
            yield pa.RecordBatch.from_pydict(row)

    return files.mapInArrow(rewrite, "path string, index string, records long")


def read_member(stream, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """Seek to one member and inflate only that."""
    stream.seek(at)
    return parse(zlib.decompress(stream.read(size), GZIP))


def id_of(value: str) -> int | None:
    digits = value.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(files: DataFrame) -> DataFrame:
    """Records of normalised files (path, index): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, html (null for a revisit).

    A response's size and digest are taken from its block and must agree with
    its headers; a revisit's are those its headers state.
    """
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("html", pa.string()),
        ]
    )

    def read(batches):
        give = Emitter(schema)
        for path, index in rows_of(batches, "path", "index"):
            fs, p = file_system(path)
            with fs.open_input_stream(file_system(index)[1], compression=None) as lines, fs.open_input_file(p) as stream:
                for line in io.BufferedReader(_Raw(lines)):
                    at = json.loads(line)
                    fields, block = read_member(stream, at["at"], at["size"])
                    kind = fields["warc-type"]
                    stated = (int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"))
                    if kind == "response" and stated != (len(block), digest(block)):
                        raise ValueError(f"record {fields['warc-record-id']} is damaged")
                    row = (
                        id_of(fields["warc-record-id"]),
                        fields.get("warc-target-uri"),
                        *stated,
                        kind,
                        id_of(fields["warc-refers-to"]) if kind == "revisit" else None,
                        block.decode() if kind == "response" else None,
                    )
                    if give.add(row, 200 + len(block)):
                        yield give.take()
        if give.rows:
            yield give.take()

    return files.mapInArrow(
        read,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string",
    )


class _Raw(io.RawIOBase):
    """An Arrow input stream as a raw Python stream."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.stream.read(len(b))
        b[: len(data)] = data
        return len(data)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and list the archives of ``pages``: one row per file.

    An empty table gives no file.  The small list of files is written to the
    shared folder, so each step reads what the last one really left there.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    n = shuffle_partitions(spark)
    write_monolithic(with_references(pages, min_bytes), folder).write.parquet(f"{folder}/list-mono")
    mono = spark.read.parquet(f"{folder}/list-mono").repartition(n, "path")
    normalise(mono).write.parquet(f"{folder}/list-members")
    return spark.read.parquet(f"{folder}/list-members").repartition(n, "path")
