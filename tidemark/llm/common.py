"""Shared pieces: label folds, stored frames and files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_prefix(columns: list[str]) -> str:
    """A beginning for helper columns that no column of a frame has."""
    prefix = "own_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is created yet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Frames written to the shared folder and read back, dropped by their owner.

    A written frame survives lost executors, cuts the lineage and gives every
    reader the same rows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_folder(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, upto: int | None = None) -> None:
        """Delete the frames put so far, or only those numbered up to ``upto``."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in [self.root] if upto is None else [f"{self.root}/{i}" for i in range(1, upto + 1)]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a URI; a bare path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Output:
    """A file that appears under its name only once it is whole.

    A retried task writes its own temporary file and replaces the same name, so
    lost executors and repeated attempts leave one good file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.temp, self.at = f"{self.path}.{uuid.uuid4().hex}.tmp", 0
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.temp, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def commit(self) -> None:
        self.stream.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.temp, self.path)


#: Tokenizers of this worker that remember words from task to task.
REMEMBERING: list = []


def release() -> None:
    """Empty the worker's memories of words; the next operator needs the room."""
    for coder in REMEMBERING:
        coder.forget()


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples of the named columns."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


class Emitter:
    """Collects rows and hands them out as Arrow batches of a bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 4_000_000):
        self.schema, self.limit = schema, limit
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 64) -> bool:
        """Append a row; true once the batch should be handed out."""
        self.rows.append(row)
        self.size += size
        return self.size >= self.limit

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema)], schema=self.schema)
