"""File sources and sinks: CSV, gzip, directories, JSON, text, materialise-once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpoint_dir


# Three-letter columns that are no team codes.
PLAY_VALUE_COLUMNS = ("EPB", "EPA")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; gzip by extension; NaN text is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "NaN").csv(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def file_stem() -> Column:
    """Name of the row's file without folder and extension."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[a-z]+(?:\.gz)?$", 1)
    return F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))


def folder_value(key: str) -> Column:
    """Value of a ``key=value`` folder in the row's path."""
    return F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), f"/{key}=([^/]+)/", 1))


def read_directory(spark: SparkSession, path: str, schema: T.StructType | str, value: Column, name: str) -> DataFrame:
    """All CSV files below a folder; the file (or folder) name becomes a column."""
    df = (
        spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    )
    return df.select("*", value.alias(name))


def read_mapped(groups: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Union of frames whose columns differ: each comes with ``target -> source`` names."""
    out = None
    for df, mapping in groups:
        part = df.select(*[F.col(src).alias(dst) for dst, src in mapping.items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def normalise_header(columns: Sequence[str]) -> list[str]:
    """Lower-case names; the two three-letter team columns become away and home points."""
    teams = [c for c in columns if re.fullmatch(r"[A-Z]{3}", c) and c not in PLAY_VALUE_COLUMNS]
    if len(teams) != 2:
        raise ValueError(f"expected two team columns, found {teams}")
    renamed = {teams[0]: "away_points", teams[1]: "home_points"}
    return [renamed.get(c, c.lower()) for c in columns]


def read_sheet(spark: SparkSession, path: str, names: Sequence[str], marker: str) -> DataFrame:
    """A sheet exported as CSV with text above its header row.

    The header row is the one whose first cell is ``marker``; rows above it
    are dropped.  A sheet is one small file and is read as one value.
    """
    lines = spark.read.text(path, wholetext=True)
    body = F.regexp_extract(F.col("value"), rf"(?s)(?:^|\n){re.escape(marker)}[^\n]*\n(.*)$", 1)
    rows = lines.select(F.explode(F.split(body, r"\r?\n")).alias("line")).filter("line <> ''")
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(len(names))))
    return rows.select(*[F.trim(cells[f"c{i}"]).alias(n) for i, n in enumerate(names)])


def write_named(df: DataFrame, path: str, by: str) -> None:
    """One CSV file per value of ``by``, named after it (a null value: ``null``; a
    slash or colon in a value becomes a hyphen).

    Each value is written by one task, since it becomes one file; the files get their
    names when all are written.  The list of values comes to the driver, one file name
    each."""
    spark, temp = df.sparkSession, f"{path}/_writing"
    name = F.regexp_replace(F.coalesce(F.col(by).cast("string"), F.lit("null")), "[/:]", "-")
    rows = df.withColumn("_name", name).repartition("_name").drop(by)
    rows.write.partitionBy("_name").option("header", True).csv(temp)
    file_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = file_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(file_path(temp)):
        if folder.isDirectory():
            value = unquote(folder.getPath().getName().split("=", 1)[1])
            for part in fs.globStatus(file_path(f"{folder.getPath()}/part-*")):
                fs.rename(part.getPath(), file_path(f"{path}/{value}.csv"))
    fs.delete(file_path(temp), True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """Read the table at ``path``; build and write it first when it is not there."""
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
