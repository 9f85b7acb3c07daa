"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tidemark") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints and stored frames.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    session without one gets a temporary folder, which goes when Python ends; on
    a cluster every executor would write to its own disk, so there it is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured or current:
        if not current:
            sc.setCheckpointDir(configured)
        return configured or current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    target = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    atexit.register(shutil.rmtree, target, ignore_errors=True)
    sc.setCheckpointDir(target)
    return target


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back.

    Cuts the lineage, survives lost executors, and gives several readers the
    same bytes: figures that come from floating-point sums may differ in the
    last digit when a plan computes them twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
