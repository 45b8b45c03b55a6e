"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(name: str = "flowtally", cpus: str = "8", shuffle_partitions: int = 8,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.config(map=conf or {}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only where none is named.

    Every executor must be able to read what is written here, so a machine-local folder
    is accepted in local mode alone.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowtally-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), f"{stem}-{uuid.uuid4().hex}")


def settled(df: DataFrame, stem: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later jobs do not
    recompute it and a lost executor costs a re-read only."""
    path = fresh_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand rows to Python in batches of so many rows, whatever their bytes: for narrow rows, where looking
    at the bytes after each row takes longer than the rows do."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.set(key, before)
