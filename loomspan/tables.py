"""Tables in the folder that driver and executors share, and the mixing of 64-bit words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of our own only in local mode."""
    folder = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="loomspan-")
    spark.conf.set(_CHECKPOINT_DIR, folder)
    return folder


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Lowers the session's bytes in an Arrow batch, so that a Python worker holds few long texts at a time."""
    now = spark.conf.get(ARROW_BATCH).lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    size = int(now.rstrip("kmg") or 0) << scale
    if not 0 < size <= limit:
        spark.conf.set(ARROW_BATCH, str(limit))


#: Set while a table is written: the shuffle files below it go as soon as it stands, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder; each one cuts lineage and survives lost executors.

    `keep` writes a DataFrame and reads it back, by the session's codec or a given one. `drop` deletes tables that no later step reads;
    tables below a returned DataFrame stay, as that one is evaluated by the caller.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.base, self.paths, self.written = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}, 0

    def keep(self, df: DataFrame, table: str, codec: str | None = None) -> DataFrame:
        self.written += 1
        path = self.paths[table] = f"{self.base}/{self.written}-{table}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.options(**({"compression": codec} if codec else {})).parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *tables: str) -> None:
        self.drop(*(table for table in self.paths if table not in tables))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
