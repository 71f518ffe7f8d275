"""What the training-data operators share: reading tables, cutting lineage, worker imports, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import secrets
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def workers_import(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Let Python workers import this package from where the driver found it, and get rows in batches of modest size (in rows and bytes)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='barloom-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def lean(run):
    """A function of Arrow batches that gives memory back when its partition is done: workers live on for other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def secret_key(spark: SparkSession) -> str:
    """The key of pseudonyms: spark.barloom.pii.key, or one drawn for this session where it is unset (pseudonyms then can't be made again later)."""
    found = spark.conf.get("spark.barloom.pii.key", None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set("spark.barloom.pii.key", found)
    return found


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    # Shuffle files of what is no longer referred to go when the driver collects its garbage.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def own_prefix(columns: list[str]) -> str:
    """A beginning of names that no column has."""
    out = "__"
    while any(c.startswith(out) for c in columns):
        out += "_"
    return out


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing needs any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


class WordCache:
    """What a worker knows of words, bounded by an estimate of its bytes: words of this generation and of the one before.

    A generation ends when it has half of the bytes; words that are met again pass from the old to the new one, others go with the old.
    """

    def __init__(self, limit: int = 128 << 20):
        self.limit, self.size = limit, 0
        self.now: dict = {}
        self.old: dict = {}

    def begin(self) -> None:
        """Before each chunk: what `missing` finds or `now` gets after that stays until the next."""
        if self.size > self.limit // 2:
            self.old, self.now, self.size = self.now, {}, 0

    def missing(self, words: set, cost) -> set:
        """Those of the words that aren't known; the others are in `now`."""
        new = words.difference(self.now)
        if self.old:
            again = [w for w in new if w in self.old]
            self.now.update(zip(again, map(self.old.__getitem__, again), strict=True))
            self.size += sum(map(cost, again))
            new.difference_update(again)
        self.size += sum(map(cost, new))
        return new


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on an array of uint64 (a copy)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
