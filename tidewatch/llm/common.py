"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold BATCH_BYTES at most (or what it has set, if less; a longer row is a batch of its own), so that
    the memory of a task does not grow with the length of 10,000 rows' texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets one; a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file:///tmp/tidewatch-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def saved(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends here and outlives executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tidewatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `saved` wrote and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what is made of long texts is let go of piece by piece."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def narrowed(df: DataFrame, keys: DataFrame, on: Column, bound: int = 500_000, how: str = "left_semi") -> DataFrame:
    """df joined (semi or anti) with keys where these are bound rows at most and so may be broadcast; otherwise a shuffle
    does it, as it would anyway."""
    return df.join(F.broadcast(keys) if keys.count() <= bound else keys.hint("merge"), on, how)


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """As many partitions as keep per_part rows each, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def held_out(folds: int, fold: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo folds, is fold; rows without a key are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; bijective."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SliceHash:
    """64-bit hashes of slices of a sequence, from prefix sums of a polynomial modulo 2**64.

    One pass over the sequence, then a few operations a slice; the same slice has the same hash wherever it stands.
    """

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            for name, base in (("up", self.BASE), ("down", self.INVERSE)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * np.uint64(pow(base, m, 1 << 64))]))

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        self._grow(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * self.up[: len(codes)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fresh(columns: Iterable[str], name: str) -> str:
    """name, with underscores before it as long as a column is called so (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
