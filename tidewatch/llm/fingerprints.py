"""Lempel-Ziv phrase fingerprints: minimum-hash signatures of the phrases of a parse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SliceHash, table

SIZE = 64
_HASH = SliceHash()


def parse(text: str, start: int, phrases: set[str], ends: list[int]) -> None:
    """Adds the phrases of text[start:] to the dictionary, and where they end: each is the shortest beginning of what is
    left that is no phrase yet. A rest that is a phrase already adds nothing.

    All beginnings of a phrase are phrases, so the length is searched up or down from that of the phrase before.
    """
    n, length, add, note = len(text), 1, phrases.add, ends.append
    while start < n:
        end = start + length
        if end > n:
            end = n
        if text[start:end] in phrases:
            end += 1
            while end <= n and text[start:end] in phrases:
                end += 1
            if end > n:
                return
        else:
            while end - 1 > start and text[start : end - 1] not in phrases:
                end -= 1
        add(text[start:end])
        note(end)
        length = end - start
        start = end


def signature(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The SIZE smallest distinct 32-bit hashes of the phrases that end at ends (all, if fewer)."""
    if not len(ends):
        return np.empty(0, np.uint32)
    starts = np.concatenate([[0], ends[:-1]])
    h = (_HASH.slices(_HASH.prefix(codes), starts, ends) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * SIZE:  # the smallest distinct ones are surely among these
        k = 2 * SIZE
        while True:
            few = np.unique(np.partition(h, k)[:k])
            if len(few) >= SIZE or k * 2 >= len(h):
                break
            k *= 2
        if len(few) >= SIZE:
            return few[:SIZE]
    return np.unique(h)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the smallest SIZE of both; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:SIZE]
    return float(np.isin(both, np.intersect1d(a, b), assume_unique=True).sum() / len(both))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(text: str) -> np.ndarray:
    ends: list[int] = []
    parse(text, 0, set(), ends)
    return signature(codes_of(text), np.array(ends, np.int64))


def edited(text: str, other: str) -> str:
    """text whose last third is replaced by as much of the beginning of other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def both_fingerprints(text: str, changed: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of text and of its edited text; phrases within what they share are parsed once."""
    phrases: set[str] = set()
    ends: list[int] = []
    parse(text[: len(text) - len(text) // 3], 0, phrases, ends)
    out = []
    for whole, known in ((text, set(phrases)), (changed, phrases)):
        more = list(ends)
        parse(whole, ends[-1] if ends else 0, known, more)
        out.append(signature(codes_of(whole), np.array(more, np.int64)))
    return out[0], out[1]


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edit_likeness(df: DataFrame, text: str = "text", key: str = "doc_id", rows_per_run: int = 500, most_runs: int = 1 << 16) -> DataFrame:
    """Each row's key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next row is that of the next smaller key (rows of one key by text), after the last the first; null keys come
    last. Keys are cut at quantiles into runs (most_runs at most; their bounds and heads are all that the driver gets).
    Each run is sorted and read in order by one task, a row at a time, and ends with a copy of the next run's head.
    A null text is an empty one; two empty fingerprints have likeness 1. An empty df gives an empty result.
    """
    docs = df.select(F.col(key).alias("doc"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = docs.count()
    runs = max(1, min(most_runs, n // rows_per_run))
    cuts = docs.select(F.percentile_approx("k", [(i + 1) / runs for i in range(runs - 1)], 20 * runs)).first()[0] if runs > 1 and n else []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def run_of(k):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(-np.searchsorted(bounds, k.to_numpy(), side="left").astype(np.int32))

    docs = docs.withColumn("run", run_of("k"))
    heads = docs.groupBy("run").agg(F.max("k").alias("k")).orderBy("run").collect()
    before = [(heads[i - 1]["run"], r["k"]) for i, r in enumerate(heads)]
    heads = F.broadcast(df.sparkSession.createDataFrame(before, "ends long, head long"))
    guests = docs.join(heads, F.col("k") == F.col("head")).groupBy("ends").agg(F.min("text").alias("text"))
    every = docs.select("run", F.lit(0).alias("guest"), "k", "doc", "text").unionByName(guests.select(F.col("ends").cast("int").alias("run"), F.lit(1).alias("guest"), F.lit(0).cast("long").alias("k"), F.lit(None).cast(df.schema[key].dataType).alias("doc"), "text"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(runs, 4096) // 4)
    ordered = every.repartition(parts, "run").sortWithinPartitions("run", "guest", F.desc("k"), "text")
    schema = f"doc {df.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key and text of the row whose next row is to come
        known: tuple | None = None  # what is known of the row before it, all but near_next
        for b in batches:
            out: list[tuple] = []
            for doc, guest, t in zip(b.column("doc"), b.column("guest").to_pylist(), b.column("text"), strict=True):
                text = t.as_py()
                if last is not None:
                    changed = edited(last[1], text)
                    own, other = both_fingerprints(last[1], changed)
                    if known is not None:
                        out.append((*known[:-1], likeness(known[-1], own)))
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    known = (last[0], len(last[1]), digest, own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(own, other), own)
                last = (doc.as_py(), text)
                if guest:
                    out.append((*known[:-1], likeness(known[-1], fingerprint(text))))
                    last = known = None
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [b.schema.field("doc").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(scan, schema).withColumnRenamed("doc", key)


def op4_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edit_likeness(table(spark, sf_dir, "documents"))
