"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, saved, table

_LIMIT = 10**9  # numpy draws from populations below this


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` from good + bad are good; beyond numpy's limit by inversion outward from the mode."""
    if good + bad < _LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    at = exp(_log_choose(good, mode) + _log_choose(bad, drawn - mode) - _log_choose(good + bad, drawn))
    u, down, up, p_down, p_up = rng.random() - at, mode, mode, at, at
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            if (u := u - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            if (u := u - p_down) <= 0:
                return down
        if p_up == 0 and p_down == 0:
            break
    return mode


def communication_matrix(row_sizes: list[int], column_sizes: list[int], seed: int) -> np.ndarray:
    """Counts, row by column, of a uniform permutation that deals rows of row_sizes into columns of column_sizes."""
    rng, left = np.random.default_rng(seed), [int(x) for x in column_sizes]
    out = np.zeros((len(row_sizes), len(left)), np.int64)
    for i, need in enumerate(int(x) for x in row_sizes):
        rest = sum(left)
        for j, have in enumerate(left):
            if not need:
                break
            rest -= have
            out[i, j] = x = hypergeometric(rng, have, rest, need)
            left[j], need = have - x, need - x
    return out


def shuffled_shards(df: DataFrame, n_shards: int, seed: int = 17, rows_per_part: int = 20_000, max_parts: int = 4096, rows_per_run: int = 50_000) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard), uniformly permuted.

    Shard sizes are exact: they differ by one at most. Rows fall into logical partitions by a hash of all their columns,
    not by where they happen to lie, so that a rerun task deals them the same way. The driver draws the exact
    partition-to-shard counts; each partition is permuted by a second hash and cut at those counts; rows are exchanged;
    each shard is permuted again by a third hash, in runs of about rows_per_run rows whose offsets are prefix sums, so no
    task holds a whole shard.

    Memory: the matrix has at most max_parts x n_shards counts, which is also the bound of what is broadcast.
    Nulls hash like values. Rows equal in all columns are interchangeable and each keeps its own slot; ties of a hash are
    broken by the columns. An empty df gives an empty result. Columns named shard or slot are kept under a
    name with an underscore before it. Columns that cannot be ordered (maps) are not supported.
    """
    for name in ("shard", "slot"):
        if name in (c.lower() for c in df.columns):
            df = df.withColumnRenamed(name, fresh(df.columns, f"_{name}"))
    cols = df.columns
    part, cum, rank, deal, mixed, run = (fresh(cols, x) for x in ("__part", "__cum", "__rank", "__deal", "__mixed", "__run"))
    spark, n = df.sparkSession, df.count()
    parts = max(1, min(max_parts, -(-n // rows_per_part)))
    key = [F.xxhash64(F.lit(seed + i), *[F.col(f"`{c}`") for c in cols]) for i in range(3)]
    dealt = df.withColumns({part: F.pmod(key[0], F.lit(parts)).cast("int"), deal: key[1], mixed: key[2]})
    sizes = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    row_sizes = [sizes.get(p, 0) for p in range(parts)]
    total = sum(row_sizes)
    matrix = communication_matrix(row_sizes, [total // n_shards + (s < total % n_shards) for s in range(n_shards)], seed)
    bounds = spark.createDataFrame([(p, [int(x) for x in np.cumsum(matrix[p])]) for p in range(parts)], f"`{part}` int, `{cum}` array<bigint>")
    tie = [F.col(f"`{c}`") for c in cols]
    local = W.partitionBy(part).orderBy(deal, *tie)
    sent = dealt.withColumn(rank, F.row_number().over(local) - 1).join(F.broadcast(bounds), part)
    sent = sent.withColumn("shard", F.expr(f"size(filter(`{cum}`, c -> c <= `{rank}`))")).drop(cum, rank, deal, part)
    runs = max(1, -(-total // (n_shards * rows_per_run)))
    sent = sent.withColumn(run, (F.shiftrightunsigned(mixed, 33) * runs / F.lit(1 << 31)).cast("int"))
    before = fresh(cols, "__before")
    starts = sent.groupBy("shard", run).agg(F.count(F.lit(1)).alias(before))
    starts = starts.withColumn(before, F.sum(before).over(W.partitionBy("shard").orderBy(run)) - F.col(before))
    again = W.partitionBy("shard", run).orderBy(mixed, *tie)
    out = sent.withColumn("slot", F.row_number().over(again).cast("long") - 1).join(starts, ["shard", run])
    return out.select(*tie, "shard", (F.col("slot") + F.col(before)).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most (law `rows`).

    Groups of equal texts (told by text_crc32) are dealt row by row: the method is a uniform shuffle with exact shard sizes, under which a group
    larger than a shard must be parted, and smaller ones lie in one shard by chance only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled_shards(saved(slim), 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
