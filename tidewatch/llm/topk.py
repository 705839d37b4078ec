"""Exact top-k inner products with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts_for, saved, table

BLOCKS = 1 << 14  # about as many annuli at most, whatever the number of vectors


def integer_vectors(df: DataFrame, vec: str = "embedding", key: str = "vec_id", scale: int = 64) -> DataFrame:
    """(vec_id, v): components floor(scale * x). Rows whose key or vector is null, or whose vector holds a null or
    non-finite component, take no part."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class Pivots:
    """Pivots for vectors made longer by one component, so that all have norm sqrt(most): the inner product with a query
    (whose added component is 0) is then (|q|^2 + most - distance^2) / 2."""

    def __init__(self, sample: np.ndarray, most: int, count: int) -> None:
        self.most = float(most)
        lifted = np.unique(self.lift(sample), axis=0)
        chosen, far = [], np.full(len(lifted), np.inf)
        for _ in range(min(count, len(lifted))):
            at = int(far.argmax()) if chosen else 0
            chosen.append(lifted[at])
            far = np.minimum(far, ((lifted - lifted[at]) ** 2).sum(1))
            if far.max() == 0:
                break
        self.at = np.array(chosen).reshape(len(chosen), lifted.shape[1])

    def lift(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.concatenate([v, np.sqrt(np.maximum(0, self.most - (v * v).sum(1)))[:, None]], axis=1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d = (lifted**2).sum(1)[:, None] + (self.at**2).sum(1) - 2 * lifted @ self.at.T
        return np.sqrt(np.maximum(0, d))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with 0."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, vec_ids, scores): the k best rows for each query but those of its own id, ties to smaller ids."""
    order = np.argsort(own, kind="stable")
    own, vectors = own[order], vectors[order]
    big = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) >= 1 << 21
    kind = np.int64 if big else np.float64  # doubles are exact below 2**53
    scores = (queries.astype(kind) @ vectors.astype(kind).T).astype(np.int64)
    lowest = np.iinfo(np.int64).min
    for i, (q, s) in enumerate(zip(ids, scores, strict=True)):
        a, b = np.searchsorted(own, [q, q + 1])
        s[a:b] = lowest
        left = len(s) - (b - a)
        if left <= 0:
            continue
        n = min(k, left)
        edge = np.partition(s, len(s) - n)[len(s) - n]
        at = np.flatnonzero((s >= edge) & (s > lowest))
        at = at[np.lexsort((own[at], -s[at]))][:n]
        yield i, own[at], s[at]


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 64, sample: int = 2048, block: int = 1024, query_block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` of largest inner product for each row of `queries`.

    Both are (vec_id, v array<bigint>); a query's own id is no candidate; ties go to smaller ids; rank begins at 1. Fewer
    than k candidates give fewer rows, none give none. Shorter vectors count as filled with 0. Exact in 64-bit integers.

    Each vector is keyed by its nearest pivot (of a bounded sample) and its distance to it. Sorted by these, vectors are
    cut into annuli of `block` rows, of more where there would be over BLOCKS: a hot pivot, or a vector that a third of
    the rows share, is many annuli. What describes the annuli (three numbers each, so under a megabyte) goes to all tasks.
    First each query searches the annulus nearest to it, which gives its k-th best score so far; then it goes to just those
    annuli whose triangle-inequality bound reaches that score. Queries travel in packets to annuli, annuli stay whole.
    """
    spark = vectors.sparkSession
    index = saved(vectors.select("vec_id", "v"))
    facts = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("most")).first()
    n, most = facts["n"], facts["most"] or 0
    asked = saved(queries.select("vec_id", "v"))
    dim = max(facts["dim"] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    some = index.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").collect()
    rows = np.zeros((len(some), dim), np.int64)
    for i, r in enumerate(some):
        rows[i, : len(r["v"])] = r["v"]
    pivot = Pivots(rows, most, pivots)
    size = max(block, -(-n // BLOCKS))
    margin = 1e-6 * (most + 1)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), dim)
            d = pivot.distances(pivot.lift(v))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), b.column("vec_id"), pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary())], names=["pivot", "d", "vec_id", "v"])

    keyed = saved(index.mapInArrow(key, "pivot int, d double, vec_id long, v binary"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def annulus() -> pa.RecordBatch:
            nonlocal held, made
            ids = np.array([r[2] for r in held], "<i8").tobytes()
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]]), pa.array([held[-1][1]]), pa.array([ids]), pa.array([b"".join(r[3] for r in held)])], names=["block", "pivot", "low", "high", "ids", "rows"])
            held, made = [], made + 1
            return out

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("pivot", "d", "vec_id", "v")), strict=True):
                if held and (held[0][0] != r[0] or len(held) >= size):
                    yield annulus()
                held.append(r)
        if held:
            yield annulus()

    parts = min(BLOCKS, parts_for(spark, n, 16 * size))
    annuli = saved(keyed.repartitionByRange(parts, "pivot", "d", "vec_id").sortWithinPartitions("pivot", "d", "vec_id").mapInArrow(cut, "block long, pivot int, low double, high double, ids binary, rows binary"))
    about = annuli.select("block", "pivot", "low", "high").collect()
    blocks = np.array([r["block"] for r in about], np.int64)
    centre, low, high = np.array([r["pivot"] for r in about]), np.array([r["low"] for r in about]), np.array([r["high"] for r in about])

    def gaps(v: np.ndarray) -> np.ndarray:
        """Least distance of each query to what each annulus may hold."""
        d = pivot.distances(np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1))[:, centre]
        return np.maximum(0, np.maximum(low - d, d - high))

    def packets(ids: np.ndarray, v: np.ndarray, goes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for j in np.flatnonzero(goes.any(0)):
            at = np.flatnonzero(goes[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(blocks[[j]]), pa.array([ids[at].astype("<i8").tobytes()]), pa.array([v[at].astype("<i8").tobytes()])], names=["block", "q_ids", "q_rows"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for b in batches:
            for i in range(0, b.num_rows, query_block):
                part = b.slice(i, query_block)
                yield part, part.column("vec_id").to_numpy(), _matrix(part.column("v"), dim)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, v in slices(batches):
            goes = np.zeros((len(v), len(blocks)), bool)
            goes[np.arange(len(v)), gaps(v).argmin(1)] = True
            yield from packets(ids, v, goes)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, v in slices(batches):
            reach = ((v.astype(np.float64) ** 2).sum(1)[:, None] + pivot.most - gaps(v) ** 2) / 2
            bound = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            slack = margin + 1e-6 * (v.astype(np.float64) ** 2).sum(1)
            yield from packets(ids, v, reach + slack[:, None] >= np.where(np.isnan(bound), -np.inf, bound)[:, None])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for ids, rows, q_ids, q_rows in zip(*(b.column(c) for c in ("ids", "rows", "q_ids", "q_rows")), strict=True):
                own, asking = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(q_ids.as_buffer(), "<i8")
                v, q = (np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dim) if dim else np.zeros((m, 0), np.int64) for x, m in ((rows, len(own)), (q_rows, len(asking))))
                for i, found, score in best(q, asking, v, own, k):
                    for c, x in zip(out, (np.full(len(found), asking[i]), found, score), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *c])) for c in out], names=["query_id", "vec_id", "score"])

    def searched(routed: DataFrame) -> DataFrame:
        # a merge, as both sides grow with the vectors: neither may be broadcast
        return annuli.select("block", "ids", "rows").join(routed.hint("merge"), "block").drop("block").mapInArrow(search, "query_id long, vec_id long, score long")

    packet = "block long, q_ids binary, q_rows binary"
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = asked.dropDuplicates(["vec_id", "v"])
    seeds = saved(searched(once.mapInArrow(nearest, packet)).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")))
    bounded = once.join(seeds.where(F.col("found") >= k).select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
    found = searched(saved(bounded).mapInArrow(expand, packet))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of all embeddings for every row whose vec_id is divisible by 20."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
