"""Stupid-backoff language-model scores from n-gram count tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table

ALPHA = 0.4
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes that are no ASCII white space) of all texts, and how many each has."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[codes]
    start, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = end - start
    edge = np.cumsum([1, *(len(r) + 1 for r in raw)])
    counts = np.diff(np.searchsorted(start, edge))
    if not len(start):
        return np.empty(0, np.uint64), counts
    power = np.ones(int(size.max()), np.uint64)
    np.multiply.accumulate(np.full(len(power), _BASE, np.uint64), out=power)
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(first, size)
    value = (codes[~space].astype(np.uint64) + np.uint64(1)) * power[inside]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64)), counts


def ngram_hashes(words: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to order: hashes of the n-grams within texts, and the place of each one's last word."""
    inside = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    out, h = [], words
    for n in range(1, order + 1):
        if n > 1:
            h = mix64(np.concatenate([np.zeros(1, np.uint64), h[:-1]])[: len(h)] * np.uint64(_BASE) + words + np.uint64(n))
        at = np.flatnonzero(inside >= n - 1)
        out.append((h[at], at))
    return out


def _chunks(column: pa.Array, chars: int = 1 << 21) -> Iterator[list[str | None]]:
    out, n = [], 0
    for t in column.to_pylist():
        out.append(t)
        n += len(t or "")
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


def _all_grams(column: pa.Array, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes and places of the n-grams of a column of texts, by n, and the texts' word counts."""
    hashes: list[list[np.ndarray]] = [[] for _ in range(order)]
    places: list[list[np.ndarray]] = [[] for _ in range(order)]
    sizes, before = [np.zeros(0, np.int64)], 0
    for texts in _chunks(column):
        words, counts = word_hashes(texts)
        for n, (h, at) in enumerate(ngram_hashes(words, counts, order)):
            hashes[n].append(h)
            places[n].append(at + before)
        sizes.append(counts)
        before += len(words)
    join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
    return [join(h, np.uint64) for h in hashes], [join(p, np.int64) for p in places], np.concatenate(sizes)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, so that the high ones, mostly zero, compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def backoff_scores(hashes: list[np.ndarray], places: list[np.ndarray], sizes: np.ndarray, grams: np.ndarray, totals: np.ndarray, n_words: int, alpha: float) -> np.ndarray:
    """Log score of each word. grams: sorted hashes of all n-grams here; totals: their counts in the corpus."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = (n_words - sizes).astype(np.float64)[doc]
    score = np.log(alpha) - np.log(left + 1)
    before = left  # what the n-gram's count is divided by, for each word
    for n, (h, at) in enumerate(zip(hashes, places, strict=True)):
        i = np.searchsorted(grams, h)
        _, inverse, own = np.unique(doc[at] * np.int64(len(grams) + 1) + i, return_inverse=True, return_counts=True)
        rest = np.zeros(len(doc))
        rest[at] = totals[i] - own[inverse]
        if n:
            score[at] += np.log(alpha)
        known = rest > 0
        score[known] = np.log(rest[known] / before[known])
        before = np.concatenate([np.zeros(1), rest])[: len(doc)]
    return score


def lm_scores(df: DataFrame, order: int = 2, alpha: float = ALPHA, text: str = "text", key: str = "doc_id", part_chars: int = 8 << 20) -> DataFrame:
    """Each row's key, n_tokens, score_micro (sum over its words of their log score, in whole micro-nats) and mean_score.

    A word's score is count(n-gram) / count(its context) for the longest n-gram, up to `order` words, that occurs in
    other rows, times alpha for each word by which that is shorter than what the text allows. A word that no other row
    has counts as alpha / (words of the others + 1). Counts are over all rows but the scored one, so a model of the corpus
    does not praise a text for itself. No text or no word: 0 and a null mean. Rows may repeat: each counts.

    Rows are dealt to parts by a hash. Each part counts its distinct n-grams and sends hashes and counts, sorted and packed
    by hash range; the task of a range adds up its table and joins the sums back to the parts that asked, in their order;
    a part then looks its n-grams up and sums per row. A frequent n-gram is one entry for each part. The text crosses
    the network once, an n-gram once for each part (pre-aggregated), its sum the same way back. N-grams are told apart
    by 64-bit hashes.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    facts = docs.agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(facts["n"] or 0) // part_chars), 1)
    bits = max(0, int(parts - 1).bit_length())
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc", "text"), F.lit(parts)).cast("int")).repartition(parts, "part")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Array]] = {}
        for b in batches:
            own = b.column("part").to_numpy()
            for p in np.unique(own):
                held.setdefault(int(p), []).append(b.column("text").filter(pa.array(own == p)))
        for p in list(held):
            hashes, _, sizes = _all_grams(pa.chunked_array(held.pop(p)).combine_chunks(), order)
            grams, counts = np.unique(np.concatenate(hashes), return_counts=True)
            edges = np.searchsorted(grams >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(grams)])
            rows = [(r, p, _planes(np.diff(grams[a:b], prepend=np.uint64(0))), _planes(counts[a:b].astype("<u4"))) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            rows.append((-1, p, b"", np.array([sizes.sum()], "<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "part", "grams", "counts"])

    asked = dealt.mapInArrow(ask, "range int, part int, grams binary, counts binary")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for r, p, g, c in zip(*(b.column(x).to_pylist() for x in b.schema.names), strict=True):
                held.setdefault(r, []).append((p, np.cumsum(_numbers(g, "<u8")), _numbers(c, "<u4")) if r >= 0 else (p, None, np.frombuffer(c, "<u8")))
        for r in list(held):
            rows = held.pop(r)
            if r < 0:  # the number of words: each part gets the sum of all
                yield _sums(r, [(p, np.array([sum(int(c[0]) for _, _, c in rows)])) for p, _, _ in rows])
                continue
            every, place = np.unique(np.concatenate([g for _, g, _ in rows]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([c for _, _, c in rows]).astype(np.float64), minlength=len(every)).astype(np.int64)
            ends = np.cumsum([len(g) for _, g, _ in rows])
            yield _sums(r, [(p, total[place[e - len(g) : e]]) for (p, g, _), e in zip(rows, ends, strict=True)])

    answered = asked.repartition(parts, "range").mapInArrow(answer, "range int, part int, wide boolean, totals binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, places, sizes = _all_grams(left.column("text").combine_chunks(), order)
        rows = sorted(zip(*(right.column(c).to_pylist() for c in ("range", "wide", "totals")), strict=True))
        totals = [_numbers(t, "<u8" if w else "<u4").astype(np.int64) for _, w, t in rows]
        if not len(sizes):
            sizes = np.zeros(0, np.int64)
        per_word = backoff_scores(hashes, places, sizes, np.unique(np.concatenate(hashes)), np.concatenate([np.zeros(0, np.int64), *totals[1:]]), int(totals[0][0]), alpha)
        micro = np.concatenate([[0], np.cumsum(np.floor(per_word * 1e6 + 0.5).astype(np.int64))])
        ends = np.cumsum(sizes)
        return pa.table({"doc": left.column("doc"), "n_tokens": pa.array(sizes.astype(np.int64)), "score_micro": pa.array(micro[ends] - micro[ends - sizes])})

    out = dealt.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(score, f"doc {df.schema[key].dataType.simpleString()}, n_tokens long, score_micro long")
    return out.select(F.col("doc").alias(key), "n_tokens", "score_micro", F.round(F.col("score_micro") / F.lit(1e6) / F.when(F.col("n_tokens") > 0, F.col("n_tokens")), 6).alias("mean_score"))


def _sums(r: int, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    wide = [bool(len(t) and t.max() >= 1 << 32) for _, t in rows]
    packed = [_planes(t.astype("<u8" if w else "<u4")) for (_, t), w in zip(rows, wide, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()), pa.array(wide), pa.array(packed, pa.binary())], names=["range", "part", "wide", "totals"])


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram stupid-backoff scores of all documents, each against all the others."""
    return lm_scores(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS ws FROM documents
), t AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), u AS (
  SELECT rid, i, w, lag(w) OVER (PARTITION BY rid ORDER BY i) AS v FROM t
), c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w),
o1 AS (SELECT rid, w, count(*) AS n FROM t GROUP BY rid, w),
c2 AS (SELECT v, w, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT rid, v, w, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY rid, v, w),
k AS (
  SELECT u.rid, u.v IS NULL AS first, c1.n - o1.n AS r1, coalesce(c2.n - o2.n, 0) AS r2, coalesce(p1.n - q1.n, 0) AS rv,
    (SELECT count(*) FROM t) - len(d.ws) AS rest
  FROM u JOIN d ON u.rid = d.rid JOIN c1 ON u.w = c1.w JOIN o1 ON o1.rid = u.rid AND o1.w = u.w
  LEFT JOIN c2 ON c2.v = u.v AND c2.w = u.w LEFT JOIN o2 ON o2.rid = u.rid AND o2.v = u.v AND o2.w = u.w
  LEFT JOIN c1 p1 ON p1.w = u.v LEFT JOIN o1 q1 ON q1.rid = u.rid AND q1.w = u.v
), s AS (
  SELECT rid, CASE WHEN r2 > 0 THEN ln(r2 / CAST(rv AS DOUBLE))
    ELSE CASE WHEN r1 > 0 THEN ln(r1 / CAST(rest AS DOUBLE)) ELSE ln(CAST(0.4 AS DOUBLE)) - ln(CAST(rest + 1 AS DOUBLE)) END
      + CASE WHEN first THEN 0 ELSE ln(CAST(0.4 AS DOUBLE)) END END AS x
  FROM k
), a AS (SELECT rid, sum(CAST(floor(x * 1e6 + 0.5) AS BIGINT)) AS m FROM s GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(coalesce(m, 0) AS BIGINT) AS score_micro,
  CASE WHEN len(ws) > 0 THEN round(m / CAST(1e6 AS DOUBLE) / len(ws), 6) END AS mean_score
FROM d LEFT JOIN a USING (rid)
"""
