"""Novelty of samples: isolation forest over a cohort, k-mer profiles against a background, nearest codes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.columns import clip
from tidewatch.operators.baseline import cohort_spikes
from tidewatch.operators.blocks import nearest_columns
from tidewatch.operators.tables import cut


def _average_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A random tree on the rows of x: for each node its feature (-1: a leaf), cut, left and right node, and a leaf's path length."""
    feature, cut, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for column in (feature, cut, left, right, path):
            column.append(0)
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
        able = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(able):
            feature[me], path[me] = -1, depth + _average_path(len(rows))
            return me
        feature[me] = int(rng.choice(able))
        cut[me] = float(rng.uniform(rows[:, feature[me]].min(), rows[:, feature[me]].max()))
        low = rows[:, feature[me]] < cut[me]
        left[me], right[me] = node(rows[low], depth + 1), node(rows[~low], depth + 1)
        return me

    node(x, 0)
    return np.array(feature), np.array(cut, float), np.array(left), np.array(right), np.array(path, float)


def isolation_scores(values: DataFrame, value: str = "clr", trees: int = 200, subsample: int = 256, seed: int = 42, pool: int = 20_000) -> DataFrame:
    """(sample, isolation): an isolation forest's anomaly score over the samples' standardised vectors.

    Trees are grown on subsamples of at most `pool` samples, chosen by a hash (all, if fewer), which is all that the driver gets; the trees go to the
    tasks, and every sample is scored where it is."""
    std = F.stddev_pop(value).over(W.partitionBy("taxon"))
    scaled = values.withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(W.partitionBy("taxon")), std), F.lit(0.0)))
    rows = scaled.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("taxon", "z"))), lambda s: s["z"]).alias("v"))
    some = np.array([r["v"] for r in rows.orderBy(F.xxhash64("sample"), "sample").limit(pool).select("v").collect()], float)
    psi = min(subsample, len(some))
    limit = int(np.ceil(np.log2(max(psi, 2))))
    forest = []
    for tree in range(trees if psi else 0):
        rng = np.random.default_rng([seed, tree])
        forest.append(_tree(some[rng.choice(len(some), psi, replace=False)], limit, rng))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["v"].tolist(), float).reshape(len(f), -1)
            total, every = np.zeros(len(x)), np.arange(len(x))
            for feature, cut, left, right, path in forest:
                at = np.zeros(len(x), np.int64)
                for _ in range(limit):
                    inner = feature[at] >= 0
                    low = x[every, np.maximum(feature[at], 0)] < cut[at]
                    at = np.where(inner, np.where(low, left[at], right[at]), at)
                total += path[at]
            yield pd.DataFrame({"sample": f["sample"], "path": total / max(trees, 1)})

    paths = rows.mapInPandas(run, f"sample {values.schema['sample'].dataType.simpleString()}, path double")
    return paths.select("sample", F.pow(F.lit(2.0), -F.col("path") / max(_average_path(psi), 1e-9)).alias("isolation"))


def cohort_novelty(values: DataFrame, value: str = "clr", trees: int = 200, seed: int = 42) -> DataFrame:
    """(sample, novelty): 0.6 of the isolation score, brought to 0..1 over the cohort, and 0.4 of the largest spike.
    Cohorts of fewer than four samples have none."""
    if values.select("sample").distinct().count() < 4:
        return values.select("sample").distinct().withColumn("novelty", F.lit(0.0))
    iso = isolation_scores(values, value, trees, seed=seed)
    ends = iso.agg(F.min("isolation").alias("low"), F.max("isolation").alias("high"))
    iso = iso.join(F.broadcast(ends)).withColumn("iso", (F.col("isolation") - F.col("low")) / (F.col("high") - F.col("low") + 1e-10))
    return iso.join(cohort_spikes(values, value), "sample").select("sample", clip(0.6 * F.col("iso") + 0.4 * F.col("spike"), 0, 1).alias("novelty"))


def kmer_vocabulary(spark: SparkSession, k: int = 6, alphabet: str = "ACGT") -> DataFrame:
    """(kmer, index) of all k-letter words of the alphabet, in order: the index is the word read as a number."""
    n = len(alphabet)
    letter = lambda i: F.substring(F.lit(alphabet), (F.floor(F.col("id") / n ** (k - 1 - i)) % n + 1).cast("int"), F.lit(1))
    return spark.range(n**k).select(F.concat(*[letter(i) for i in range(k)]).alias("kmer"), F.col("id").cast("int").alias("index"))


def letters(alphabet: str) -> bytes:
    """The letters of an alphabet that is written as in a regular expression's class: ACGT, a-z."""
    spans = re.findall(r"(.)-(.)|(.)", alphabet)
    return bytes(sorted({c for a, b, one in spans for c in ([ord(one)] if one else range(ord(a), ord(b) + 1))}))


def kmer_profiles(reads: DataFrame, k: int = 6, alphabet: str = "ACGT", fold: bool = True, most: int = 1 << 20) -> DataFrame:
    """(sample, kmer, freq): mean over a sample's reads (sample, read_no, seq) of the shares of k-mers in each. A read
    without a k-mer counts as all zero. The alphabet is of ASCII letters.

    Arrow batches count: a read's k-mers are numbers, its shares are added to its sample's sums, and only these leave the task (when over
    `most` of them are held, and at its end), so a row is a k-mer of a sample, not of a read."""
    known = letters(alphabet)
    base = len(known)
    if k * np.log2(base) > 62:
        raise ValueError(f"{k} letters of {base} do not fit into a number")
    code = np.full(256, -1, np.int64)
    code[np.frombuffer(known, np.uint8)] = np.arange(base)
    schema = f"sample {reads.schema['sample'].dataType.simpleString()}, code long, w double, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            names, codes, weights, counts = [], [], [], []
            for s, (n, parts) in held.items():
                own, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in parts)]), return_inverse=True)
                sums = np.bincount(place, weights=np.concatenate([np.zeros(0), *(w for _, w in parts)]), minlength=len(own))
                names += [s] * (len(own) + 1)
                codes += [np.array([-1]), own]
                weights += [np.zeros(1), sums]
                counts += [np.array([n]), np.zeros(len(own), np.int64)]
            held.clear()
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            return pa.RecordBatch.from_arrays([pa.array(names, kind), join(codes, pa.int64()), join(weights, pa.float64()), join(counts, pa.int64())], names=["sample", "code", "w", "n"])

        size, kind = 0, None
        for b in batches:
            kind = b.schema.field("sample").type
            for s, seq in zip(b.column("sample").to_pylist(), b.column("seq").to_pylist(), strict=True):
                n, parts = held.get(s, (0, []))
                text = (seq or "").upper() if fold else seq or ""
                digits = code[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
                if len(digits) >= k:
                    value, ok = np.zeros(len(digits) - k + 1, np.int64), np.ones(len(digits) - k + 1, bool)
                    for i in range(k):
                        d = digits[i : len(digits) - k + 1 + i]
                        value, ok = value * base + d, ok & (d >= 0)
                    own, count = np.unique(value[ok], return_counts=True)
                    if len(own):
                        parts.append((own, count / count.sum()))
                        size += len(own)
                held[s] = (n + 1, parts)
            if size > most:
                yield flush(kind)
                size = 0
        if held:
            yield flush(kind)

    sums = reads.select("sample", "seq").mapInArrow(run, schema).groupBy("sample", "code").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    text = known.decode()
    letter = lambda i: F.substring(F.lit(text), (F.floor(F.col("code") / base ** (k - 1 - i)) % base + 1).cast("int"), F.lit(1))
    whole = sums.where("code = -1").select("sample", F.col("n").alias("n_reads"))
    return sums.where("code >= 0").join(whole, "sample").select("sample", F.concat(*[letter(i) for i in range(k)]).alias("kmer"), (F.col("w") / F.col("n_reads")).alias("freq"))


def fit_kmer_reference(profiles: DataFrame, floor_quantile: float = 0.5) -> DataFrame:
    """(kmer, mean, std, keep) over all background samples; k-mers that vary too little are not kept."""
    n = profiles.agg(F.count_distinct("sample")).scalar()
    stats = profiles.groupBy("kmer").agg((F.sum("freq") / n).alias("mean"), (F.sum(F.col("freq") * F.col("freq")) / n).alias("square"))
    stats = stats.withColumn("std", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    floor = stats.where("std > 0").agg(F.percentile("std", floor_quantile)).scalar()
    return stats.select("kmer", "mean", "std", (F.col("std") > F.greatest(F.lit(1e-9), floor)).alias("keep"))


def above_absence(profiles: DataFrame, reference: DataFrame, z_clip: float = 8.0) -> DataFrame:
    """(sample, kmer, z) of the kept k-mers that a sample has: its clipped z-score less that of a sample without the k-mer. Distances are those of z-scores, as
    what all samples have in common cancels out, and k-mers that a sample lacks need no row."""
    score = lambda x: clip((x - F.col("mean")) / F.col("std"), -z_clip, z_clip)
    return profiles.join(reference.where("keep"), "kmer").select("sample", "kmer", (score(F.col("freq")) - score(F.lit(0.0))).alias("z"))


def neighbour_distance(queries: DataFrame, reference: DataFrame | None, k: int = 5) -> DataFrame:
    """(sample, distance): mean Euclidean distance to the k nearest samples of the reference, or of the others (None); both (sample, kmer, z)."""
    return nearest_columns(queries, reference, "kmer", "sample", "z", k).groupBy(F.col("a").alias("sample")).agg(F.avg("distance").alias("distance"))


def kmer_novelty(queries: DataFrame, background: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(sample, novelty) of k-mer profiles against background ones, or among themselves: distance to the nearest, over the
    background's own leave-one-out distances (median and three scaled deviations). A sample that has none of the kept k-mers is one without any."""
    base = queries if background is None else background
    reference = cut(fit_kmer_reference(base))

    def own(profiles: DataFrame) -> DataFrame:
        found = above_absence(profiles, reference)
        return found.unionByName(profiles.select("sample").distinct().select("sample", F.lit("").alias("kmer"), F.lit(0.0).alias("z")))

    known = cut(own(base))
    inner = cut(neighbour_distance(known, None, k))
    middle = inner.agg(F.median("distance").alias("m"))
    spread = inner.join(F.broadcast(middle)).agg(F.max("m").alias("m"), (3 * 1.4826 * F.median(F.abs(F.col("distance") - F.col("m"))) + 1e-9).alias("s"))
    found = inner if background is None else neighbour_distance(own(queries), known, k)
    return found.join(F.broadcast(spread)).select("sample", F.round(clip((F.col("distance") - F.col("m")) / (F.col("s") + 1e-9), 0, 1), 4).alias("novelty"))


def fused_novelty(cohort: DataFrame, *others: DataFrame) -> DataFrame:
    """(sample, novelty): the largest novelty of any kind that a sample has; samples of the cohort only."""
    out = cohort.select("sample", "novelty")
    for more in others:
        out = out.join(more.select("sample", F.col("novelty").alias("other")), "sample", "left").select("sample", F.greatest("novelty", F.coalesce("other", F.lit(0.0))).alias("novelty"))
    return out


def embedding_novelty(losses: DataFrame, novel: float = 0.05, full: float = 0.1) -> DataFrame:
    """losses (..., loss) with `novelty` (the loss over `full`, 0 to 1) and `is_novel` (beyond `novel`)."""
    return losses.withColumns({"novelty": clip(F.col("loss") / full, 0, 1), "is_novel": F.col("loss") > novel})


def nearest_codes(vectors: DataFrame, codes: DataFrame) -> DataFrame:
    """(vec_id, code, distance2): the nearest code (code, centre) of each vector (vec_id, v), ties to the smaller. codes is a
    codebook of fixed size."""
    d2 = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = vectors.join(F.broadcast(codes)).withColumn("d2", d2)
    return pairs.groupBy("vec_id").agg(F.min(F.struct("d2", "code")).alias("m")).select("vec_id", "m.code", F.col("m.d2").alias("distance2"))


def fit_codebook(vectors: DataFrame, n_codes: int = 16, rounds: int = 8, decay: float = 0.0) -> DataFrame:
    """(code, centre): k-means codes with moving-average updates; a round is one grouped sum of each component."""
    spark = vectors.sparkSession
    seeds = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_codes).collect()
    centres = {i: list(map(float, r["v"])) for i, r in enumerate(seeds)}
    for _ in range(rounds):
        codes = spark.createDataFrame(list(centres.items()), "code int, centre array<double>")
        near = nearest_codes(vectors, codes).join(vectors, "vec_id")
        means = near.select("code", F.posexplode("v")).groupBy("code", "pos").agg(F.avg("col").alias("x")).groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
        for r in means.collect():
            centres[r["code"]] = [decay * a + (1 - decay) * b for a, b in zip(centres[r["code"]], r["c"], strict=True)]
    return spark.createDataFrame(list(centres.items()), "code int, centre array<double>")
