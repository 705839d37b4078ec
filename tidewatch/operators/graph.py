"""Block-model communities of a co-occurrence graph. The graph is of taxa, so it fits a task; the search grid is distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacency(edges: list[tuple[str, str]], taxa: list[str]) -> np.ndarray:
    place = {t: i for i, t in enumerate(taxa)}
    out = np.zeros((len(taxa), len(taxa)))
    for a, b in edges:
        out[place[a], place[b]] = out[place[b], place[a]] = 1
    return out


def fit_blocks(adj: np.ndarray, k: int, seed: int, rounds: int = 300, self_terms: bool = False) -> tuple[float, float, np.ndarray]:
    """(log-likelihood, ICL, memberships) of a stochastic block model with k blocks, by variational EM.

    self_terms keeps a node's pair with itself in the updates."""
    n = len(adj)
    rng = np.random.default_rng([k, seed])
    if seed == 0:  # from the leading eigenvectors: the nearest of k rows that lie far apart
        values, vectors = np.linalg.eigh(adj)
        rows = vectors[:, np.argsort(-np.abs(values))[:k]] * np.sort(np.abs(values))[::-1][:k]
        centres = [int((rows**2).sum(1).argmax())]
        while len(centres) < k:
            centres.append(int(((rows[:, None] - rows[centres]) ** 2).sum(2).min(1).argmax()))
        q = np.eye(k)[((rows[:, None] - rows[centres]) ** 2).sum(2).argmin(1)] * 0.9 + 0.1 / k
    else:
        q = rng.dirichlet(np.full(k, 0.2), n)
    absent = 1 - adj - (0 if self_terms else np.eye(n))
    like = -np.inf
    for _ in range(rounds):
        size = q.sum(0)
        share = np.clip(size / n, 1e-12, None)
        links, pairs = q.T @ adj @ q, q.T @ (adj + absent) @ q
        p = np.clip(links / np.maximum(pairs, 1e-12), 1e-6, 1 - 1e-6)
        logit = np.log(share) + adj @ q @ np.log(p).T + absent @ q @ np.log(1 - p).T
        new = np.exp(logit - logit.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - q).max()
        q = new
        if moved < 1e-6:
            break
    block = q.T @ adj @ q * np.log(p) + q.T @ absent @ q * np.log(1 - p)
    like = float(block.sum() / 2 + (q * np.log(share)).sum())
    entropy = float(-(q * np.log(np.maximum(q, 1e-12))).sum())
    free = k * (k + 1) / 2 + k - 1
    return like, like - entropy - free / 2 * np.log(max(n * (n - 1) / 2, 1)), q


def block_matrix(adj: np.ndarray, labels: list[int]) -> np.ndarray:
    """Share of linked pairs within and between blocks."""
    q = np.eye(max(labels) + 1)[labels]
    pairs = q.T @ (1 - np.eye(len(adj))) @ q
    return q.T @ adj @ q / np.maximum(pairs, 1)


def degenerate(adj: np.ndarray, labels: list[int], least: float = 0.05) -> bool:
    """Whether all blocks are linked much alike, so that communities may mean nothing."""
    return bool(np.std(block_matrix(adj, labels)) < least)


def pair_stability(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """(together, probability, spread) over pairs of taxa that labels (taxon, label) puts together or apart: how often the resamples
    (rep, taxon, label) that hold both put them into one block."""
    a, b = runs.select("rep", F.col("taxon").alias("a"), F.col("label").alias("x")), runs.select("rep", F.col("taxon").alias("b"), F.col("label").alias("y"))
    pairs = a.join(b, "rep").where("a < b").groupBy("a", "b").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("p"))
    own = pairs.join(labels.select(F.col("taxon").alias("a"), F.col("label").alias("u")), "a").join(labels.select(F.col("taxon").alias("b"), F.col("label").alias("v")), "b")
    return own.groupBy((F.col("u") == F.col("v")).alias("together")).agg(F.avg("p").alias("probability"), F.stddev_pop("p").alias("spread"))


def communities(edges: DataFrame, max_k: int = 12, starts: int = 10) -> DataFrame:
    """(taxon, label, k, icl, degenerate): the block of each taxon that has an edge, under the number of blocks of largest ICL (the
    smallest of equal ones), and whether those blocks are linked much alike. Each (k, start) is a row of the grid and runs as a task of its own. No edge: no row."""
    spark = edges.sparkSession
    pairs = [(r["a"], r["b"]) for r in edges.select("a", "b").collect()]
    taxa = sorted({t for p in pairs for t in p})
    schema = "k int, start int, likelihood double, icl double, labels array<int>, degenerate boolean"
    if len(taxa) < 3:
        return spark.createDataFrame([(t, 0, 1, 0.0, False) for t in taxa], "taxon string, label int, k int, icl double, degenerate boolean")
    adj = adjacency(pairs, taxa)
    grid = spark.createDataFrame([(k, s) for k in range(2, min(max_k, len(taxa) - 1) + 1) for s in range(starts)], "k int, start int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, s in zip(f["k"], f["start"], strict=True):
                like, icl, q = fit_blocks(adj, int(k), int(s))
                labels = q.argmax(1).astype(int).tolist()
                rows.append((k, s, like, icl, labels, degenerate(adj, labels)))
            yield pd.DataFrame(rows, columns=["k", "start", "likelihood", "icl", "labels", "degenerate"])

    fits = grid.repartition(grid.count()).mapInPandas(run, schema)
    best = fits.groupBy("k").agg(F.max_by(F.struct("icl", "labels", "degenerate"), F.struct("likelihood", -F.col("start"))).alias("f")).agg(F.max_by(F.struct("k", "f.icl", "f.labels", "f.degenerate"), F.struct("f.icl", -F.col("k"))).alias("m"))
    names = F.array(*[F.lit(t) for t in taxa])
    return best.select("m.k", "m.icl", "m.degenerate", F.explode(F.arrays_zip(names.alias("taxon"), F.col("m.labels").alias("label"))).alias("z")).select("z.taxon", "z.label", "k", "icl", "degenerate")


def bootstrap_stability(values: DataFrame, reps: int = 100, rho_threshold: float = 0.45, max_k: int = 6, seed: int = 0) -> DataFrame:
    """(rep, k, taxon, label): communities of resampled samples (with replacement), a rep in each task; values: dense clr."""
    wide = values.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("taxon", "clr"))).alias("v"))
    rows = wide.orderBy("sample").collect()
    taxa = [x["taxon"] for x in rows[0]["v"]] if rows else []
    matrix = np.array([[x["clr"] for x in r["v"]] for r in rows])
    spark = values.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for rep in f["rep"]:
                rng = np.random.default_rng([seed, int(rep)])
                x = matrix[rng.integers(0, len(matrix), len(matrix))]
                ranks = np.array([pd.Series(c).rank().to_numpy() for c in x.T])
                with np.errstate(invalid="ignore"):
                    rho = np.nan_to_num(np.corrcoef(ranks))
                adj = (np.abs(rho) >= rho_threshold).astype(float)
                np.fill_diagonal(adj, 0)
                on = adj.sum(0) > 0
                if on.sum() < 3:
                    continue
                fits = [(fit_blocks(adj[on][:, on], k, 0), k) for k in range(2, min(max_k, int(on.sum()) - 1) + 1)]
                (_, _, q), k = max(fits, key=lambda t: (t[0][1], -t[1]))
                yield pd.DataFrame({"rep": rep, "k": k, "taxon": np.array(taxa)[on], "label": q.argmax(1)})

    return spark.range(reps).withColumnRenamed("id", "rep").repartition(reps).mapInPandas(run, "rep long, k long, taxon string, label long")
