"""Edges of a network against all pairs; p-values of whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import special
from tidewatch.operators import blocks, stats


def test_p_values_of_arrays():
    rng = np.random.default_rng(1)
    rho, n = rng.uniform(-1, 1, 400), rng.integers(3, 300, 400)
    want = [special.student_t_sf2(r * np.sqrt((m - 2) / (1 - r * r)), m - 2) for r, m in zip(rho, n, strict=True)]
    assert special.correlation_p(rho, n) == pytest.approx(want, rel=1e-9, abs=1e-14)
    assert special.correlation_p(np.array([1.0, -1.0, np.nan, 0.3, 0.0]), np.array([9, 9, 9, 2, 9])).tolist() == [0, 0, 1, 1, 1]
    for m in (3, 10, 500):
        cut = special.least_correlation(m, 0.05)
        assert 0.05 <= special.correlation_p(np.array([cut]), np.array([m]))[0] < 0.0501
    assert special.least_correlation(2, 0.05) == 2.0


@pytest.mark.parametrize("size", [(256, 4096), (5, 7)])
def test_block_pairs(spark, size):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 13)).round(2)
    df = spark.createDataFrame([(f"r{i}", f"c{k:02}", float(x[i, k])) for i in range(30) for k in range(13)], "r string, c string, v double")
    got = {(r["a"], r["b"]): r["product"] for r in blocks.strong_pairs(df, "r", "c", "v", 4.0, *size).collect()}
    every = x.T @ x
    want = {(f"c{a:02}", f"c{b:02}"): every[a, b] for a in range(13) for b in range(a + 1, 13) if abs(every[a, b]) >= 4}
    assert got == pytest.approx(want) and 0 < len(got) < 78


def test_edges_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 4))
    x = np.concatenate([base[:, [k % 4]] + rng.normal(size=(40, 1)) * (0.2 + k / 8) for k in range(14)] + [np.zeros((40, 1))], axis=1).round(1)
    df = spark.createDataFrame([(f"s{i}", f"t{k}", float(x[i, k])) for i in range(40) for k in range(15)], "sample string, taxon string, clr double")
    for alpha, least in ((0.05, 0.3), (0.01, 0.0)):
        got = {(r["a"], r["b"]): (r["rho"], r["p_adj"]) for r in stats.cooccurrence(df, least, alpha).collect()}
        every = stats.adjusted(stats.cut(stats.spearman(df)), "p", alpha).where(F.col("rejected") & (F.abs("rho") >= least)).collect()
        assert got.keys() == {(r["a"], r["b"]) for r in every} and len(got) > 3
        for r in every:
            assert got[r["a"], r["b"]] == pytest.approx((r["rho"], r["p_adj"]), rel=1e-6, abs=1e-12)
    assert stats.cooccurrence(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [(256, 4096), (4, 7)])
def test_nearest_columns(spark, size):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (30, 23)).astype(float)
    rows = [(f"r{i}", f"c{k:02}", float(x[i, k])) for i in range(30) for k in range(23) if x[i, k]]
    df = spark.createDataFrame(rows, "r string, c string, v double")
    far = np.sqrt(((x[:, :, None] - x[:, None, :]) ** 2).sum(0))

    def plain(queries, others, own):
        return sorted((f"c{a:02}", f"c{b:02}", round(d, 9)) for a in queries for d, b in sorted((round(far[a, b], 12), b) for b in others if not (own and a == b))[:3])

    shown = lambda got: sorted((r["a"], r["b"], round(r["distance"], 9)) for r in got.collect())
    assert [d for _, _, d in shown(blocks.nearest_columns(df, None, "r", "c", "v", 3, *size))] == [d for _, _, d in plain(range(23), range(23), True)]
    got = shown(blocks.nearest_columns(df.where("c < 'c06'"), df.where("c >= 'c06'"), "r", "c", "v", 3, *size))
    assert [(a, d) for a, _, d in got] == [(a, d) for a, _, d in sorted(plain(range(6), range(6, 23), False))] or sorted((a, d) for a, _, d in got) == sorted((a, d) for a, _, d in plain(range(6), range(6, 23), False))
