"""Kendall's S and the median slope against all pairs."""

import random
import time

import numpy as np
import pytest

from tidewatch.operators import kendall, series


def plain(x):
    i, j = np.triu_indices(len(x), 1)
    return np.sign(x[j] - x[i]).sum(), np.median((x[j] - x[i]) / (j - i)) if len(x) > 1 else 0.0


def kinds(rng, n):
    yield rng.normal(size=n)
    yield rng.integers(0, 3, n).astype(float)
    yield np.zeros(n)
    yield np.arange(n) * 0.1
    yield np.where(rng.random(n) < 0.9, 0.0, rng.normal(size=n))
    yield np.cumsum(rng.normal(size=n)) * 1e6
    yield np.arange(n) % 2 * 1.0
    yield rng.normal(size=n) * 1e-9 + 5


@pytest.mark.parametrize("n", [2, 3, 4, 7, 40, 301])
def test_against_all_pairs(n):
    rng = np.random.default_rng(n)
    for limit in (8, 1000, None):
        for x in kinds(rng, n):
            s, slope = plain(x)
            assert kendall.kendall_s(x) == s
            assert kendall.median_slope(x, limit) == pytest.approx(slope, rel=1e-9, abs=1e-12 * max(1, np.abs(x).max()))


def test_crossings_are_the_inversions():
    rng = random.Random(1)
    for n in (1, 2, 5, 33):
        rank = np.array(rng.sample(range(n), n))
        got = sorted((int(ones[b + k]), int(z)) for ones, zeros, begin, count in kendall.crossings(rank) for z, b, c in zip(zeros, begin, count, strict=True) for k in range(c))
        assert got == [(p, q) for p in range(n) for q in range(p + 1, n) if rank[p] > rank[q]]


def test_sites(spark):
    rng = np.random.default_rng(5)
    own = {"none": [None], "one": [0.5], "three": [1.0, 2.0, 3.0], "short": rng.normal(size=30).tolist() + [None], "long": rng.normal(size=700).tolist(), "flat": [1.0] * 600}
    rows = [(s, t, x) for s, xs in own.items() for t, x in enumerate(xs)]
    rng.shuffle(rows)
    got = {r["site"]: r for r in series.mann_kendall(spark.createDataFrame([(s, int(t), None if x is None else float(x)) for s, t, x in rows], "site string, t int, x double")).collect()}
    assert set(got) == set(own) - {"none"} and got["one"]["s"] == got["three"]["s"] == 0
    for s in ("short", "long", "flat"):
        want = plain(np.array([x for x in own[s] if x is not None]))
        assert (got[s]["s"], got[s]["slope"]) == pytest.approx(want)


def test_a_site_of_100000_points():
    x = np.random.default_rng(2).normal(size=100_000) + np.arange(100_000) * 1e-5
    began = time.time()
    slope = kendall.median_slope(x)
    assert slope == pytest.approx(1e-5, abs=1e-6) and time.time() - began < 120
    below = kendall._not_above(x, slope)
    total = 100_000 * 99_999 // 2
    assert abs(below - total / 2) <= 2
    assert kendall.kendall_s(x) > 0


def test_equal_days_are_equal_however_the_table_is_cut(spark, tmp_path):
    """Days of the same values in the same order, some of them cut between two tasks, neither rise nor fall."""
    from datetime import datetime

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewatch.plans.queries import ORACLES, QUERIES

    rows = [[(day, v) for day in (1, 2, 3, 4, 5) for v in ((0.1,) if day < 4 else (0.1, 0.2, 0.3))], [(day, v) for day in (1, 2, 3) for v in (0.2, 0.3)]]
    (tmp_path / "events.parquet").mkdir()
    for i, part in enumerate(rows):
        table = pa.table({"ts": [datetime(2024, 1, day) for day, _ in part], "user_id": [7] * len(part), "event_type": ["view"] * len(part), "value": [v for _, v in part]})
        pq.write_table(table, tmp_path / "events.parquet" / f"part-{i}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for bytes_ in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
            for name in ("mann_kendall", "trend_report"):
                out = QUERIES[name](spark, str(tmp_path))
                want = con.execute(ORACLES[name]).df()[out.columns].iloc[0].tolist()
                assert list(out.first()) == want and want[out.columns.index("tau")] == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
