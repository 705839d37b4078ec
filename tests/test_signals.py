"""Signals as a stream against the batch windows, over restarts, with late rows and expiry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import series
from tidewatch.streaming.signals import started, streamed_signals

SCHEMA = "site string, t timestamp, x double"


def put(spark, rows, path):
    spark.createDataFrame(rows, "site string, day int, x double").selectExpr("site", "timestamp_seconds((10000 + day) * 86400) t", "x").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **settings):
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    started(streamed_signals(source, "400 days", **settings), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    return {(r["site"], int(r["t"].timestamp()) // 86400 - 10000): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(s, d, float(v)) for s in "ab" for d, v in enumerate(np.append(rng.gamma(4, 0.1, 24), [2.5, 0.4]))]
    put(spark, [r for r in rows if r[1] < 13][::-1], f"{tmp_path}/in")
    first = run(spark, tmp_path)
    assert len(first) == 26
    put(spark, [r for r in rows if r[1] >= 13] + [("a", 5, 9.0)], f"{tmp_path}/in")
    got = run(spark, tmp_path)
    line = spark.createDataFrame(rows, "site string, t int, x double")
    z = {(r["site"], r["t"]): r["z_score"] for r in series.rolling_baseline(line, 8).collect()}
    odd = {(r["site"], r["t"]): r for r in series.aberrations(line, 16).collect()}
    assert set(got) == set(z)
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.count() == len(rows) + 1
    late = kept.where("late").collect()
    assert [(r["site"], r["x"], r["note"], r["z_score"] is None or np.isnan(r["z_score"]), r["alarm"]) for r in late] == [("a", 9.0, "late", True, None)]
    for r in kept.where("not late").collect():
        key = (r["site"], int(r["t"].timestamp()) // 86400 - 10000)
        assert r["z_score"] == pytest.approx(z[key], abs=1e-9)
        assert (r["note"], r["alarm"]) == (odd[key]["note"], odd[key]["alarm"])
        assert (r["expected"], r["threshold"]) == pytest.approx((odd[key]["expected"], odd[key]["threshold"]), abs=2e-6)
    assert got["a", 24]["alarm"] and got["a", 24]["cusum"] > 4 and got["a", 24]["cusum_alert"]
    for s in "ab":
        x = [v for site, _, v in rows if site == s]
        level, m, sd = 0.0, np.mean(x[:8]), np.std(x[:8], ddof=1)
        for d in range(8, len(x)):
            level = max(0.0, level + (x[d] - m) / sd - 0.5)
            if (s, d) != ("a", 5):
                assert got[s, d]["cusum"] == pytest.approx(level, abs=1e-6)


def test_a_site_that_is_silent_is_forgotten(spark, tmp_path):
    put(spark, [("a", d, 1.0 + d % 2) for d in range(6)] + [("b", 0, 1.0)], f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    go = lambda: started(streamed_signals(source(), "1 day", expiry_days=30), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    go()
    put(spark, [("b", 100, 1.0)], f"{tmp_path}/in")
    go()
    put(spark, [("a", 101, 5.0), ("b", 101, 1.5)], f"{tmp_path}/in")
    go()
    rows = {(r["site"], r["d"]): r["z_score"] for r in spark.read.parquet(f"{tmp_path}/out").select("site", (F.unix_timestamp("t") / 86400 - 10000).cast("int").alias("d"), "z_score").collect()}
    assert rows["a", 5] != 0.0 and rows["a", 101] == 0.0
