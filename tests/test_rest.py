"""Operators that had no test of their own: endpoints of CUSUM, metadata joins, report samples, start of a watch, normalised novelty."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import characterize, novelty, series
from tidewatch.sources import reports
from tidewatch.streaming.watch import watch


def test_the_last_point_of_a_cusum(spark):
    rng = np.random.default_rng(1)
    rows = [(s, t, float(x)) for s in "ab" for t, x in enumerate(rng.normal(size=12) + (np.arange(12) > 7) * 3)]
    df = spark.createDataFrame(rows, "site string, t int, x double")
    every = series.cusum(df)
    last = {r["site"]: r for r in series.latest(every).collect()}
    for s in "ab":
        x = np.array([v for site, _, v in rows if site == s])
        level = 0.0
        for v in (x - x[:6].mean()) / x[:6].std(ddof=1):
            level = max(0.0, level + v - 0.5)
        assert last[s]["t"] == 11 and last[s]["cusum_upper"] == pytest.approx(level) and last[s]["alert"] == (level > 4)


def test_metadata_of_samples(spark):
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    accessions = spark.createDataFrame([("a", "SRR1"), ("b", "SRR2")], "sample string, accession string")
    metadata = spark.createDataFrame([("SRR1", "USA: Ohio", "2026-01-05")], "accession string, geo string, date string")
    rows = {r["sample"]: r for r in characterize.with_metadata(samples, accessions, metadata).select("sample", "accession", characterize_label()).collect()}
    assert {s: r["label"] for s, r in rows.items()} == {"a": "Ohio, (2026-01-05)", "b": "b", "c": "c"} and rows["c"]["accession"] is None


def characterize_label():
    from tidewatch.functions.columns import place_label

    return place_label(F.col("geo"), F.col("date"), F.col("sample")).alias("label")


def test_samples_of_a_report(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"metadata": {"rank": "G"}, "samples": [{"sample": "a", "score": 0.5, "level": "MODERATE"}, {"sample": "b", "score": 0.1, "level": "LOW"}]}, indent=1))
    assert sorted((r["sample"], r["score"]) for r in reports.report_samples(spark, str(tmp_path / "r.json")).collect()) == [("a", 0.5), ("b", 0.1)]


def test_a_watch_that_begins_with_what_comes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.report").write_text("x\n")
    seen = []
    go = lambda: watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda path, lines: seen.append(path.rsplit("/", 1)[1]), run_on_start=False).awaitTermination()
    go()
    assert seen == []
    (tmp_path / "in" / "new.report").write_text("y\n")
    go()
    assert seen == ["new.report"]


def test_novelty_is_normalised_over_the_cohort(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 4))
    x[3] += 8
    df = spark.createDataFrame([(f"s{i:02}", f"t{k}", float(x[i, k])) for i in range(12) for k in range(4)], "sample string, taxon string, clr double")
    iso = {r["sample"]: r["isolation"] for r in novelty.isolation_scores(df, trees=20).collect()}
    spikes = {r["sample"]: r["spike"] for r in novelty.cohort_spikes(df, "clr").collect()}
    low, high = min(iso.values()), max(iso.values())
    got = {r["sample"]: r["novelty"] for r in novelty.cohort_novelty(df, trees=20).collect()}
    assert got == pytest.approx({s: min(max(0.6 * (iso[s] - low) / (high - low + 1e-10) + 0.4 * spikes[s], 0), 1) for s in iso})
    assert max(got, key=got.get) == "s03" and novelty.cohort_novelty(df.where("sample < 's03'")).select("novelty").distinct().collect()[0][0] == 0.0
