"""Baselines of sparse histories, in both spaces, by site and window; lineages of a run."""

import json
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import abundance, baseline, ranks, scoring
from tidewatch.operators.history import History
from tidewatch.plans.run import Config, analyse
from tidewatch.sources import dims


@pytest.mark.parametrize(("hot", "few"), [(1 << 20, 10_000), (3, 10_000), (3, 1)])
def test_order_statistics_with_implied_zeros(spark, monkeypatch, hot, few):
    monkeypatch.setattr(ranks, "FEW", few)
    rng = random.Random(hot)
    for n in (1, 2, 9, 40):
        dense = {f"t{k}": [rng.choice([0.0, 0.0, 0.25, 0.25, -0.5, rng.random()]) * (rng.random() < k / 5) for _ in range(n)] for k in range(1, 7)}
        dense["one"], dense["same"] = [0.2] + [0.0] * (n - 1), [0.3] * n
        rows = [(f"s{i}", t, v) for t, x in dense.items() for i, v in enumerate(x) if v or i == 0]
        got = {r["taxon"]: (r["median"], r["mad"]) for r in ranks.median_and_mad(spark.createDataFrame(rows, "sample string, taxon string, v double"), "v", n, hot=hot).collect()}
        for t, x in dense.items():
            m = np.median(x)
            assert got[t] == pytest.approx((m, np.median(np.abs(np.array(x) - m)))), (n, t)


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([("s", "a", None), ("s2", "a", 0.5), ("s3", "a", 0.5)], "sample string, taxon string, rel double")
    assert ranks.median_and_mad(rows, "rel", 3).first()["median"] == 0.5
    assert baseline.fit(rows.limit(0)).collect() == []


def test_a_genus_seen_once_in_nine_runs(spark):
    rows = [(f"r{i}::mill", "Bg", 1.0 if i else 0.8) for i in range(9)] + [("r0::mill", "Vibrio", 0.2)]
    past = spark.createDataFrame(rows, "sample string, taxon string, rel double")
    got = {r["taxon"]: (r["median"], r["scale"]) for r in baseline.fit(past).collect()}
    assert got == {"Bg": (1.0, 1e-3), "Vibrio": (0.0, 1e-3)}
    now = spark.createDataFrame([("mill", "Vibrio", 0.2), ("mill", "Bg", 0.8)], "sample string, taxon string, rel double")
    score = scoring.score_relative(now, baseline.fit(past), dims.pathogens(spark), dims.tripwires(spark).limit(0)).first()
    assert score["driver"] == "Vibrio" and score["score"] > 0.6


def test_rolling_fit_leaves_an_outbreak_out(spark):
    cols = {f"c{i}": {"Pseudomonas": 0.4, "Bg1": 0.6} for i in range(9)} | {"event": {"Pseudomonas": 0.2, "Vibrio": 0.6, "Bg1": 0.2}}
    past = spark.createDataFrame([(s, t, v) for s, x in cols.items() for t, v in x.items()], "sample string, taxon string, rel double")
    base = baseline.fit_rolling(past, spark.createDataFrame([("Vibrio",), ("Pseudomonas",)], "taxon string"))
    assert {r["taxon"]: (r["median"], r["scale"]) for r in base.collect()} == {"Pseudomonas": (0.4, 1e-3), "Bg1": (0.6, 1e-3), "Vibrio": (0.0, 1e-3)}


def endemic(rng, n):
    rows = []
    for i in range(n):
        p = max(0.01, rng.gauss(0.4, 0.03))
        rows += [(f"c{i}", "Pseudomonas", p), (f"c{i}", "Bg1", 1 - p)]
    return rows


def test_log_ratio_space(spark, tmp_path):
    rows = endemic(random.Random(3), 15) + [("clean", "Pseudomonas", 0.41), ("clean", "Bg1", 0.59), ("outbreak", "Pseudomonas", 0.3), ("outbreak", "Vibrio", 0.35), ("outbreak", "Bg1", 0.35)]
    counts = spark.createDataFrame([(s, t, 1e6 * v) for s, t, v in rows], "sample string, taxon string, reads double")
    config = Config(space="clr", with_network=False, trees=5, min_prevalence=0.0)
    out = analyse(spark, counts, config)
    got = {r["sample"]: r for r in out["scores"].collect()}
    assert out["baseline_tier"] == "self" and out["space"] == "clr"
    assert got["clean"]["level"] == "LOW" and got["outbreak"]["score"] > got["clean"]["score"] and got["outbreak"]["driver"] == "Vibrio"
    baseline.save(out["baseline"], str(tmp_path), "mill")
    frozen = baseline.load(spark, str(tmp_path), "mill")
    assert baseline.space_of(frozen) == "clr"
    with pytest.raises(ValueError, match="space"):
        baseline.save(out["baseline"], str(tmp_path), "mill", space="relative")
    again = analyse(spark, counts, Config(with_network=False, trees=5, min_prevalence=0.0), frozen=frozen)
    assert again["space"] == "clr"
    assert {r["sample"]: round(r["score"], 9) for r in again["scores"].collect()} == {s: round(r["score"], 9) for s, r in got.items()}
    rel = abundance.normalized(counts)
    wide = np.log(np.array([[{t: v for s, t, v in rows if s == x}.get(t, 0.0) for t in ("Bg1", "Pseudomonas", "Vibrio")] for x in sorted({r[0] for r in rows})]) + 1e-6)
    wide -= wide.mean(1, keepdims=True)
    fitted = {r["taxon"]: (r["median"], r["scale"]) for r in baseline.fit_in(rel, "clr").collect()}
    for k, t in enumerate(("Bg1", "Pseudomonas", "Vibrio")):
        m = np.median(wide[:, k])
        assert fitted[t] == pytest.approx((m, max(1.4826 * np.median(np.abs(wide[:, k] - m)), 1e-3)))
    with pytest.raises(ValueError, match="unknown space"):
        baseline.fit_in(rel, "other")


def test_history_by_site_and_window(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"))
    empty = spark.createDataFrame([], "site string, risk_score double")
    for i in range(12):
        rows = [("mill", "Bg", 0.8 if i == 11 else 1.0), ("port", "Vibrio", 0.5), ("port", "Bg", 0.5)] + ([("mill", "Vibrio", 0.2)] if i == 11 else [])
        history.record({"run_date": date(2026, 1, 1) + timedelta(i), "run_ts": datetime(2026, 1, 1) + timedelta(i)}, empty, spark.createDataFrame(rows, "site string, taxon string, rel_abund double"))
    mill = spark.createDataFrame([("mill",)], "site string")
    assert history.abundance_columns(sites=mill).select("sample").distinct().count() == 12
    assert history.abundance_columns(5, ["mill", "port"]).select("sample").distinct().count() == 10
    counts = spark.createDataFrame([("mill", "Vibrio", 200.0), ("mill", "Bg", 800.0)], "sample string, taxon string, reads double")
    out = analyse(spark, counts, Config(with_network=False, trees=5, min_prevalence=0.0), history)
    assert out["baseline_tier"] == "rolling"
    assert {r["taxon"]: r["median"] for r in out["baseline"].collect()} == {"Bg": 1.0, "Vibrio": 0.0}
    assert out["scores"].first()["driver"] == "Vibrio" and out["scores"].first()["score"] > 0.6


def test_prior_document(spark, tmp_path):
    path = tmp_path / "prior.json"
    path.write_text(json.dumps({"version": 2, "median": {"A": 0.1, "B": 0.2}, "scale": {"A": 0.01}, "taxa": ["A", "B"]}))
    base = baseline.load_document(spark, str(path))
    assert sorted(map(tuple, base.collect())) == [("A", 0.1, 0.01, "relative"), ("B", 0.2, 1e-3, "relative")]
    assert baseline.resolve(spark.createDataFrame([("s", "A", 1.0)], "sample string, taxon string, rel double"), prior=base)[0] == "prior"


def test_lineages_come_from_species_at_genus_rank(spark, tmp_path, capsys):
    from tidewatch.cli import run_path

    species = dims.lineages(spark).select("species").first()["species"]
    genus = species.split()[0]
    for s in ("a", "b"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{s}.report").write_text(f"60.00\t600\t600\tG\t1\t  {genus}\n40.00\t400\t400\tG\t2\t  Bacteroides\n90.00\t900\t900\tS\t3\t    {species}\n10.00\t100\t100\tS\t4\t    Bacteroides ovatus\n")
    got = run_path(spark, str(tmp_path / "in"), str(tmp_path / "out"), Config(with_network=False, trees=5))
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert got["report"].endswith("report.json")
    assert species in json.dumps(report["samples"])
    capsys.readouterr()
    rel = abundance.normalized(spark.createDataFrame([("a", species, 9.0), ("a", "x y", 1.0)], "sample string, taxon string, reads double"))
    assert scoring.annotate_lineages(rel, dims.lineages(spark)).select(F.round("rel", 3).alias("r")).first()["r"] == 0.9
