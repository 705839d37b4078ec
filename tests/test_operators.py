import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import abundance, baseline, cluster, graph, metrics, novelty, scoring, series, stats
from tidewatch.sources import dims


def counts_of(spark, table):
    return spark.createDataFrame([(s, t, float(v)) for t, row in table.items() for s, v in row.items()], "sample string, taxon string, reads double")


def test_rank_bump_conserves_reads(spark):
    c = counts_of(spark, {"Escherichia coli": {"s1": 1000, "s2": 900, "s3": 800, "s4": 700}, "Escherichia albertii": {"s1": 5, "s2": 0, "s3": 0, "s4": 0}, "Escherichia fergusonii": {"s1": 3, "s2": 0, "s3": 0, "s4": 1}})
    assert {r["taxon"] for r in abundance.filter_taxa(c, 0.5, 50).collect()} == {"Escherichia coli"}
    bumped = {(r["sample"], r["taxon"]): r["reads"] for r in abundance.filter_taxa(c, 0.5, 50, True).collect()}
    assert [bumped[(s, "Escherichia")] for s in ("s1", "s2", "s3", "s4")] == [8, 0, 0, 1]
    assert sum(bumped.values()) == c.agg(F.sum("reads")).first()[0]


def test_pairs_merge_only_when_both_are_there(spark):
    c = counts_of(spark, {"A": {"x_1": 3, "x_2": 4, "y_1": 5, "z": 1}})
    assert {(r["sample"], r["reads"]) for r in abundance.merge_pairs(c).collect()} == {("x", 7), ("y_1", 5), ("z", 1)}


def test_endemic_baseline_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(f"h{i}", t, float(v)) for i in range(20) for t, v in (("Pseudomonas", rng.normal(0.35, 0.05)), ("Streptococcus", rng.normal(0.05, 0.02)))]
    history = spark.createDataFrame([(s, t, max(v, 0)) for s, t, v in rows], "sample string, taxon string, rel double")
    base = baseline.fit(history)
    now = spark.createDataFrame([("endemic", "Pseudomonas", 0.36), ("event", "Vibrio", 0.40), ("event", "Pseudomonas", 0.3), ("wire", "Yersinia", 0.02), ("wire", "Pseudomonas", 0.35)], "sample string, taxon string, rel double")
    out = {r["sample"]: r for r in scoring.score_relative(now, base, dims.pathogens(spark), dims.tripwires(spark)).collect()}
    assert out["endemic"]["score"] < 0.3 and out["endemic"]["level"] == "LOW"
    assert out["event"]["level"] in ("HIGH", "CRITICAL") and out["event"]["driver"] == "Vibrio"
    assert out["wire"]["score"] >= 0.85 and out["wire"]["level"] == "CRITICAL"


def test_absolute_scores_and_recalibration(spark):
    rel = spark.createDataFrame([("y", "Yersinia", 0.2), ("m", "Vibrio", 0.15), ("m", "Salmonella", 0.1), ("m", "Klebsiella", 0.08), ("s", "Salmonella", 0.02), ("n", "Nobody", 1.0)], "sample string, taxon string, rel double")
    out = {r["sample"]: r for r in scoring.score_absolute(rel, dims.pathogens(spark)).collect()}
    assert out["y"]["direct"] == 0.85 and out["m"]["score"] >= 0.35 and out["m"]["load"] > 0.1
    assert out["s"]["level"] == "LOW" and out["n"]["score"] == 0 and out["n"]["n_detected"] == 0
    cohort = [(f"e{i}", t, v) for i in range(5) for t, v in (("Pseudomonas", 0.12), ("Streptococcus", 0.08))] + [("o", "Pseudomonas", 0.4), ("o", "Streptococcus", 0.3)]
    again = {r["sample"]: r for r in baseline.recalibrated(scoring.score_absolute(spark.createDataFrame(cohort, rel.schema), dims.pathogens(spark))).collect()}
    assert again["o"]["load_z"] >= 2 and again["o"]["score"] >= 0.6
    assert all(again[f"e{i}"]["score"] < 0.3 for i in range(5))


@pytest.mark.parametrize(("values", "current", "alarm", "slope"), [([100, 105, 98, 102, 99, 101, 97, 103, 100, 104], 102, False, None), ([100, 105, 98, 102, 99, 101, 97, 103, 100, 104], 180, True, None), ([50, 55, 62, 70, 78, 88, 99, 110, 124, 140], 155, False, 1), ([50, 55, 62, 70, 78, 88, 99, 110, 124, 140], 320, True, 1), ([100, 102], 300, True, None)])
def test_aberration(values, current, alarm, slope):
    out = series.aberration(values, current)
    assert out["alarm"] is alarm
    assert slope is None or out["trend_slope"] > 0


def test_a_past_outbreak_counts_less():
    assert series.aberration([100, 102, 98, 300, 101, 99, 103, 100, 102, 98], 120)["expected"] < 140


def test_scaled_scores():
    past = [0.10, 0.12, 0.09, 0.11, 0.10, 0.13, 0.08, 0.12]
    assert series.aberration(past, 0.45, scale=100)["alarm"] and not series.aberration(past, 0.11, scale=100)["alarm"]


def test_cusum_is_the_recursion(spark):
    rng = np.random.default_rng(3)
    x = [*rng.normal(0, 1, 10), *rng.normal(3, 1, 6)]
    out = series.cusum(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "site string, t int, x double")).orderBy("t").collect()
    m, s = np.mean(x[:8]), np.std(x[:8], ddof=1)
    up, expect = 0.0, []
    for v in x:
        up = max(0.0, up + (v - m) / s - 0.5)
        expect.append(up)
    assert [r["cusum_upper"] for r in out] == pytest.approx(expect, abs=1e-9)
    assert out[-1]["alert"] and out[-1]["streak"] >= 5


def test_series_of_few_points(spark):
    s = spark.createDataFrame([("a", 1, 0.2), ("b", 1, 0.3), ("b", 2, 0.4)], "site string, t int, x double")
    assert {r["trend"] for r in series.trends(s).collect()} == {"insufficient"}
    assert all(r["cusum_upper"] == 0 for r in series.cusum(s).collect())
    assert series.rolling_baseline(s).where("is_anomaly").count() == 0
    empty = s.where("false")
    assert series.trends(empty).count() == series.cusum(empty).count() == series.aberrations(empty).count() == 0


def test_external_signal(spark):
    s = spark.createDataFrame([("a", d, x) for d, x in (("2026-01-01", 0.1), ("2026-01-08", 0.2), ("2026-01-15", 0.4))], "site string, t string, x double")
    outside = s.select("site", "t", (10 * F.col("x") + 1).alias("value")).unionByName(spark.createDataFrame([("b", "2026-01-01", 1.0)], "site string, t string, value double"))
    out = {r["site"]: r for r in series.validate_external(s, outside).collect()}
    assert out["a"]["n_matched"] == 3 and out["a"]["r"] > 0.99 and out["a"]["concordant"]
    assert out["b"]["r"] is None and "Insufficient" in out["b"]["summary"]


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8]
    out = {r["p"]: r["p_adj"] for r in stats.adjusted(spark.createDataFrame([(x,) for x in p], "p double")).collect()}
    assert [out[x] for x in p] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.8])


def test_bray_curtis_and_outbreaks(spark):
    rows = {"A": {"Salmonella": 0.7, "Escherichia": 0.3}, "B": {"Salmonella": 0.69, "Escherichia": 0.31}, "c": {"X": 1.0}, "d": {"Y": 1.0}, "e": {"Z": 1.0}}
    rel = spark.createDataFrame([(s, t, v) for s, r in rows.items() for t, v in r.items()], "sample string, taxon string, rel double")
    d = stats.bray_curtis(abundance.dense(rel, "rel"))
    values = {(r["a"], r["b"]): r["distance"] for r in d.collect()}
    assert values[("A", "B")] == pytest.approx(0.01) and values[("c", "d")] == 1
    found = cluster.outbreak_clusters(d, spark.createDataFrame([("A",)], "sample string")).collect()
    assert found[0]["samples"] == ["A", "B"] and found[0]["contains_flagged"] and found[1]["size"] == 1


def test_merges_against_brute_force():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = {i: [i] for i in range(12)}
    for new, (a, b, dist, size) in enumerate(cluster.merges(d, "average"), 12):
        assert dist == pytest.approx(d[np.ix_(groups[a], groups[b])].mean())
        groups[new] = groups.pop(a) + groups.pop(b)
        assert len(groups[new]) == size
    two = np.concatenate([rng.normal(0, 0.1, (6, 2)), rng.normal(9, 0.1, (6, 2))])
    d2 = np.sqrt(((two[:, None] - two[None]) ** 2).sum(-1))
    labels = cluster.cut(cluster.merges(d2, "ward"), 12, clusters=2)
    assert labels == [0] * 6 + [1] * 6 and cluster.silhouette(d2, labels) > 0.9


def test_planted_blocks_are_found(spark):
    edges = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i + 1, 6)]
    out = {r["taxon"]: (r["label"], r["k"]) for r in graph.communities(spark.createDataFrame(edges, "a string, b string"), 4, 3).collect()}
    assert {k for _, k in out.values()} == {2}
    assert len({out[f"a{i}"][0] for i in range(6)}) == 1 and out["a0"][0] != out["b0"][0]


def test_a_spike_is_the_most_novel(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i}", t, float(abs(rng.normal(m, 0.02)))) for i in range(20) for t, m in (("Pseudomonas", 0.4), ("Other", 0.3), ("Acinetobacter", 0.30 if i == 0 else 0.01))]
    values = abundance.clr(spark.createDataFrame(rows, "sample string, taxon string, rel double"), "rel", 1e-6)
    out = novelty.cohort_novelty(values, trees=50).orderBy(F.desc("novelty")).first()
    assert out["sample"] == "s0"
    assert {r["novelty"] for r in novelty.cohort_novelty(values.where("sample in ('s1', 's2')")).collect()} == {0.0}


def test_kmer_shift_is_novel(spark):
    rng = np.random.default_rng(1)
    reads = [(f"b{i}", n, "".join(rng.choice(list("ATATATGC"), 120))) for i in range(12) for n in range(5)]
    new = [("q", n, "".join(rng.choice(list("GCGCGCAT"), 120))) for n in range(5)] + [("r", n, "".join(rng.choice(list("ATATATGC"), 120))) for n in range(5)]
    schema = "sample string, read_no int, seq string"
    out = {r["sample"]: r["novelty"] for r in novelty.kmer_novelty(novelty.kmer_profiles(spark.createDataFrame(new, schema), 4), novelty.kmer_profiles(spark.createDataFrame(reads, schema), 4)).collect()}
    assert out["q"] > out["r"] and out["q"] >= 0.5


def test_roc(spark):
    rows = list(zip([0.1, 0.2, 0.15, 0.8, 0.9, 0.85], [False] * 3 + [True] * 3, strict=True))
    out = metrics.roc_summary(spark.createDataFrame(rows, "score double, label boolean")).first()
    assert out["auroc"] == pytest.approx(1) and out["auprc"] == pytest.approx(1) and 0.2 < out["theta_youden"] <= 0.8
    c = metrics.confusion(spark.createDataFrame([("g", 0.1, False), ("g", 0.7, True), ("g", 0.7, False), ("g", 0.2, True), ("g", 0.9, None)], "k string, score double, label boolean"), ["k"], 0.5).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (1, 1, 1, 1)


def test_alert_rules(spark):
    report = spark.createDataFrame([("high", 0.72, "HIGH", 0.3, False, 0.0), ("low", 0.12, "LOW", 0.0, False, 0.0), ("cusum", 0.4, "MODERATE", 0.0, True, 0.0)], "sample string, score double, level string, novelty double, cusum_alert boolean, z_score double")
    assert [r["sample"] for r in scoring.alerts(report).collect()] == ["high", "cusum"]
    assert scoring.alerts(report, "CRITICAL", 0.99, fire_on_cusum=False).count() == 0
    assert [r["sample"] for r in scoring.alerts(report, "CRITICAL", 0.99, 0.25, False).collect()] == ["high"]


def test_resistance_once_per_genus(spark):
    rel = spark.createDataFrame([("a", "Pseudomonas x", 0.2), ("a", "Pseudomonas y", 0.1), ("a", "Caulobacter", 0.5), ("b", "Klebsiella", 0.25)], "sample string, taxon string, rel double")
    out = scoring.annotate_resistance(scoring.detected(rel, dims.pathogens(spark)), dims.resistance(spark)).collect()
    assert {(r["sample"], r["taxon"]) for r in out} == {("a", "Pseudomonas x"), ("b", "Klebsiella")}
    assert next(r["amr_score"] for r in out if r["sample"] == "b") > 0.7
