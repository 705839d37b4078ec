"""Temporal signals, alerts, records, replays, saved baselines, storage, the benchmark family and operators that had no test."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import synth
from tidewatch.cli import main
from tidewatch.functions import columns as C
from tidewatch.operators import abundance, baseline, cluster, graph, metrics, novelty, ordered, planning, scoring, series, stats, temporal
from tidewatch.operators.history import History
from tidewatch.plans.run import Config, replay
from tidewatch.sinks import outputs
from tidewatch.sources import dims, reports
from tidewatch.streaming.watch import first_runs, running_cusum

KRAKEN = "{a:.2f}\t{n}\t{n}\tG\t561\t  Escherichia\n20.00\t2000\t2000\tG\t816\t  Bacteroides\n30.00\t3800\t3800\tG\t590\t  Salmonella\n30.00\t3800\t3800\tG\t286\t  Pseudomonas\n"


def line_of(spark, sites):
    return spark.createDataFrame([(s, i, float(x)) for s, xs in sites.items() for i, x in enumerate(xs)], "site string, t int, x double")


def test_temporal_signals_and_alerts(spark):
    rng = np.random.default_rng(0)
    calm = rng.normal(0.3, 0.01, 17)
    sites = {"calm": calm, "jump": [*calm[:-1], 0.6], "rise": np.linspace(0.1, 0.5, 17), "new": [0.4]}
    out = temporal.temporal_signals(line_of(spark, sites))
    flags = {r["site"]: r["flags"] for r in out.collect()}
    assert flags["calm"] == [] and {"baseline", "farrington"} <= set(flags["jump"]) and "trend" in flags["rise"]
    scores = spark.createDataFrame([(s, "LOW", 0.2) for s in sites] + [("loud", "HIGH", 0.7)], "sample string, level string, score double")
    fired = scoring.alerts(scores.withColumns({"novelty": F.lit(0.0), "cusum_alert": F.lit(False), "z_score": F.lit(0.0)}))
    merged = {r["sample"]: r["reasons"] for r in temporal.merged_alerts(fired, scores, out).collect()}
    assert set(merged) >= {"jump", "rise", "loud"} and "calm" not in merged and merged["rise"][0].startswith("temporal")
    rows = {r["sample"]: r["temporal"] for r in temporal.with_temporal(scores, out).collect()}
    assert rows["loud"]["cusum"] is None and rows["jump"]["farrington_alarm"] and rows["rise"]["trend"] == "increasing"


def test_warmup_then_detection(spark):
    past = [100, 105, 98, 102, 99, 101, 97, 103, 100, 104]
    out = series.aberrations(line_of(spark, {"a": [*past, 190]}), window=None, scale=1.0, warmup=True).orderBy("t").collect()
    assert [r["note"] for r in out[:4]] == ["warmup"] * 4 and out[0]["expected"] is None and out[-1]["alarm"] and out[-1]["note"] == "ok"
    assert series.aberration([100, 102], 300)["note"].startswith("insufficient")


def test_batches_equal_single_fits():
    rng = np.random.default_rng(1)
    y = rng.poisson(20, (40, 9)).astype(float)
    y[3] = 7
    y[4, 2] = 0
    now = rng.poisson(25, 40).astype(float)
    batch = series.aberrations_of(y, now)
    for i in range(40):
        one = series.aberration(y[i].tolist(), now[i])
        assert one["alarm"] == batch["alarm"][i] and one["expected"] == pytest.approx(batch["expected"][i]) and one["threshold"] == pytest.approx(batch["threshold"][i])


def test_running_sums_by_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), int(n)) for x, n in zip(rng.integers(0, 50, 300), rng.integers(0, 9, 300), strict=True)]
    keys = sorted({x for x, _ in rows})
    df = spark.createDataFrame(rows, "k double, n int").groupBy("k").agg(F.sum("n").alias("n"))
    got = {r["k"]: r["s"] for r in ordered.running(df, "k", {"s": F.col("n")}).collect()}
    assert got == {k: sum(n for x, n in rows if x >= k) for k in keys}
    p = rng.uniform(0, 1, 200) ** 3
    want = np.minimum(1, np.minimum.accumulate((np.sort(p) * 200 / np.arange(1, 201))[::-1])[::-1])
    adjusted = {r["p"]: r["p_adj"] for r in stats.adjusted(spark.createDataFrame([(float(x),) for x in p], "p double")).collect()}
    assert np.allclose([adjusted[x] for x in np.sort(p)], want)


@pytest.mark.parametrize("columns", [3, 256])
def test_pair_sums_by_blocks(spark, columns):
    rng = np.random.default_rng(3)
    m = rng.uniform(size=(40, 11))
    df = spark.createDataFrame([(f"r{i}", f"c{j:02d}", float(m[i, j])) for i in range(40) for j in range(11)], "r string, c string, x double")
    got = {(r["a"], r["b"]): r for r in stats.pair_sums(df, "r", "c", "x", ("product", "apart", "both"), columns, 7).collect()}
    assert len(got) == 55
    for (a, b), r in got.items():
        x, y = m[:, int(a[1:])], m[:, int(b[1:])]
        assert a < b and r["product"] == pytest.approx(x @ y) and r["apart"] == pytest.approx(np.abs(x - y).sum()) and r["both"] == pytest.approx((x + y).sum())


def test_profiles_and_vocabulary(spark):
    rows = [("s", 0, "ACGTNACG"), ("s", 1, "ac"), ("s", 2, None), ("u", 0, "TTTTTT")]
    got = {(r["sample"], r["kmer"]): r["freq"] for r in novelty.kmer_profiles(spark.createDataFrame(rows, "sample string, read_no int, seq string"), 3).collect()}
    assert got == {("s", "ACG"): pytest.approx(2 / 3 / 3), ("s", "CGT"): pytest.approx(1 / 3 / 3), ("u", "TTT"): 1.0}
    words = novelty.kmer_vocabulary(spark, 3).orderBy("index").collect()
    assert [r["kmer"] for r in words] == sorted(r["kmer"] for r in words) and len(words) == 64


def test_replay_records_each_run(spark, tmp_path):
    points = []
    for day in range(1, 4):
        path = tmp_path / f"{day}.report"
        path.write_text(KRAKEN.format(a=10.0, n=400 * day))
        points.append(("mill", f"2026-01-0{day}", str(path)))
    history = History(spark, str(tmp_path / "h"))
    done = replay(spark, [*reversed(points), ("mill", "2026-01-09", str(tmp_path / "none"))], history, Config(with_network=False, trees=5))
    assert [r["run_id"] is None for r in done.orderBy("date").collect()] == [False, False, False, True]
    line = history.series(site="mill").orderBy("t").collect()
    assert [r["t"]["run_date"] for r in line] == [date(2026, 1, d) for d in (1, 2, 3)]
    assert history.taxon_series("Salmonella").count() == 3


def test_command_line_run_verify_and_watch(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i, n in enumerate((400, 900)):
        (tmp_path / "in" / f"s{i}.report").write_text(KRAKEN.format(a=10.0, n=n))
    (tmp_path / "c.yaml").write_text("graph:\n  spearman_threshold: 0.5\nrisk:\n  alert_threshold: 0.7\nalerting:\n  email:\n    enabled: true\n")
    config = Config.read(str(tmp_path / "c.yaml"))
    assert (config.rho_threshold, config.min_score, config.alert_email, config.alert_slack) == (0.5, 0.7, True, False)
    args = ["run", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--history", str(tmp_path / "h"), "--no-network", "--run-date", "2026-02-01", "--settings", str(tmp_path / "c.yaml")]
    assert main(args) == 0
    assert History(spark, str(tmp_path / "h")).run_count() == 1
    assert main(["verify", str(tmp_path / "out/manifest.json"), str(tmp_path / "out/report.json")]) == 0
    report = json.loads((tmp_path / "out/report.json").read_text())
    assert len(report["samples"]) == 2 and "temporal" in report["samples"][0]
    (tmp_path / "out/report.json").write_text("{}")
    assert main(["verify", str(tmp_path / "out/manifest.json"), str(tmp_path / "out/report.json")]) == 1
    assert main(["lineage", str(tmp_path / "in" / "s0.report")]) == 0
    assert main(["watch", str(tmp_path / "in"), "--out", str(tmp_path / "w"), "--no-network"]) == 0
    assert (tmp_path / "w" / "s0.report" / "report.json").exists()
    capsys.readouterr()


def test_saved_baselines_and_tiers(spark, tmp_path):
    base = spark.createDataFrame([("A", 0.1, 0.01), ("B", 0.2, 0.02)], "taxon string, median double, scale double")
    assert baseline.load(spark, str(tmp_path), "mill") is None
    baseline.save(base, str(tmp_path), "mill")
    assert sorted(map(tuple, baseline.load(spark, str(tmp_path), "mill").select("taxon", "median", "scale").collect())) == [("A", 0.1, 0.01), ("B", 0.2, 0.02)]
    with pytest.raises(ValueError, match="not a name"):
        baseline.save(base, str(tmp_path), "../x")
    values = spark.createDataFrame([("s1", "A", 0.5), ("s2", "A", 0.7)], "sample string, taxon string, rel double")
    control = spark.createDataFrame([("s1",)], "sample string")
    past = spark.createDataFrame([(f"h{i}", "A", 0.4) for i in range(8)], "sample string, taxon string, rel double")
    assert [baseline.resolve(values, *args)[0] for args in ((control,), (None, past), (None, past.where("sample < 'h3'"), base), ())] == ["controls", "rolling", "prior", "self"]
    ratios = {(r["sample"], r["taxon"]): r["clr"] for r in baseline.sample_log_ratios(values.withColumn("taxon", F.lit("C")), base).collect()}
    logs = np.log(np.array([0.5, 0, 0]) + 1e-6)
    assert ratios["s1", "C"] == pytest.approx(logs[0] - logs.mean())


def test_storage_and_channels(spark, tmp_path):
    store = outputs.Storage(spark, str(tmp_path))
    assert store.latest("latest") is None
    store.put_bytes("runs/1/report.json", b"{}")
    store.point("latest", "runs/1/report.json")
    assert store.exists("runs/1/report.json") and store.latest("latest") == b"{}"
    for key in ("../x", "/etc/x", "a/../../x", "", "file:/x"):
        with pytest.raises(ValueError, match="leaves the root"):
            store.put_bytes(key, b"")
    alerts = spark.createDataFrame([("a", "HIGH", 0.7, ["level HIGH"])], "sample string, level string, score double, reasons array<string>")

    def broken(rows):
        raise OSError

    assert outputs.dispatch(alerts, {"log": lambda rows: len(rows) == 1, "broken": broken, "mail": outputs.mail_channel("h", 25, "", "", "x@y", []), "hook": outputs.hook_channel("")}) == {"log": True, "broken": False, "mail": False, "hook": False}
    assert outputs.dispatch(alerts.where("false"), {"log": broken}) == {}
    rows = [{"sample": "a<b", "level": "HIGH", "score": 0.7, "reasons": ["r"]}]
    assert "a&lt;b" in outputs.mail_message(rows, "x@y", ["z@y"]).as_string() and len(outputs.hook_body(rows)["blocks"]) == 3
    assert "<td>a</td>" in outputs.write_html(alerts)
    old = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "site string, lat double")
    new = spark.createDataFrame([("y", None), ("z", 3.0)], "site string, lat double")
    assert sorted(map(tuple, outputs.merge_locations(old, new).collect())) == [("x", 1.0), ("y", 2.0), ("z", 3.0)]
    outputs.metadata_tsv(spark.createDataFrame([("x", {"b": "1"}), ("y", {"a": "2"})], "site string, attributes map<string,string>"), str(tmp_path / "m"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).fillna("").collect())) == [("x", "", "1"), ("y", "2", "")]


def test_benchmark_family(spark):
    for name in synth.SCENARIOS:
        rows, _ = synth.scenario(name, 3)
        assert all(r[3] >= 0 for r in rows)
    out = {r["scenario"]: r for r in synth.benchmark(spark).collect()}
    assert all(out[s]["f1"] == 1.0 for s in ("high_cholera", "critical_yersinia", "multi_pathogen", "mock_community")) and out["negative_controls"]["specificity"] == 1.0
    summary = synth.validation(spark).first()
    assert 0.8 < summary["auroc"] <= 1.0
    rows = {(r["method"], r["measure"]): r["mean"] for r in synth.multi_seed(spark, seeds=2).collect()}
    assert rows["full", "f1"] > 0.9 and rows["threshold", "specificity"] < rows["full", "specificity"]
    sweep = {r["level"]: r["mean"] for r in synth.abundance_sweep(spark, (0.01, 0.08), seeds=2).collect()}
    assert sweep[0.01] < 0.2 and sweep[0.08] > 0.8
    gone = {r["left_out"]: r["f1"] for r in synth.ablation(spark, full=False).collect()}
    assert gone["none"] > 0.9


def test_a_cohort_with_novelty_and_network(spark):
    scored = synth.scenario_scores(spark, [synth.correlated(0.05, 1)], full=True, trees=20)
    assert scored.where("novelty > 0").count() > 0 and scored.where("score is null").count() == 0


def test_communities_and_stability(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        u, v = rng.normal(size=2)
        rows += [(f"s{i}", f"a{j}", float(u + rng.normal(0, 0.1))) for j in range(4)] + [(f"s{i}", f"b{j}", float(v + rng.normal(0, 0.1))) for j in range(4)]
    values = spark.createDataFrame(rows, "sample string, taxon string, clr double")
    runs = graph.bootstrap_stability(values, reps=6)
    assert runs.select("rep").distinct().count() == 6
    labels = spark.createDataFrame([(f"{x}{j}", i) for i, x in enumerate("ab") for j in range(4)], "taxon string, label int")
    got = {r["together"]: r["probability"] for r in graph.pair_stability(runs, labels).collect()}
    assert got[True] > 0.9 and got[False] < 0.1
    edges = stats.cooccurrence(values)
    assert edges.count() == 12
    adj = graph.adjacency([("a", "b"), ("c", "d")], list("abcd"))
    assert not graph.degenerate(adj, [0, 0, 1, 1]) and graph.degenerate(np.ones((4, 4)) - np.eye(4), [0, 0, 1, 1])


def test_dendrogram_profiles_and_codes(spark):
    pairs = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.5), ("b", "c", 0.7)], "a string, b string, distance double")
    tree = cluster.dendrogram(pairs).orderBy("step").collect()
    assert [(r["distance"], r["size"]) for r in tree] == [(0.1, 2), (pytest.approx(0.6), 3)]
    values = spark.createDataFrame([("s1", "T", 0.2), ("s2", "T", 0.4), ("s3", "T", 0.9)], "sample string, taxon string, rel double")
    groups = spark.createDataFrame([("s1", 0), ("s2", 0), ("s3", 1)], "sample string, label int")
    got = stats.cluster_profiles(values, groups).first()
    assert got["cluster_means"] == {0: 0.3, 1: 0.9} and got["fold_change"] == pytest.approx(3)
    vectors = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5 * 0.1), 0.0]) for i in range(10)], "vec_id int, v array<double>")
    codes = novelty.fit_codebook(vectors, 2, 4)
    assert sorted(round(r["centre"][0], 1) for r in codes.collect()) == [0.2, 10.2]
    assert {r["is_novel"] for r in novelty.embedding_novelty(spark.createDataFrame([(0.01,), (0.2,)], "loss double")).collect()} == {True, False}


def test_small_operators(spark):
    rel = spark.createDataFrame([("a", "Vibrio x", 0.02), ("a", "Other", 0.98), ("b", "Other", 1.0), ("c", "Salmonella enterica", 0.5)], "sample string, taxon string, rel double")
    assert {r["sample"]: r["score"] for r in scoring.threshold_classifier(rel, dims.pathogens(spark)).collect()} == {"a": 0.65, "b": 0.1, "c": 0.65}
    assert [r["species"] for r in scoring.annotate_lineages(rel, dims.lineages(spark)).collect()] == ["Salmonella enterica"]
    votes = spark.createDataFrame([("x", 2), ("x", 1), ("x", 2), ("y", 3), ("y", 1)], "g string, v int")
    assert {r["g"]: r["v"] for r in metrics.majority(votes, ["g"], "v").collect()} == {"x": 2, "y": 1}
    names = spark.createDataFrame([("cleaned_SRR123_1",), ("nothing",)], "n string").select(C.accession(F.col("n")).alias("a")).collect()
    assert [r["a"] for r in names] == ["SRR123", None]
    label = spark.createDataFrame([("USA: Ohio", "2026"), (None, None)], "g string, d string").select(C.place_label(F.col("g"), F.col("d"), F.lit("acc")).alias("l")).collect()
    assert [r["l"] for r in label] == ["Ohio, (2026)", "acc"]
    plan = planning.Plan(0.001)
    rows = planning.sweep(spark, plan).orderBy("depth").collect()
    assert len(rows) == 20 and rows[-1]["depth"] == plan.max_depth
    assert all(r["sensitivity"] == pytest.approx(plan.sensitivity(r["depth"])) and r["cost"] == pytest.approx(plan.cost(r["depth"])) for r in rows)


def test_files_beside_reports(spark, tmp_path):
    (tmp_path / "x.csv").write_text("site,date,value\na,2026-01-01,2.5\n")
    assert tuple(reports.external_signals(spark, str(tmp_path / "x.csv")).first()) == ("a", date(2026, 1, 1), 2.5, "external")
    (tmp_path / "bad.csv").write_text("site,value\na,1\n")
    with pytest.raises(ValueError, match="missing"):
        reports.external_signals(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "loc.json").write_text(json.dumps({"_note": "x", "a": {"lat": 1.5, "lon": 2.0, "label": "L"}}))
    assert reports.site_locations(spark, str(tmp_path / "loc.json")).select("site", "lat", "label").first() == ("a", 1.5, "L")
    runs = spark.createDataFrame([(f"P-26010{i}", "m", f"r{i}") for i in range(1, 6)], "sample_name string, model string, run_accession string")
    assert [r["run_accession"] for r in reports.newest_runs(runs, "P", "m", 2).collect()] == ["r4", "r5"]
    (tmp_path / "s.xml").write_text('<SET><SAMPLE accession="S1"><A><TAG>geo</TAG><VALUE>USA: Ohio</VALUE></A></SAMPLE><BioSample accession="S2"><Attribute attribute_name="date">2026</Attribute></BioSample></SET>')
    assert {r["accession"]: r["attributes"] for r in reports.sample_attributes(spark, str(tmp_path / "s.xml")).collect()} == {"S1": {"geo": "USA: Ohio"}, "S2": {"date": "2026"}}


def test_streamed_cusum(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = [*rng.normal(0, 1, 8), *rng.normal(4, 1, 6)]
    spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "site string, i int, x double").selectExpr("site", "timestamp_seconds(i * 86400) t", "x").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = running_cusum(spark.readStream.schema("site string, t timestamp, x double").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = [r["cusum_upper"] for r in spark.table("streamed").orderBy("t").collect()]
    level, want = 0.0, [0.0] * 8
    for v in x[8:]:
        level = max(0.0, level + (v - np.mean(x[:8])) / np.std(x[:8], ddof=1) - 0.5)
        want.append(level)
    assert got == pytest.approx(want)


def test_isolation_forest_finds_the_odd_one(spark):
    """Against a forest that walks each row through each tree by itself."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    x[7] += 6
    df = spark.createDataFrame([(f"s{i:02d}", f"t{j}", float(x[i, j])) for i in range(60) for j in range(5)], "sample string, taxon string, clr double")
    got = {r["sample"]: r["isolation"] for r in novelty.isolation_scores(df, trees=40, subsample=32).collect()}
    assert max(got, key=got.get) == "s07" and all(0 < v < 1 for v in got.values())
    feature, cut, left, right, path = novelty._tree(x, 5, np.random.default_rng(1))
    for row in x:
        at, depth = 0, 0
        while feature[at] >= 0:
            at, depth = (left if row[feature[at]] < cut[at] else right)[at], depth + 1
        assert depth <= 5 and path[at] >= depth
    assert novelty.isolation_scores(df.where("false")).count() == 0


def test_first_run_of_a_date(spark, tmp_path):
    rows = [("a", "2026-01-01", 1, 0.1), ("a", "2026-01-01", 2, 0.2), ("a", "2026-01-02", 90_000, 0.3), ("b", "2026-01-01", 3, 0.4)]
    spark.createDataFrame(rows, "site string, run_date string, s long, x double").selectExpr("site", "run_date", "timestamp_seconds(s) ts", "x").write.parquet(str(tmp_path / "in"))
    stream = first_runs(spark.readStream.schema("site string, run_date string, ts timestamp, x double").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("first_runs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("first_runs").select("site", "run_date").distinct().count() == spark.table("first_runs").count() == 3


def test_abundance_stays_long(spark):
    c = spark.createDataFrame([("s", "A", 3.0)], "sample string, taxon string, reads double")
    assert abundance.normalized(c).first()["rel"] == 1.0
