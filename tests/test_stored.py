"""What a run leaves: documents looked up by site, months of history read alone, page and channels."""

import json
from datetime import date, datetime

import pytest

from tidewatch.cli import main, run_path
from tidewatch.operators.history import History
from tidewatch.plans.run import Config
from tidewatch.sinks import outputs

KRAKEN = "{a:.2f}\t{n}\t{n}\tG\t561\t  Salmonella\n20.00\t2000\t2000\tG\t816\t  Bacteroides\n30.00\t3800\t3800\tG\t562\t  Prevotella\n"


@pytest.fixture
def recorded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, n in enumerate((4000, 40)):
        (tmp_path / "in" / f"s{i}.report").write_text(KRAKEN.format(a=10.0, n=n))
    sent = []

    def fails(rows):
        raise OSError("no server")

    got = run_path(spark, str(tmp_path / "in"), str(tmp_path / "out"), Config(with_network=False, trees=5, run_date="2026-02-01", min_score=0.0), str(tmp_path / "h"), channels={"kept": lambda rows: bool(sent.extend(rows) or True), "broken": fails})
    return tmp_path, got, sent


def test_lookups_after_a_run(spark, recorded, capsys):
    path, got, sent = recorded
    assert got["sent"] == {"kept": True, "broken": False} and {r["sample"] for r in sent} == {"s0", "s1"}
    assert "s0" in (path / "out/report.html").read_text()
    history = History(spark, str(path / "h"))
    report = {s["sample"]: s for s in json.loads((path / "out/report.json").read_text())["samples"]}
    found = history.pathogens("s0").collect()
    assert [(r["taxon"], r["abundance"]) for r in found] == [(p["taxon"], p["abundance"]) for p in report["s0"]["detected_pathogens"]]
    assert history.cusum("s0").first()["trend"] == report["s0"]["temporal"]["trend"]
    assert [r["genus"] for r in history.resistance("s0").collect()] == report["s0"].get("amr_genera", [])
    assert {r["site"] for r in history.members("cluster").collect()} == {"s0", "s1"}
    curve = history.curve("s1").orderBy("depth").collect()
    assert curve[0]["richness"] == 1.0 and curve[-1]["depth"] == 5840 and curve[-1]["richness"] == 3.0
    assert history.network().collect() == [] and history.pathogens("none").collect() == [] and history.pathogens("s0", 5).collect() == []
    assert History(spark, str(path / "h"), "other").pathogens("s0").collect() == []
    plan = history.documents("sample", "s0")._jdf.queryExecution().executedPlan().toString()
    assert "kind" in plan.split("PartitionFilters")[1].split("]")[0] and "run_id" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(site,s0)" in plan
    for what in ("history", "pathogens", "cusum"):
        capsys.readouterr()
        assert main(["show", what, "--history", str(path / "h"), "--site", "s0"]) == 0
        assert '"s0"' in capsys.readouterr().out


def test_the_newest_runs_read_their_months_only(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"))
    empty = spark.createDataFrame([], "site string, risk_score double")
    for month in range(1, 7):
        rows = spark.createDataFrame([("mill", "A", 0.1 * month)], "site string, taxon string, rel_abund double")
        history.record({"run_date": date(2026, month, 3), "run_ts": datetime(2026, month, 3)}, empty, rows)
    two = history.abundance_columns(2)
    assert sorted(round(r["rel"], 3) for r in two.collect()) == [0.5, 0.6]
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert any("month" in x.split("PartitionFilters")[1].split("]")[0] and "2026-05" in x for x in plan.split("\n") if "PartitionFilters" in x)
    assert len(history.table("abundances", ["2026-05", "2026-06"]).inputFiles()) >= 2
    old = spark.createDataFrame([("_selfhosted", history.newest(1)[0][0], "old", "B", 0.7)], "org_id string, run_id long, site string, taxon string, rel_abund double")
    old.write.partitionBy("org_id").parquet(f"{tmp_path}/h/abundances")
    assert {r["taxon"] for r in history.abundance_columns(2).collect()} == {"A", "B"}


def test_channels_of_settings(monkeypatch):
    monkeypatch.setenv("HOOK", "")
    config = Config.of({"alerting": {"email": {"enabled": True, "smtp_host": "h", "recipients": []}, "slack": {"enabled": False}}})
    assert set(config.alert_channels) == {"email"}
    made = outputs.channels_of({**config.alert_channels, "slack": {"webhook_env": "HOOK"}})
    assert made["email"]([{}]) is False and made["slack"]([{}]) is False
