import gzip

import pytest

from tidewatch.operators.history import History
from tidewatch.plans.run import Config, analyse
from tidewatch.sinks import outputs
from tidewatch.sources import reports
from tidewatch.streaming.watch import watch

KRAKEN = "10.00\t400\t400\tG\t561\t  Escherichia\n20.00\t200\t200\tG\t816\t  Bacteroides\n30.00\t380\t380\tS\t562\t    Escherichia coli\nbad\n"
BRACKEN = "name\ttaxonomy_id\ttaxonomy_lvl\tkraken_assigned_reads\tadded_reads\tnew_est_reads\tfraction_total_reads\nEscherichia\t561\tG\t4000\t200\t4200\t0.6\nBacteroides\t816\tG\t2000\t100\t2100\t0.3\nEscherichia coli\t562\tS\t3900\t50\t3950\t0.5\n"
METAPHLAN = "#v\n#clade_name\tNCBI_tax_id\trelative_abundance\tadditional\nk__B|g__Escherichia\t1\t45.0\t\nk__B|g__Escherichia|s__Escherichia_coli\t1\t30.0\t\nk__B|g__Bacteroides\t2\t55.0\t\n"


@pytest.fixture
def folder(tmp_path):
    for name, text in (("a.report", KRAKEN), ("b.report", BRACKEN), ("c.report", METAPHLAN)):
        (tmp_path / name).write_text(text)
    return tmp_path


def as_dict(df):
    return {(r["sample"], r["taxon"]): r["reads"] for r in df.collect()}


def test_formats_are_told_apart(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r["format"] for r in reports.formats(reports.lines(spark, f"{folder}/*.report")).collect()}
    assert got == {"a.report": "kraken2", "b.report": "bracken", "c.report": "metaphlan"}


def test_reports_of_all_formats(spark, folder):
    got = as_dict(reports.report_directory(spark, str(folder)))
    assert got == {("a", "Escherichia"): 400, ("a", "Bacteroides"): 200, ("b", "Escherichia"): 4200, ("b", "Bacteroides"): 2100, ("c", "Escherichia"): 45, ("c", "Bacteroides"): 55}
    assert as_dict(reports.report_directory(spark, str(folder), "S"))[("c", "Escherichia_coli")] == 30
    with pytest.raises(FileNotFoundError):
        reports.report_directory(spark, str(folder / "none"))


def test_matrix_both_ways(spark, tmp_path):
    (tmp_path / "m.csv").write_text("taxon,s1,s2\nA,1,2\nB,3,0\n")
    (tmp_path / "t.csv").write_text("sample,A,B\ns1,1,3\ns2,2,0\n")
    assert as_dict(reports.count_matrix(spark, str(tmp_path / "m.csv"))) == as_dict(reports.count_matrix(spark, str(tmp_path / "t.csv"), transpose=True))


def test_sequences(spark, tmp_path):
    body = "".join(f"@r{i}\n{'ACGT' * 10}\n+\n{'I' * 40}\n" for i in range(5))
    (tmp_path / "s1_1.fastq").write_text(body)
    with gzip.open(tmp_path / "s1_2.fastq.gz", "wt") as f:
        f.write(body)
    (tmp_path / "x.fasta").write_text(f">c1 first\n{'ACGT' * 50}\n{'ACGT' * 50}\n>c2\n{'A' * 90}\n")
    reads = reports.fastq(spark, [str(tmp_path / "s1_1.fastq"), str(tmp_path / "s1_2.fastq.gz")])
    assert reads.count() == 10 and {r["sample"] for r in reads.collect()} == {"s1"}
    fa = reports.fasta(spark, str(tmp_path / "x.fasta"))
    assert {(r["name"], len(r["seq"])) for r in fa.collect()} == {("c1", 400), ("c2", 90)}
    cut = reports.windows(fa).collect()
    assert sum(r["read_no"] == 1 for r in cut) == len(range(0, 251, 75)) and {len(r["seq"]) for r in cut} == {150, 90}
    assert reports.subsample(reads, 3).count() == 3 and reports.subsample(reads, 100).count() == 10
    got = reports.ingest(spark, str(tmp_path))
    assert got.capabilities == {"reads"}


def test_history_and_analysis(spark, tmp_path):
    from tidewatch.synth import scenario

    rows, _ = scenario("high_cholera", 1)
    counts = spark.createDataFrame([r[1:] for r in rows], "sample string, taxon string, reads double")
    history = History(spark, str(tmp_path / "h"), "org")
    assert history.run_count() == 0
    from datetime import date, datetime

    ids = []
    for day in range(1, 4):
        out = analyse(spark, counts, Config(trees=10, with_network=day == 3, scorer="absolute"))
        scores = out["scores"].select("sample", "score", "level").withColumnsRenamed({"sample": "site", "score": "risk_score", "level": "risk_level"})
        rel = out["rel"].selectExpr("sample site", "taxon", "rel rel_abund")
        ids.append(history.record({"run_date": date(2026, 1, day), "run_ts": datetime(2026, 1, 5 - day)}, scores, rel))
    assert ids == sorted(set(ids))
    assert history.run_count() == 3 and history.sites().count() == 8
    assert History(spark, str(tmp_path / "h"), "other").run_count() == 0
    line = history.series(site="WW_site_01", last=2)
    assert [r["t"]["run_date"].day for r in line.orderBy("t").collect()] == [2, 3]
    assert history.abundance_columns(2).select("sample").distinct().count() == 16
    full = analyse(spark, counts, Config(trees=10, with_network=False), history)
    assert full["baseline_tier"] == "rolling" and full["cusum"].count() == 8
    document = outputs.report_document(outputs.report_rows(full["scores"], full["detected"], full["resistance"]), {"run": 1}).first()["json"]
    assert '"Vibrio"' in document and '"summary"' in document
    assert outputs.csv_rows(outputs.report_rows(full["scores"], full["detected"], full["resistance"])).where("top_pathogen = 'Vibrio'").count() == 8
    assert outputs.csv_rows(full["report"]).columns == list(outputs.EXPORT)
    rows = {r["sample"]: r for r in full["report"].collect()}
    assert all(r["temporal"]["cusum"] is not None and r["temporal"]["trend"] for r in rows.values())
    assert full["alerts"].columns == ["sample", "level", "score", "reasons"]
    none = analyse(spark, counts, Config(trees=10, with_network=False, scorer="absolute"))
    assert none["report"].first()["temporal"]["cusum"] is None


def test_manifest_tells_tampering(spark, folder):
    made = outputs.manifest(spark, f"{folder}/*.report", {"rank": "G"}, {"n": 1})
    assert outputs.verify(spark, made, {"n": 1})["all_passed"]
    (folder / "a.report").write_text("x")
    (folder / "b.report").unlink()
    got = outputs.verify(spark, made, {"n": 1})
    assert not got["all_passed"] and not got["a.report"] and not got["b.report"] and got["c.report"]


def test_watch_marks_only_success(spark, folder, tmp_path):
    seen = []

    def process(path, lines):
        seen.append(path.rsplit("/", 1)[1])
        if path.endswith("b.report") and len(seen) < 4:
            raise RuntimeError("first time")
        assert lines.count() > 0

    state = str(tmp_path / "state")
    watch(spark, str(folder), state, process, "*.report").awaitTermination()
    assert sorted(seen) == ["a.report", "b.report", "c.report"]
    (folder / "d.report").write_text(KRAKEN)
    watch(spark, str(folder), state, process, "*.report").awaitTermination()
    assert sorted(seen[3:]) == ["b.report", "d.report"]
    log = spark.read.parquet(f"{state}/processed").where("not ok").collect()
    assert [r["error"] for r in log] == ["RuntimeError: first time"]
