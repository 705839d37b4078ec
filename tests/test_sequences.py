"""Sequence files in byte ranges against a plain pass over their lines."""

import gzip
import random
import warnings

import pytest

from tidewatch.sources import reports, sequences


def plain_fastq(text):
    lines = text.split("\n")
    return [lines[i].strip() for i in range(1, len(lines), 4) if i < len(lines) - 1 or lines[i]]


def some_fastq(rng, n):
    letters = lambda k: "".join(rng.choice("ACGTN") for _ in range(k))
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 5, 30, 400]) if i % 7 else 20_000
        quality = "".join(rng.choice("@+I>#") for _ in range(k))
        out.append(f"@r{i} x\n{letters(k)}\n+{rng.choice(['', 'r'])}\n{quality}\n")
    return "".join(out)


@pytest.mark.parametrize("size", [1, 37, 1000, 20_001, 1 << 20])
def test_fastq_ranges_give_every_read_once(tmp_path, size):
    rng = random.Random(size)
    text = some_fastq(rng, 12 if size == 1 else 60)
    if size == 1:
        text = text[:3000]
    path = tmp_path / "a.fastq"
    path.write_text(text)
    reader = sequences.SequenceReader({"paths": f'["{path}"]', "kind": "fastq", "rangeBytes": str(size)})
    parts = reader.partitions()
    assert len(parts) == -(-len(text) // size)
    got = [(b, r) for p in parts for b in sequences.SequenceReader.read(sequences.SequenceReader({"paths": "[]", "kind": "fastq"}), p) for r in b.to_pylist()]
    assert [r["seq"] for _, r in got] == plain_fastq(text)
    assert all(text.encode()[r["offset"] : r["offset"] + 1] == b"@" for _, r in got)


def test_fasta_ranges(tmp_path):
    rng = random.Random(3)
    text = "ACGT\nAC\n" + "".join(f">c{i} name {i}\r\n" + "".join("".join(rng.choice("ACGT") for _ in range(rng.randrange(60))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(rng.randrange(6))) for i in range(80))
    want, name, parts = [], "", []
    for line in [*text.split("\n"), ">"]:
        line = line.strip()
        if line.startswith(">"):
            if "".join(parts):
                want.append((name, "".join(parts)))
            name, parts = line[1:], []
        else:
            parts.append(line)
    path = tmp_path / "a.fa"
    path.write_bytes(text.encode())
    for size in (1, 50, 777, 1 << 20):
        reader = sequences.SequenceReader({"paths": f'["{path}"]', "kind": "fasta", "rangeBytes": str(size)})
        got = [(r["name"], r["seq"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert got == want


def test_readers(spark, tmp_path):
    text = some_fastq(random.Random(1), 40)
    (tmp_path / "s_R1.fastq").write_text(text)
    with gzip.open(tmp_path / "s_R2.fastq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "none.fastq").write_text("")
    (tmp_path / "cut.fastq").write_text("@a\nAC\n+\nII\n@b\nGT")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        reads = reports.fastq(spark, f"{tmp_path}/*", range_bytes=5000)
    assert any("gzipped" in str(w.message) for w in said)
    rows = reads.collect()
    want = plain_fastq(text)
    assert sorted((r["read_no"], r["seq"]) for r in rows if r["sample"] == "s") == sorted(2 * list(enumerate(want)))
    assert sorted((r["read_no"], r["seq"]) for r in rows if r["sample"] == "cut") == [(0, "AC"), (1, "GT")]
    assert {r["sample"] for r in rows} == {"s", "cut"}
    assert sequences.records(spark, f"{tmp_path}/s_R1.fastq", "fastq", 5000).rdd.getNumPartitions() == -(-len(text) // 5000)
    offsets = reports.fastq(spark, f"{tmp_path}/s_R1.fastq", numbered=False, range_bytes=5000).orderBy("read_no").collect()
    assert [r["seq"] for r in offsets] == want
    assert reports.fastq(spark, f"{tmp_path}/none.fastq").collect() == []
    with pytest.raises(FileNotFoundError):
        reports.fastq(spark, f"{tmp_path}/absent.fastq")


def test_windows_up_to_a_number(spark):
    reads = spark.createDataFrame([("a", 0, "x" * 300), ("a", 1, "y" * 40), ("a", 2, "z" * 400), ("b", 5, "w" * 150)], "sample string, read_no long, seq string")
    every = sorted(map(tuple, reports.windows(reads).collect()))
    for most in (1, 3, 4, 6, 100):
        own = {s: [r for r in every if r[0] == s][:most] for s in "ab"}
        assert sorted(map(tuple, reports.windows(reads, most=most).collect())) == own["a"] + own["b"]


def test_empty_report_is_an_error(spark, tmp_path):
    (tmp_path / "a.report").write_text("10.00\t400\t400\tG\t561\t  Escherichia\n")
    (tmp_path / "b.report").write_text("\n \n")
    with pytest.raises(Exception, match="empty report"):
        reports.reports(spark, f"{tmp_path}/*.report").collect()


def test_sample_records(spark, tmp_path):
    """Entities, CDATA, nesting, repeated and empty tags; broken records; files divided anywhere."""
    records = [f'<SAMPLE accession="S{i}" alias="x"><TITLE>a &amp; b</TITLE><SAMPLE_ATTRIBUTES><SAMPLE_ATTRIBUTE><TAG> geo </TAG><VALUE>USA: &lt;Ohio&gt; {i}</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>note</TAG><VALUE>x<![CDATA[ <b> & ]]>y</VALUE></SAMPLE_ATTRIBUTE>\n<SAMPLE_ATTRIBUTE><TAG>geo</TAG><VALUE>later</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>none</TAG><VALUE/></SAMPLE_ATTRIBUTE></SAMPLE_ATTRIBUTES></SAMPLE>' for i in range(300)]
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><SAMPLE_SET>\n" + "\n".join(records) + '<SAMPLE accession="BAD"><TAG>x</SAMPLE></SAMPLE_SET>')
    (tmp_path / "b.xml").write_text('<BioSampleSet><BioSample id="1" accession="B1"><Attributes><Attribute attribute_name="date" x="1">2026<i>-01</i></Attribute></Attributes></BioSample><BioSample><Attribute attribute_name="q">1</Attribute></BioSample></BioSampleSet>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = reports.sample_attributes(spark, str(tmp_path))
        rows = df.collect()
        assert df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r["accession"]: r["attributes"] for r in rows}
    assert len(rows) == len(got) == 302 and got["BAD"] is None and got["B1"] == {"date": "2026-01"}
    assert got["S7"] == {"geo": "USA: <Ohio> 7", "note": "x <b> & y", "none": ""}
