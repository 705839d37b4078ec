"""Readers of classifier reports, count matrices, sequences and small documents, all through Spark's own sources."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import mate, read_windows
from tidewatch.operators.abundance import merge_pairs, total_reads
from tidewatch.sources import sequences

# Columns and rank prefixes of the report formats.
BRACKEN = ["name", "taxonomy_id", "taxonomy_lvl", "kraken_assigned_reads", "added_reads", "new_est_reads", "fraction_total_reads"]
RANK_PREFIX = {"F": "f__", "G": "g__", "S": "s__"}
READ_SUFFIX = r"\.(fastq|fq|fasta|fa|fna)(\.gz)?$"
PATTERNS = ["*.report", "*.bracken", "*_profile.tsv", "*.tsv", "*.txt"]


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.(fastq|fq|fasta|fa|fna))?(\.gz)?$|\.[^.]*$", "")


def lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, sample, line_no, line) of whole text files; a file is one row until it is cut into lines."""
    files = spark.read.text(paths, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", _stem(F.col("path")).alias("sample"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def formats(rows: DataFrame) -> DataFrame:
    """(path, format) by each file's first line that is not blank: kraken2, bracken or metaphlan; null for empty files."""
    first = rows.where(F.trim("line") != "").groupBy("path").agg(F.min_by("line", "line_no").alias("line"))
    fields = F.transform(F.split("line", "\t"), lambda x: F.trim(x))
    all_bracken = F.size(F.array_except(F.array(*[F.lit(c) for c in BRACKEN]), fields)) == 0
    kind = F.when(F.startswith("line", F.lit("#")) | (fields[0] == "clade_name"), "metaphlan").when((fields[0] == "name") & all_bracken, "bracken").otherwise("kraken2")
    return rows.select("path").distinct().join(first.select("path", kind.alias("format")), "path", "left")


def kraken2(rows: DataFrame, rank: str = "G") -> DataFrame:
    """(sample, taxon, reads): direct reads of rows of exactly this rank; of a taxon given twice the last row counts."""
    f = F.split(F.trim("line"), "\t")
    own = rows.where(F.size(f) >= 6).select("sample", "line_no", F.trim(f[5]).alias("taxon"), F.trim(f[2]).try_cast("bigint").alias("reads"), F.trim(f[3]).alias("rank"))
    own = own.where((F.col("rank") == rank) & F.col("reads").isNotNull())
    return own.groupBy("sample", "taxon").agg(F.max_by("reads", "line_no").cast("double").alias("reads"))


def bracken(rows: DataFrame, rank: str = "G", strict: bool = True) -> DataFrame:
    """(sample, taxon, reads): re-estimated reads at the rank, summed by name. Columns are found by the header line; a file
    without them is an error, or none of it is read (not strict)."""
    heads = rows.where("line_no = 0").select("path", F.transform(F.split("line", "\t"), lambda x: F.trim(x)).alias("head"))
    body = rows.where("line_no > 0 and trim(line) <> ''").join(heads, "path")
    at = lambda c: F.try_element_at(F.split("line", "\t"), F.array_position("head", F.lit(c)).cast("int"))
    need = F.array(*[F.lit(c) for c in BRACKEN])
    wrong = F.raise_error(F.concat(F.lit("not a Bracken report: "), "path")) if strict else F.lit(False)
    body = body.withColumn("ok", F.when(F.size(F.array_except(need, "head")) == 0, True).otherwise(wrong))
    return total_reads(body.where(F.col("ok") & (F.trim(at("taxonomy_lvl")) == rank)).select("sample", F.trim(at("name")).alias("taxon"), at("new_est_reads").try_cast("double").alias("reads")))


def metaphlan(rows: DataFrame, rank: str = "G") -> DataFrame:
    """(sample, taxon, reads): relative abundance in percent of clades whose last part is of the rank, summed by name."""
    if rank not in RANK_PREFIX:
        raise ValueError(f"no MetaPhlAn rank for {rank}")
    f = F.split("line", "\t")
    clade = F.element_at(F.split(f[0], r"\|"), -1)
    own = rows.where((F.trim("line") != "") & ~F.startswith("line", F.lit("#")) & (F.size(f) >= 3)).where(F.startswith(clade, F.lit(RANK_PREFIX[rank])))
    return total_reads(own.select("sample", F.substring(clade, 4, 1 << 20).alias("taxon"), f[2].try_cast("double").alias("reads")).where("reads is not null"))


PARSERS = {"kraken2": kraken2, "bracken": bracken, "metaphlan": metaphlan}


def reports(spark: SparkSession, paths: str | list[str], rank: str = "G", format: str = "auto", pattern: str | None = None, pairs: bool = True) -> DataFrame:
    """counts of report files of any of the formats, each file by its own (or all by the one given). A file without a line that is not blank
    is an error, as it has no format."""
    if format != "auto" and format not in PARSERS:
        raise ValueError(f"unknown format {format}")
    rows = lines(spark, paths, pattern)
    if format != "auto":
        out = PARSERS[format](rows, rank)
    else:
        kinds = F.broadcast(formats(rows))
        tagged = rows.join(kinds, "path").withColumn("format", F.coalesce("format", F.raise_error(F.concat(F.lit("empty report: "), "path"))))
        usable = [k for k in PARSERS if k != "metaphlan" or rank in RANK_PREFIX]
        loose = {"bracken": {"strict": False}}
        parts = [PARSERS[k](tagged.where(F.col("format") == k), rank, **loose.get(k, {})) for k in usable]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    return merge_pairs(out) if pairs else out


def report_directory(spark: SparkSession, directory: str, rank: str = "G", format: str = "auto", pattern: str | None = None) -> DataFrame:
    """counts of a directory's reports: files of the pattern, or of the first of PATTERNS that matches any."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(directory).getFileSystem(spark._jsc.hadoopConfiguration())
    for p in [pattern] if pattern else PATTERNS:
        if fs.globStatus(path(f"{directory}/{p}")):
            return reports(spark, f"{directory}/{p}", rank, format)
    raise FileNotFoundError(f"no report in {directory}")


def count_matrix(spark: SparkSession, path: str, transpose: bool = False) -> DataFrame:
    """counts of a table with taxa in its first column and a column for each sample; transpose: the other way round."""
    wide = spark.read.csv(path, header=True, sep="\t" if re.search(r"\.(tsv|txt)$", path) else ",")
    key, rest = wide.columns[0], wide.columns[1:]
    long = wide.select(F.col(f"`{key}`"), F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(f"`{c}`").alias("_value")) for c in rest])).alias("_cell")).select(key, "_cell.*")
    names = ("_name", key) if not transpose else (key, "_name")
    return long.select(F.col(f"`{names[0]}`").alias("sample"), F.trim(F.col(f"`{names[1]}`")).alias("taxon"), F.coalesce(F.col("_value").try_cast("double"), F.lit(0.0)).alias("reads"))


def fastq(spark: SparkSession, paths: str | list[str], limit: int | None = None, numbered: bool = True, range_bytes: int = sequences.RANGE_BYTES) -> DataFrame:
    """(sample, read_no, seq) of FASTQ files, gzipped or not; mates share their sample. Files are read in byte ranges, a row for each read.

    read_no counts a file's reads from 0, for which the files are read twice; without numbered it is the place of a read's first byte. An empty file
    has no reads, one that is cut off those whose letters are there."""
    rows, number = sequences.place(sequences.records(spark, paths, "fastq", range_bytes), numbered)
    out = rows.select(mate(_stem(F.col("path")))["base"].alias("sample"), number.alias("read_no"), "seq")
    return out if limit is None else out.limit(limit)


def fasta(spark: SparkSession, paths: str | list[str], min_length: int = 0, numbered: bool = True, range_bytes: int = sequences.RANGE_BYTES) -> DataFrame:
    """(sample, read_no, name, seq) of FASTA files: a record's lines joined, its name the header's first word. Files are read in byte ranges; read_no counts
    from 1, or is the place of a record's first byte (not numbered). Records without letters are left out."""
    rows, number = sequences.place(sequences.records(spark, paths, "fasta", range_bytes), numbered)
    out = rows.select(_stem(F.col("path")).alias("sample"), (number + 1 if numbered else number).alias("read_no"), F.split("name", r"\s+")[0].alias("name"), "seq")
    return out.where(F.length("seq") >= min_length)


def windows(reads: DataFrame, length: int = 150, stride: int = 75, most: int | None = None) -> DataFrame:
    """reads cut into overlapping windows, numbered anew within a sample's read; of each sample the first `most`, in order of its reads."""
    every = F.posexplode(read_windows(F.col("seq"), length, stride)).alias("window_no", "seq")
    if most is None:
        return reads.select("sample", "read_no", every)
    count = F.when(F.length("seq") <= length, 1).otherwise(F.floor((F.length("seq") - length) / stride) + 1)
    sizes = reads.groupBy("sample", "read_no").agg(F.sum(count).alias("_count"))
    before = F.coalesce(F.sum("_count").over(Window.partitionBy("sample").orderBy("read_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("sample", "read_no", before.alias("_before")).where(F.col("_before") < most)
    return reads.join(first, ["sample", "read_no"]).select("sample", "read_no", every, "_before").where(F.col("window_no") < most - F.col("_before")).drop("_before")


def subsample(reads: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n reads of each sample (all, if fewer), those of smallest hash: the same ones on each run."""
    order = Window.partitionBy("sample").orderBy(F.xxhash64(F.lit(seed), "read_no", "seq"), "read_no")
    return reads.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


@dataclass
class Input:
    """What a path held: counts, reads, or both; and its reports' species, whatever the rank of the counts."""

    counts: DataFrame | None = None
    species: DataFrame | None = None
    reads: DataFrame | None = None
    capabilities: set[str] = field(default_factory=set)


def ingest(spark: SparkSession, path: str, rank: str = "G", format: str = "auto", retain_reads: int | None = None) -> Input:
    """Reads a file or directory by what is in it: sequences, a count matrix (three columns or more), reports, or a mixture."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = hpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(s.getPath().toString()) for s in fs.listStatus(hpath(path)) if s.isFile()]
    if not names:
        raise FileNotFoundError(path)
    sequences = [n for n in names if re.search(READ_SUFFIX, n)]
    rest = [n for n in names if re.search(r"\.(report|kreport|kraken|bracken|tsv|csv|txt)$", n)]
    out = Input()
    if sequences:
        fq = [n for n in sequences if re.search(r"\.(fastq|fq)(\.gz)?$", n)]
        fa = [n for n in sequences if n not in fq]
        pieces = windows(fasta(spark, fa, numbered=False), most=retain_reads and 4 * retain_reads) if fa else None
        parts = ([fastq(spark, fq, numbered=False)] if fq else []) + ([pieces.select("sample", (F.col("read_no") + 75 * F.col("window_no")).alias("read_no"), "seq")] if fa else [])
        reads = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out.reads = subsample(reads, retain_reads) if retain_reads else reads
        out.capabilities.add("reads")
    if rest:
        kinds = {r["path"]: r["format"] for r in formats(lines(spark, rest)).collect()}
        single = len(rest) == 1 and not sequences and next(iter(kinds.values())) == "kraken2"
        wide = single and len(spark.read.csv(rest[0], header=True, sep="\t" if rest[0].endswith((".tsv", ".txt")) else ",").columns) >= 3 and not lines(spark, rest).where(r"line rlike '^\\s*[0-9.]+\t[0-9]+\t[0-9]+\t'").limit(1).count()
        out.counts = count_matrix(spark, rest[0]) if wide else reports(spark, rest, rank, format)
        out.species = None if wide else reports(spark, rest, "S", format)
        if not out.counts.where("reads > 0").isEmpty():
            out.capabilities.add("abundance")
    if not out.capabilities:
        raise ValueError(f"nothing readable in {path}")
    return out


def external_signals(spark: SparkSession, path: str) -> DataFrame:
    """(site, t, value, signal_type) of a table with site, date and value."""
    rows = spark.read.csv(path, header=True, sep="\t" if re.search(r"\.(tsv|txt)$", path) else ",")
    missing = {"site", "date", "value"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    kind = F.col("signal_type") if "signal_type" in rows.columns else F.lit("external")
    return rows.select("site", F.to_date("date").alias("t"), F.col("value").cast("double").alias("value"), kind.alias("signal_type"))


def report_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a JSON report, a row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")


def site_locations(spark: SparkSession, path: str) -> DataFrame:
    """(site, lat, lon, label) of a JSON object by site; keys that begin with _ are comments."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("site", "v")).where(~F.startswith("site", F.lit("_")))
    return parsed.select("site", F.from_json("v", "lat double, lon double, label string, collection_date string").alias("v")).select("site", "v.*")


def newest_runs(accessions: DataFrame, prefix: str, model: str, n: int) -> DataFrame:
    """The n newest of the accessions (sample_name, model, run_accession) of a prefix and model, by the date in their name."""
    from tidewatch.functions.columns import sample_date

    own = accessions.where(F.startswith("sample_name", F.lit(prefix)) & (F.col("model") == model))
    return own.withColumn("date", sample_date(F.col("sample_name"))).orderBy(F.desc("date"), F.desc("sample_name")).limit(n).orderBy("date", "sample_name")


def sample_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(accession, attributes) of XML files of sample records (SAMPLE with TAG and VALUE, or BioSample with named Attribute, however nested): a map of
    attribute names to values for each record with an accession, the first of equal names. Files are divided at the ends of records; a record is
    parsed by itself. One that is not well formed has null attributes."""
    parts = []
    for tag in ("SAMPLE", "BioSample"):
        rows = spark.read.text(path, lineSep=f"</{tag}>").select(F.regexp_extract("value", rf"(?s)(<{tag}\b.*)$", 1).alias("x")).where("x <> ''")
        parts.append(rows.select(F.concat("x", F.lit(f"</{tag}>")).alias("x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as Tree

        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            names, maps = [], []
            for x in b.column("x").to_pylist():
                try:
                    record = Tree.fromstring(x)
                except Tree.ParseError:
                    names.append((re.search(r'accession="([^"]+)"', x.split(">", 1)[0]) or [None, None])[1])
                    maps.append(None)
                    continue
                found: dict[str, str] = {}
                for e in record.iter():
                    name = e.get("attribute_name") if e.tag == "Attribute" else (e.findtext("TAG") if e.find("TAG") is not None else None)
                    value = "".join(e.itertext()) if e.tag == "Attribute" else e.findtext("VALUE")
                    if name and name.strip():
                        found.setdefault(name.strip(), (value or "").strip())
                names.append(record.get("accession"))
                maps.append(list(found.items()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(maps, kind)], names=["accession", "attributes"])

    return parts[0].unionByName(parts[1]).mapInArrow(run, "accession string, attributes map<string,string>").where("accession <> ''")
