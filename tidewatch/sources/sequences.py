"""FASTQ and FASTA files as a data source whose partitions are byte ranges; a record belongs to the range in which it begins."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, start bigint, n bigint, offset bigint, name string, seq string"
RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


@dataclass
class Range(InputPartition):
    """Bytes from start to before end of a file; a gzipped file is one range."""

    path: str
    start: int
    end: int


def _open(path: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def numbered_lines(f: BinaryIO, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from a place on that begins a line."""
    rest = b""
    while block := f.read(READ_BYTES):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for p in parts:
            yield at, p
            at += len(p) + 1
    if rest:
        yield at, rest


def fastq_records(lines: Iterator[tuple[int, bytes]], end: int, inside: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, header, sequence) of the records that begin before end. From within a file (inside), the first record is at the first line with @ that
    a line with + follows two lines on: a quality line with @ is followed by a header and letters. At the end of a
    file that is cut off, a header and letters are enough, and a header alone is no record."""
    held: list[tuple[int, bytes]] = []

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(lines, None)
            if more is None:
                return False
            held.append(more)
        return True

    if inside:
        while fill(1):
            if held[0][0] >= end:
                return
            if held[0][1].startswith(b"@"):
                third = fill(3)
                if held[2][1].startswith(b"+") if third else len(held) == 2 and held[1][1].strip() and not held[1][1].startswith(b"@"):
                    break
            held.pop(0)
    while fill(1) and held[0][0] < end:
        if fill(2):
            yield held[0][0], held[0][1], held[1][1]
        fill(4)
        del held[:4]


def fasta_records(lines: Iterator[tuple[int, bytes]], end: int, inside: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, header, sequence) of the records whose header begins before end, a record's lines joined. Letters before a file's first header
    are a record without a name; records without letters are none."""
    at, name, parts = (None if inside else 0), b"", []
    for offset, line in lines:
        line = line.strip()
        if line.startswith(b">"):
            if at is not None and parts:
                yield at, name, b"".join(parts)
            if offset >= end:
                return
            at, name, parts = offset, line[1:], []
        elif at is not None:
            parts.append(line)
        elif offset >= end:
            return
    if at is not None and any(parts):
        yield at, name, b"".join(parts)


RECORDS = {"fastq": fastq_records, "fasta": fasta_records}


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.kind, self.size = json.loads(options["paths"]), options["kind"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            files, own = _open(path)
            size = files.get_file_info(own).size or 0
            out += [Range(path, 0, 1 << 62)] if path.endswith(".gz") and size else [Range(path, s, min(s + self.size, size)) for s in range(0, size, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end == 0:
            return
        files, own = _open(partition.path)
        with files.open_input_stream(own, compression="gzip") if own.endswith(".gz") else files.open_input_file(own) as f:
            at = partition.start
            if at:
                f.seek(at - 1)
            lines = numbered_lines(f, at - 1 if at else 0)
            if at:
                next(lines, None)  # the rest of a line that began before, or its end alone
            rows, size, n = [], 0, 0
            for offset, header, seq in RECORDS[self.kind](lines, partition.end, at > 0):
                rows.append((partition.path, partition.start, n, offset, header.decode("utf-8", "replace").strip(), seq.decode("utf-8", "replace").strip()))
                n, size = n + 1, size + len(seq) + len(header) + 32
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        path, start, n, offset, name, seq = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), *[pa.array(x, pa.int64()) for x in (start, n, offset)], pa.array(name), pa.array(seq)], names=["path", "start", "n", "offset", "name", "seq"])


class SequenceSource(DataSource):
    """Options: paths (a JSON list of files), kind (fastq or fasta), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "sequence_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> SequenceReader:
        return SequenceReader(self.options)


def files_of(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files that paths name: files, folders, or patterns. A path that names none is an error."""
    hpath, out = spark._jvm.org.apache.hadoop.fs.Path, []
    for p in [paths] if isinstance(paths, str) else paths:
        fs = hpath(p).getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s for s in fs.globStatus(hpath(p)) or []]
        found = [s for f in found for s in (fs.listStatus(f.getPath()) if f.isDirectory() else [f])]
        if not found:
            raise FileNotFoundError(p)
        out += [s.getPath().toString() for s in found if s.isFile() and not s.getPath().getName().startswith((".", "_"))]
    return sorted(out)


def records(spark: SparkSession, paths: str | list[str], kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, n, offset, name, seq): each record a row, n its number in the range that begins at start, offset its first byte. A gzipped file cannot
    be divided: it is one range, and a warning says so."""
    files = files_of(spark, paths)
    whole = [f for f in files if f.endswith(".gz")]
    if whole:
        warnings.warn(f"{len(whole)} gzipped files are read by one task each", stacklevel=3)
    spark.dataSource.register(SequenceSource)
    return spark.read.format("sequence_records").option("paths", json.dumps(files)).option("kind", kind).option("rangeBytes", str(range_bytes)).load()


def place(rows: DataFrame, numbered: bool) -> tuple[DataFrame, Column]:
    """rows and each record's read_no: its number in its file (numbered), for which ranges are counted first, a row for each; or its offset,
    which needs one pass only."""
    if not numbered:
        return rows, F.col("offset")
    counts = rows.groupBy(F.col("path").alias("_path"), F.col("start").alias("_start")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = rows.join(counts.select("_path", "_start", before.alias("_before")), (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
    return both, F.col("n") + F.col("_before")
