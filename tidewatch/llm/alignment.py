"""Cross-tokenizer alignment: shared cuts of two tokenizations of a text, by packed bitsets of token ends."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, saved, table
from .packing import Encoder

B_BITS, PAIR_BITS = 20, 40  # ids are below 2**20; a pair of ids, and one of a batch's texts, are one long


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}


class ByteLevel(Encoder):
    """Ids and bytes of a byte-level tokenizer over a space and the text; strings of special tokens are plain text."""

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        super().__init__(name)
        self.exact.encode_special_tokens = True
        letters = byte_letters()
        self.bytes = [bytes(letters[c] for c in self.exact.id_to_token(i)) if all(c in letters for c in self.exact.id_to_token(i)) else self.exact.id_to_token(i).encode() for i in range(self.exact.get_vocab_size())]

        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encoded(self, text: str) -> np.ndarray | None:
        """Ids, or None if they do not give the text back: merges only join bytes, so it is enough that none is missing."""
        ids = np.frombuffer(self(" " + text), "<u4")
        return ids if self.sizes[ids].sum() == len(text.encode()) + 1 else None


class Pieces:
    """Ids and bytes of a piece model over a text, which puts a space before it.

    Where no piece has a space after another character, merges never cross the beginning of a run of spaces, and long texts are
    encoded a part at a time, cut there."""

    PART = 1 << 16

    def __init__(self, name: str = "piece_bpe_32k") -> None:
        import public_tokenizers
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.cut = None if any("▁" in p.lstrip("▁") for p in pieces) else re.compile(r"(?<=[^ ]) ")

    def parts(self, text: str) -> Iterator[str]:
        """The text without the spaces at which it is cut; each is what the model puts before a part."""
        begin = 0
        while self.cut and len(text) - begin > self.PART and (at := self.cut.search(text, begin + self.PART)):
            yield text[begin : at.start()]
            begin = at.end()
        yield text[begin:]

    def encoded(self, text: str) -> np.ndarray | None:
        """Ids, or None if they do not give the text back."""
        out = []
        for part in self.parts(text):
            ids = self.model.encode(part) if part else [self.model.piece_to_id("▁")]
            if b"".join(map(self.bytes.__getitem__, ids)) != b" " + part.encode():
                return None
            out.append(np.array(ids, "<u4"))
        return np.concatenate(out)


class Ends:
    """A bitset of token ends, with the number of ends before each word of 64 bits."""

    def __init__(self, ends: np.ndarray, size: int) -> None:
        bits = np.zeros((size // 64 + 1) * 64, bool)
        bits[ends] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ends there are up to each place, it included."""
        low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (at & 63).astype(np.uint64))
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


def shared_cuts(a: Ends, b: Ends) -> np.ndarray:
    return np.flatnonzero(np.unpackbits((a.words & b.words).view(np.uint8), bitorder="little"))


def rendered(ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal ids, each followed by its byte of ends; and where each one's text ends."""
    digits = max(1, len(str(int(ids.max(initial=0)))))
    out, keep = np.empty((len(ids), digits + 1), np.uint8), np.ones((len(ids), digits + 1), bool)
    for k in range(digits):
        p = 10 ** (digits - 1 - k)
        out[:, k], keep[:, k] = ids // p % 10 + 48, (ids >= p) | (p == 1)
    out[:, digits] = ends
    return out[keep].tobytes(), np.cumsum(keep.sum(1))


def aligned(a: list[np.ndarray], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Of texts' ids in two tokenizations whose bytes are equal: a text's numbers of tokens and groups, its groups' hash, and per text the
    distinct linked pairs (text, a, b) with how often each is linked.

    All texts of a batch lie one after another in one byte space, so the bitsets are made once; a text's end is a cut of both."""
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
    a_ids, b_ids = (np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int64) for ids in (a, b))
    a_ends, b_ends = np.cumsum(a_size[a_ids]), np.cumsum(b_size[b_ids])
    size = int(a_ends[-1]) if len(a_ends) else 0
    left, right = Ends(a_ends, size), Ends(b_ends, size)
    cuts = shared_cuts(left, right)
    last_a, last_b = left.rank(cuts) - 1, right.rank(cuts) - 1
    text_of = np.searchsorted(np.cumsum(n_a), last_a, side="right")
    n_groups = np.bincount(text_of, minlength=len(a))
    of_a, of_b = (np.repeat(np.arange(len(cuts)), np.diff(last, prepend=-1)) for last in (last_a, last_b))
    at_a = np.arange(len(a_ids)) + np.concatenate([[0], last_b[:-1] + 1]).astype(np.int64)[of_a] if len(cuts) else np.empty(0, np.int64)
    at_b = np.arange(len(b_ids)) + last_a[of_b] + 1 if len(cuts) else np.empty(0, np.int64)
    order, ends = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    order[at_a], order[at_b] = a_ids, b_ids
    ends[at_a[last_a]], ends[at_b[last_b]] = ord("|"), ord(";")
    text, until = rendered(order, ends)
    edges = np.concatenate([[0], until])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    view = memoryview(text)
    hashes = [hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(edges, edges[1:], strict=False)]
    links, times = np.unique(text_of << PAIR_BITS | a_ids[last_a] << B_BITS | b_ids[last_b], return_counts=True)
    links = np.stack([links >> PAIR_BITS, links & (1 << PAIR_BITS) - 1])
    return [n_a, n_b, n_groups], hashes, links, times


def token_links(df: DataFrame, text: str = "text", key: str = "doc_id", a: str = "byte_bpe_50k", b: str = "piece_bpe_32k") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups_sha256, and `pairs` and `times`: the distinct pairs of ids (a << B_BITS | b) that a text links, and
    how often. Texts that are null or empty, or that either tokenizer does not give back, have no tokens. Whole texts; a row stays a row."""
    counts = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([T.StructField("doc", df.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteLevel(a), Pieces(b)
        none = np.empty(0, "<u4")
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                rows = batch.slice(s, 1024)
                left, right = [], []
                for t in rows.column("text"):
                    t = t.as_py() or ""
                    x, y = (first.encoded(t), second.encoded(t)) if t else (none, none)
                    left.append(none if x is None or y is None else x)
                    right.append(none if x is None or y is None else y)
                (n_a, n_b, n_groups), hashes, links, times = aligned(left, right, first.sizes, second.sizes)
                edges = np.searchsorted(links[0], np.arange(len(left) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v, kind)) for v, kind in ((links[1], pa.int64()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([rows.column("doc"), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_groups)], pa.array(hashes), *lists], names=schema.names)

    return df.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("doc", key)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold a pair, and whether no pair of the same b has more. A b has as many pairs as there are ids of a, at most."""
    each = links.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    return each.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1))))


def alignment(df: DataFrame, text: str = "text", key: str = "doc_id", bound: int = 1_000_000, **tokenizers: str) -> DataFrame:
    """token_links and, for each row, `n_best` (its links whose count is the highest of their b) and `count_sum` (its links' counts).

    Texts are tokenized once and their pairs saved. The table of counts grows with the vocabularies, not with the corpus; it is broadcast
    where it has `bound` rows at most, otherwise the texts' pairs are shuffled to it, a row for each text and pair, so that a pair which
    every text has is a splittable join. Null keys and repeated rows each keep a row; an empty table gives an empty one."""
    row, known = fresh([key], "__row"), token_links(df, text, key, **tokenizers)
    links = saved(known.withColumn(row, F.monotonically_increasing_id()))
    counts = saved(pair_counts(links))
    counts = F.broadcast(counts) if counts.count() <= bound else counts.hint("merge")
    each = links.select(row, F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times"))).join(counts, "pair")
    sums = each.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = links.drop("pairs", "times").join(sums, row, "left").drop(row)
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the byte-level and the piece tokenizer."""
    out = alignment(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
