"""Sequence packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, saved, table

#: White space by Unicode's property; \s of the regex module has more.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Characters on which all versions of Unicode agree; other texts are left to the tokenizer as a whole.
_ODD = re.compile("[^\\0-ɏ‐-‧€]|<\\|endoftext\\|>")


class Encoder:
    """Token ids as little-endian 32-bit words, the same as the tokenizer file's, with a cache of words' ids."""

    CACHE = 300_000

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= Encoder.CACHE:
                    self.clear()
                self[word] = out = np.array(encode(word), "<u4").tobytes()
                return out

        self.words = Words()
        pattern = public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")
        self.split = regex.compile(pattern).findall

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.split(text)))


def token_pieces(df: DataFrame, size: int = 1024, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each document's ids and a final 0, cut into pieces of `size` ids and a rest: key, start, length, ids_crc32, doc_tokens.

    with_ids adds `ids` (binary, little-endian 32-bit). A null text is an empty one, whose only id is the final 0.
    """
    schema = T.StructType([T.StructField("doc", df.schema[key].dataType), *[T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens")]])
    if with_ids:
        schema = schema.add("ids", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for b in batches:
            out: list[list] = [[] for _ in schema]
            rows = b.column("doc").take
            at = []
            for i, t in enumerate(b.column("text")):
                ids = memoryview(encode(t.as_py() or "") + b"\0\0\0\0")
                n = len(ids) // 4
                for s in range(0, n, size):
                    part = ids[4 * s : 4 * (s + size)]
                    at.append(i)
                    for c, v in zip(out[1:], (s, len(part) // 4, zlib.crc32(part), n, bytes(part) if with_ids else b""), strict=False):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([rows(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in out[1:5]], *[pa.array(c, pa.binary()) for c in out[5:]]], names=schema.names)

    return df.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(cut, schema).withColumnRenamed("doc", key)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and their counts: each length, longest first, goes to the packs with
    most room; packs are begun only where it fits in none. At most one pattern more with each step, and a step uses up
    a length or a pattern."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        while left and (most := max(room, default=-1)) >= length:
            pattern, count = room[most].pop()
            if count > left:
                room[most].append((pattern, count - left))
            elif not room[most]:
                del room[most]
            n = min(left, count)
            room.setdefault(most - length, []).append(((*pattern, length), n))
            left -= n
        fits = size // length
        for times, n in ((fits, left // fits), (left % fits, 1)):
            if times and n:
                room.setdefault(size - times * length, []).append(((length,) * times, n))
    return sorted((p for packs in room.values() for p in packs), reverse=True)


def packed(pieces: DataFrame, size: int = 1024, rows_per_run: int = 20_000) -> DataFrame:
    """pieces (with a column `length`, 1 to size) and their sequence_id and offset, both gapless from 0.

    The driver gets the length histogram (size counts at most) and makes patterns of it; of each pattern's places it
    makes an interval of ranks among the pieces of a length, and broadcasts these (a few for each length, whatever the
    number of pieces). Pieces are ranked within length and a salt, with prefix sums over the salts, so that a length
    which a third of all pieces have is spread over many tasks. Equal pieces are interchangeable; empty in, empty out.
    """
    spark, names = pieces.sparkSession, pieces.columns
    salt, rank, low, high, base, count = (fresh(names, f"__{x}") for x in ("salt", "rank", "low", "high", "base", "count"))
    histogram = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}
    salts = max(16, -(-sum(histogram.values()) // rows_per_run))
    places, seen, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, n in shortest_pack_first(histogram, size):
        offset = 0
        for length in pattern:
            places.append((length, seen[length], seen[length] + n, sequence, offset))
            seen[length] += n
            offset += length
        sequence += n
    cols = [F.col(f"`{c}`") for c in names]
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    starts = salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias(count))
    starts = starts.withColumn(base, F.sum(count).over(W.partitionBy("length").orderBy(salt)) - F.col(count)).drop(count)
    ranked = salted.withColumn(rank, F.row_number().over(W.partitionBy("length", salt).orderBy(*cols))).join(starts, ["length", salt])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(base) - 1)
    where = F.broadcast(spark.createDataFrame(places, f"__l long, `{low}` long, `{high}` long, `{base}_` long, __o long"))
    out = ranked.join(where, (ranked["length"] == where["__l"]) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high)))
    return out.select(*cols, (F.col(f"{base}_") + F.col(rank) - F.col(low)).alias("sequence_id"), F.col("__o").alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packed(saved(token_pieces(table(spark, sf_dir, "documents")))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
