"""License scans: word k-gram hashes of texts joined to template positions, votes for diagonals, verified spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SliceHash, mix64, saved, table

# Phrases that count wherever their words stand consecutively.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Sentences of public licenses and notices, found also with some words changed.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution"),
]
GRAM = 3
DRIFT = 3  # words by which a span's diagonals may lie apart
COVERAGE = 0.8
BLOCK = 1 << 20
LIST = 1 << 16

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-case bytes begin and end."""
    edges = np.diff(np.concatenate([[0], IN_WORD[data].astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray, hashing: SliceHash) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and 64-bit hashes of the words of lower-case bytes, block by block; blocks end between words."""
    at, out, begin = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while begin < len(data):
        end = begin + BLOCK
        while end < len(data) and IN_WORD[data[end]]:
            end += 1
        part = data[begin:end]
        starts, ends = word_spans(part)
        out.append(hashing.slices(hashing.prefix(part), starts, ends))
        at.append(starts + begin)
        begin = end
    return np.concatenate(at), np.concatenate(out)


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    n = max(0, len(words) - GRAM + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix64(total)


def templates(phrases: list[tuple[str, str]] = PHRASES, sentences: list[tuple[str, str]] = SENTENCES) -> list[tuple[str, list[str], bool]]:
    """(label, words, exact) of each template; it has GRAM words at least and 64 grams at most."""
    out = [(label, text.split(), exact) for group, exact in ((phrases, True), (sentences, False)) for label, text in group]
    if any(not GRAM <= len(words) < 64 + GRAM for _, words, _ in out):
        raise ValueError(f"a template has {GRAM} to {63 + GRAM} words")
    return out


def template_grams(spark: SparkSession, known: list[tuple[str, list[str], bool]]) -> DataFrame:
    """(hash, template, place) of all grams of the templates: a few hundred rows."""
    rows, hashing = [], SliceHash()
    for i, (_, words, _) in enumerate(known):
        found = gram_hashes(word_hashes(LOWER[np.frombuffer(" ".join(words).encode(), np.uint8)], hashing)[1]).view(np.int64)
        rows += [(int(h), i, place) for place, h in enumerate(found)]
    return spark.createDataFrame(rows, "hash long, template int, place int")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, one value after another, and where values begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return LOWER[data], offsets - offsets[0]


def text_grams(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, first, hashes): hashes of every run of GRAM words of a text, in lists of LIST at most; first is the number of the list's first word."""
    kinds = [df.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("first", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = SliceHash()
        for b in batches:
            data, begins = _bytes(b.column("text"))
            at, words = word_hashes(data, hashing)
            owner = np.searchsorted(begins, at, side="right") - 1
            grams = gram_hashes(words).view(np.int64)
            whole = owner[: len(grams)] == owner[GRAM - 1 :] if len(grams) else np.empty(0, bool)
            grams, count = grams[whole], np.bincount(owner[: len(grams)][whole], minlength=b.num_rows)
            lists = -(-count // LIST)
            row = np.repeat(np.arange(b.num_rows), lists)
            first = (np.arange(len(row)) - np.repeat(np.cumsum(lists) - lists, lists)) * LIST
            edges = np.append(np.repeat(np.cumsum(count) - count, lists) + first, len(grams))
            found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(grams, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(row)) for k in keys], pa.array(first, pa.int64()), found], names=schema.names)

    return df.select(*keys, F.concat(text, F.lit("\0")).cast("binary").alias("text")).mapInArrow(run, schema)


def diagonals(grams: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, template, diagonal, votes): all grams joined to the templates' places by hash, and how many places of a template a diagonal has. Places
    are bits of a long, so copies of a text under one key do not count twice and groups are added up before their exchange."""
    each = grams.select(*keys, F.posexplode("hashes").alias("n", "hash"), "first").join(F.broadcast(known), "hash")
    places = each.groupBy(*keys, "template", (F.col("first") + F.col("n") - F.col("place")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("places"))
    return places.select(*keys, "template", "diagonal", F.bit_count("places").alias("votes"))


def candidates(votes: DataFrame, keys: list[str], sizes: DataFrame, drift: int = DRIFT) -> DataFrame:
    """(keys, template, low, high): a phrase's diagonals with all its votes, and runs of a sentence's neighbouring diagonals, at most drift apart, that
    have together three votes in ten (one changed word takes GRAM of them)."""
    rows = votes.join(F.broadcast(sizes), "template")
    order = W.partitionBy(*keys, "template").orderBy("diagonal")
    exact = rows.where("exact and votes = grams").select(*keys, "template", F.col("diagonal").alias("low"), F.col("diagonal").alias("high"))
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(1))
    runs = rows.where("not exact").withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "template", "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"), F.max("grams").alias("grams"))
    return exact.unionByName(runs.where(F.col("votes") >= 0.3 * F.col("grams")).select(*keys, "template", "low", "high"))


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, a's places being bits of an integer."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def license_scan(df: DataFrame, text: str = "text", key: str = "doc_id", phrases: list[tuple[str, str]] = PHRASES, sentences: list[tuple[str, str]] = SENTENCES, coverage: float = COVERAGE, bound: int = 500_000) -> DataFrame:
    """(key, n_words, spans) of every text: spans of (label, start, end, coverage, exact), counted in words.

    Votes are gathered by a text's hash (128 bits), so equal texts are scanned as one and rows with null or repeated keys stay apart. What they
    lead to is verified on the texts themselves: a phrase by its words, a sentence by its longest common subsequence with the words
    about its diagonals, of which it must have `coverage`. Candidates are broadcast to the texts if they are `bound` texts and spans at most, and
    joined by a shuffle otherwise. Null texts are empty ones; empty in, empty out."""
    spark, known = df.sparkSession, templates(phrases, sentences)
    keys = ["__a", "__b"]
    own = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("doc"), F.xxhash64(own).alias("__a"), F.xxhash64(F.lit(1), own).alias("__b"), own.alias("own"))
    sizes = spark.createDataFrame([(i, len(words) - GRAM + 1, exact) for i, (_, words, exact) in enumerate(known)], "template int, grams int, exact boolean")
    votes = diagonals(text_grams(docs, keys, F.col("own")), keys, template_grams(spark, known))
    found = saved(candidates(votes, keys, sizes).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("template", "low", "high"))).alias("found")))
    size = found.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("spans")).first()
    found = F.broadcast(found) if size["texts"] + size["spans"] <= bound else found.hint("merge")
    both = docs.join(found, keys, "left").select("doc", F.concat("own", F.lit("\0")).cast("binary").alias("text"), "found")
    span = "array<struct<label:string,start:bigint,end:bigint,coverage:double,exact:boolean>>"
    schema = T.StructType([T.StructField("doc", df.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", T._parse_datatype_string(span))])

    def verified(words: list[str], one: dict) -> tuple | None:
        label, wanted, exact = known[one["template"]]
        start, end = max(0, one["low"]), min(len(words), one["high"] + len(wanted))
        here = words[start:end]
        share = float(here == wanted) if exact else common_words(wanted, here) / len(wanted)
        return (label, start, end, share, exact) if share >= coverage else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, spans = [], []
            data, begins = _bytes(b.column("text"))
            for i, one in enumerate(b.column("found")):
                part = data[begins[i] : begins[i + 1]]
                inside = IN_WORD[part]
                counts.append(int(inside[:1].sum()) + int(np.count_nonzero(inside[1:] & ~inside[:-1])))
                tried = one.as_py()
                if tried:
                    starts, ends = word_spans(part)
                    raw = part.tobytes()
                    words = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    tried = [x for x in (verified(words, c) for c in tried) if x]
                spans.append([dict(zip(("label", "start", "end", "coverage", "exact"), x, strict=True)) for x in tried or []])
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()), ("exact", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(counts, pa.int64()), pa.array(spans, kind)], names=schema.names)

    return both.mapInArrow(run, schema).withColumnRenamed("doc", key)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document: base phrases' places and all labels."""
    out = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return out.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels("spans").alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"))
