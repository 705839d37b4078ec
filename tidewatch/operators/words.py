"""Words of a list that texts contain, found in one pass over each text however many words there are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD = 200_000  # words of one automaton


def words_in(texts: DataFrame, words: DataFrame | list[str], shard: int = SHARD) -> DataFrame:
    """(text, words): for each different text of texts (text) the words that it contains as letters in a row, in order; both in lower case. Texts without
    any have no row; empty and null words and texts are left out.

    An automaton of all words goes to the tasks. Lists of more than `shard` words are cut into as many automata as they need, each of
    which reads the texts once, so no task and no message holds more than one."""
    spark = texts.sparkSession
    if isinstance(words, list):
        words = spark.createDataFrame([(w,) for w in words], "word string")
    every = words.select(F.lower("word").alias("word")).where("word is not null and word <> ''").distinct()
    shards = max(1, -(-every.count() // shard))
    own = texts.select(F.col("text")).where("text is not null and text <> ''").distinct()

    def found(some: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in some:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for b in batches:
                hits = [sorted({w for _, w in automaton.iter(t.as_py())}) for t in b.column("low")]
                keep = [i for i, h in enumerate(hits) if h]
                yield pa.RecordBatch.from_arrays([b.column("text").take(pa.array(keep, pa.int64())), pa.array([hits[i] for i in keep], pa.list_(pa.string()))], names=["text", "words"])

        return own.select("text", F.lower("text").alias("low")).mapInArrow(run, "text string, words array<string>")

    parts = []
    for k in range(shards):
        some = sorted(r["word"] for r in (every if shards == 1 else every.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == k)).collect())
        if some:
            parts.append(found(some))
    if not parts:
        return spark.createDataFrame([], "text string, words array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if len(parts) == 1 else out.groupBy("text").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words"))


def longest_word(texts: DataFrame, words: DataFrame | list[str], shard: int = SHARD) -> DataFrame:
    """(text, word): the longest word that a text contains, the last in order of equally long ones."""
    each = words_in(texts, words, shard).select("text", F.explode("words").alias("word"))
    place = F.row_number().over(W.partitionBy("text").orderBy(F.desc(F.length("word")), F.desc("word")))
    return each.withColumn("place", place).where("place = 1").drop("place")
