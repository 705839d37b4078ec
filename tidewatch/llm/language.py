"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, small_batches, table

CLASSES = 128  # 0: no letter; 1 to 26: a to z; the rest: other letters, by code point
DIM = 512


def _letter_classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for cp in range(sys.maxunicode + 1):
        if chr(cp).isalpha():
            out[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % (CLASSES - 27)
    return out


class Encoder:
    """Document hypervectors: sums of trigram vectors, each the product of three letter vectors, permuted by place."""

    _classes: np.ndarray | None = None

    def __init__(self, dim: int = DIM, seed: int = 7) -> None:
        if Encoder._classes is None:
            Encoder._classes = _letter_classes()
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dim))
        self.first, self.second, self.third = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.dim = dim

    def codes(self, text: str) -> np.ndarray:
        """Trigrams of the lower-cased letters; each run of other characters, and either end, is one space."""
        c = self._classes[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[keep]
        return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:] if c.any() else c[:0]

    def vectors(self, codes: list[np.ndarray]) -> np.ndarray:
        """A row for each document; zero where it has no trigram."""
        every = np.concatenate([np.empty(0, np.int32), *codes])
        if not len(every):
            return np.zeros((len(codes), self.dim), np.float32)
        seen = np.zeros(CLASSES**3, bool)
        seen[every] = True
        grams = np.flatnonzero(seen)
        place = np.zeros(CLASSES**3, np.int32)
        place[grams] = np.arange(len(grams))
        item = self.first[grams // CLASSES**2] * self.second[grams // CLASSES % CLASSES] * self.third[grams % CLASSES]
        at = np.repeat(np.arange(len(codes)), [len(c) for c in codes]) * len(grams) + place[every]
        counts = np.bincount(at, minlength=len(codes) * len(grams)).reshape(len(codes), -1)
        return counts.astype(np.float32) @ item.astype(np.float32)


def _chunks(texts: list[str | None], rows: int = 192, chars: int = 1 << 21) -> Iterator[list[str]]:
    out, n = [], 0
    for t in texts:
        out.append(t or "")
        n += len(out[-1])
        if len(out) >= rows or n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


def fit_language(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1500, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from about per_language rows of each (all, if fewer), chosen by a hash of the key.

    Rows without text, language or letters take no part. The driver gets a vector for each language and task.
    """
    small_batches(df.sparkSession)
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, DIM), np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = Encoder(seed=seed), {}
        for b in batches:
            own = b.column("lang").to_pylist()
            i = 0
            for part in _chunks(b.column("text").to_pylist()):
                v = enc.vectors([enc.codes(t) for t in part]).astype(np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v /= np.where(norm > 0, norm, 1)
                for row, k in zip(v, own[i : i + len(part)], strict=True):
                    total[k] = total.get(k, 0) + row
                i += len(part)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "v": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    found: dict[str, np.ndarray] = {}
    for k, v in chosen.select("lang", "text").mapInArrow(sums, "lang string, v binary").collect():
        found[k] = found.get(k, 0) + np.frombuffer(bytes(v), np.float64)
    langs = [k for k in langs if k in found and np.linalg.norm(found[k]) > 0]
    proto = np.array([found[k] / np.linalg.norm(found[k]) for k in langs]).reshape(len(langs), DIM)
    return langs, proto.astype(np.float32)


def predict_language(df: DataFrame, langs: list[str], prototypes: np.ndarray, text: str = "text", seed: int = 7, sharpness: float = 25.0) -> DataFrame:
    """df with `lang_pred` and `score`: the prototype of the largest cosine, and its share in a softmax of the cosines.

    Texts that are null, empty or without a letter get `und` and 0.0, as all do if no language was learned. Only the
    text is looked at. Rows stay where they are: no exchange. Columns named lang_pred or score are replaced.
    """
    small_batches(df.sparkSession)
    df = df.drop("lang_pred", "score")
    schema = T.StructType([*df.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(seed=seed)
        for b in batches:
            names, scores = [], []
            for part in _chunks(b.column(text).to_pylist()):
                v = enc.vectors([enc.codes(t) for t in part])
                norm = np.linalg.norm(v, axis=1)
                if not langs:
                    names += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                cos = (v / np.where(norm > 0, norm, 1)[:, None]) @ prototypes.T
                e = np.exp(sharpness * (cos - cos.max(1, keepdims=True)).astype(np.float64))
                best = cos.argmax(1)
                p = e[np.arange(len(part)), best] / e.sum(1)
                names += [langs[k] if x else "und" for k, x in zip(best, norm > 0, strict=True)]
                scores += np.where(norm > 0, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(predict, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    langs, proto = fit_language(docs.where(~held_out(5, 0)))
    slim = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    return predict_language(slim, langs, proto).select("doc_id", "held_out", "lang_pred", "score")
