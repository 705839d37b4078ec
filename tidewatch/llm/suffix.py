"""Suffix-array deduplication: exact long repeats found with a run-length Burrows-Wheeler index."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SliceHash, discard, fresh, mix64, narrowed, parts_for, saved, sliced, table

SEED = 32  # bytes of an anchor
SEGMENT = 1 << 20  # window starts handled at once in a very long text
INDEX_BYTES = 1 << 18
_HASH = SliceHash()


# ---- run-length index -------------------------------------------------------------------------------------------


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some texts, with samples at both ends of each run.

    A sample is a text position, and the length that it shares with its neighbour in suffix order. Within a run, moving on
    by a byte moves the neighbour on too, so the length shrinks by one: from the samples alone the matching statistics
    of the texts stream out.

    Suffixes are ordered by doubling; only those that are not alone yet are sorted again. All texts end in the same sign, so a
    length is cut at the end of its text; suffixes that agree to there stay in any order, and the greatest reach of all samples before
    a position tells its match.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        n = self.n = len(raw)
        self.left = np.repeat(self.starts + self.sizes, self.sizes + 1) - np.arange(n)
        code = np.cumsum(np.bincount(raw, minlength=256) > 0)[raw].astype(np.int64)
        code[self.starts + self.sizes] = 0
        bits = int(code.max()).bit_length()
        wide = 62 // max(1, bits)  # signs that fit into a first key
        ahead = np.concatenate([code, np.zeros(wide, np.int64)])
        key = ahead[:n].copy()
        for i in range(1, wide):
            key = key << bits | ahead[i : n + i]
        order = np.argsort(key)
        head = np.ones(n, bool)
        head[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        ranks, width = [rank], [wide]
        while width[-1] < self.sizes.max():
            slot = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(slot):
                break
            at, last = order[slot], ranks[-1]
            beyond = np.where(at + width[-1] < n, last[np.minimum(at + width[-1], n - 1)].astype(np.int64) + 1, 0)
            key2 = last[at].astype(np.int64) * (n + 1) + beyond
            by = np.argsort(key2)
            at, key2 = at[by], key2[by]
            order[slot] = at
            first = np.ones(len(slot), bool)
            first[1:] = key2[1:] != key2[:-1]
            head[slot] = first
            rank = last.copy()
            rank[at] = np.maximum.accumulate(np.where(first, slot, 0))
            ranks.append(rank)
            width.append(2 * width[-1])
        bwt = code[order - 1]
        new = np.ones(n, bool)
        new[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        self.run_heads = np.flatnonzero(new)
        self.run_symbols = bwt[self.run_heads]
        tails = np.append(self.run_heads[1:], n) - 1
        self.samples = []  # positions, and lengths shared with the neighbour before the run and after it
        for at, to in ((self.run_heads, self.run_heads - 1), (tails, tails + 1)):
            ok = (to >= 0) & (to < n)
            length = np.zeros(len(at), np.int64)
            length[ok] = self._shared(order[at[ok]], order[to[ok]], ranks, width, key, bits)
            self.samples.append((order[at], length))

    def _shared(self, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray], width: list[int], key: np.ndarray, bits: int) -> np.ndarray:
        """Bytes in common, as far as a's text goes: what each level of the doubling has in common, then sign by sign."""
        same = ranks[-1][a] == ranks[-1][b]
        out = np.where(same, width[-1], 0)
        at = np.flatnonzero(~same)
        x, y = a[at], b[at]
        for rank, w in zip(reversed(ranks[:-1]), reversed(width[:-1]), strict=True):
            out[at] += w * (rank[x] == rank[y])
            x, y = np.minimum(a[at] + out[at], self.n - 1), np.minimum(b[at] + out[at], self.n - 1)
        differ = key[x] ^ key[y]
        for i in range(width[0]):
            out[at] += (differ >> bits * i) == 0
        return np.minimum(out, self.left[a])

    def statistics(self) -> np.ndarray:
        """For each position of the joined texts, how long a match beginning there also begins elsewhere."""
        reach = np.zeros(self.n, np.int64)
        for position, length in self.samples:
            reach[position] = np.maximum(reach[position], position + length)
        return np.maximum.accumulate(reach) - np.arange(self.n)

    def long_matches(self, size: int) -> list[np.ndarray]:
        """For each text, where a string of `size` bytes begins that also begins elsewhere in the texts."""
        long = self.statistics() >= size
        return [np.flatnonzero(long[s : s + n]) for s, n in zip(self.starts, self.sizes, strict=True)]


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[[0, *(cut + 1)]].tolist(), starts[[*cut, len(starts) - 1]].tolist(), strict=True))


# ---- anchors ----------------------------------------------------------------------------------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window."""
    n = len(values)
    m = -(-n // width) * width
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def anchors(text: bytes, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (hash, fragment's hash, position, first, last): every window of `size` bytes has one anchor, the SEED-byte
    string in it of least hash (the leftmost of equal ones); an anchor's windows begin at first to last, and its fragment
    is all they cover. Equal windows have equal anchors at equal places."""
    width = size - SEED + 1
    for base in range(0, max(0, len(text) - size + 1), SEGMENT):
        codes = np.frombuffer(text, np.uint8)[base : base + SEGMENT + size - 1]
        if len(codes) < size:
            return
        prefix = _HASH.prefix(codes)
        at = np.arange(len(codes) - SEED + 1)
        seeds = _HASH.slices(prefix, at, at + SEED)
        low = np.uint64(32)
        place = (_least((seeds >> low << low) | at.astype(np.uint64), width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        whole = _HASH.slices(prefix, first, last + size) + (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield seeds[p].view(np.int64), whole.view(np.int64), p + base, first + base, last + base


def _anchor_table(docs: DataFrame, size: int) -> DataFrame:
    """(g, f, k, t, p, a, b) of all rows: anchor and fragment hash, row, position, first and last window."""
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for i, t in enumerate(b.column("text")):
                for x in anchors(t.as_py().encode("utf-8", "surrogatepass"), size):
                    rows.append(np.full(len(x[0]), i))
                    parts.append(x)
            if rows:
                take = pa.array(np.concatenate(rows))
                g, f, p, a, e = (pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([g, f, b.column("k").take(take), b.column("t").take(take), p, a, e], names=["g", "f", "k", "t", "p", "a", "b"])

    return docs.mapInArrow(run, f"g long, f long, k {kind}, t long, p long, a long, b long")


FRAGMENT = ["g", "f", "twice", "lo", "hi", "x", "y", "content"]
FOUND = "g long, f long, first long, last long"
PLACE = ["k", "t", "p", "a", "b"]


def _counted(every: DataFrame, rows: int = 200_000) -> DataFrame:
    """(g, f, n, o, q) of anchors, added up within a task before they are exchanged; o and q are two occurrences, if there are two."""
    place = every.select(*PLACE).schema
    schema = T.StructType([*every.select("g", "f").schema, T.StructField("n", T.LongType()), T.StructField("o", place), T.StructField("q", place)])

    def group(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).append_column("i", pa.array(np.arange(sum(b.num_rows for b in held))))
        by = whole.select(["g", "f", "i"]).group_by(["g", "f"]).aggregate([("i", "count"), ("i", "min"), ("i", "max")])
        two = []
        for i in ("i_min", "i_max"):
            one = whole.take(by[i]).combine_chunks()
            two.append(pa.StructArray.from_arrays([one[c].combine_chunks() if isinstance(one[c], pa.ChunkedArray) else one[c] for c in PLACE], names=PLACE))
        return pa.RecordBatch.from_arrays([by["g"].combine_chunks(), by["f"].combine_chunks(), by["i_count"].combine_chunks(), *two], names=["g", "f", "n", "o", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:
                yield group(held)
                held = []
        if held:
            yield group(held)

    return every.select("g", "f", *PLACE).mapInArrow(run, schema)


def _fragments(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (g, f, n, whole, k, t, p, a, b) with lo and hi, its first and last window from the anchor, in place of its place; `content`, the
    bytes of the fragment, where whole is true; and `digest`, their SHA-256, where n is over 1."""
    each = wanted.groupBy("k", "t").agg(F.collect_list(F.struct("g", "f", "n", "whole", "p", "a", "b")).alias("at"))
    each = saved(each.withColumnsRenamed({"k": "own_k", "t": "own_t"}))
    same = F.col("k").eqNullSafe(F.col("own_k")) & (F.col("t") == F.col("own_t"))
    joined = narrowed(docs, each.select("own_k", "own_t"), same).join(each, same).select("text", "at")
    kinds = [*[pa.int64()] * 5, pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for text, at in zip(b.column("text"), b.column("at"), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for x in at.as_py():
                    part = raw[x["a"] : x["b"] + size]
                    out.append((x["g"], x["f"], x["n"], x["a"] - x["p"], x["b"] - x["p"], part if x["whole"] else None, sha256(part).digest() if x["n"] > 1 else None))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=["g", "f", "n", "lo", "hi", "content", "digest"])

    return joined.mapInArrow(run, "g long, f long, n long, lo long, hi long, content binary, digest binary")


def _search(groups: DataFrame, size: int) -> DataFrame:
    """(g, f, first, last): runs of windows, from the anchor, that a fragment (other than those known to be there twice) shares with
    another one of its group."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        found = RunIndex([r[4] for r in rows]).long_matches(size) if rows else []
        out = [(g, f, lo + first, lo + last) for (g, f, twice, lo, _), starts in zip(rows, found, strict=True) if not twice for first, last in runs_of(starts)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 4], names=["g", "f", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("g", "f", "twice", "lo", "content")), strict=True):
                if total > INDEX_BYTES and r[0] != held[-1][0]:
                    yield batch(held)
                    held, total = [], 0
                held.append(r)
                total += len(r[4])
        yield batch(held)

    return groups.mapInArrow(run, FOUND)


def _halved(groups: DataFrame, size: int) -> DataFrame:
    """Each fragment for either half of its group's window starts, keyed anew (g2, f2) by the bytes that all windows of the half
    contain: fragments that differ there share no window of that half. A group about one window start has no two
    different fragments, so halving ends."""
    names = ["g2", "f2", *FRAGMENT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, f, twice, lo, hi, x, y, content in zip(*(b.column(c).to_pylist() for c in FRAGMENT), strict=True):
                prefix = _HASH.prefix(np.frombuffer(content, np.uint8))
                for x2, y2 in ((x, (x + y) // 2), ((x + y) // 2 + 1, y)):
                    lo2, hi2 = max(x2, lo), min(y2, hi)
                    if lo2 <= hi2:
                        hashes = _HASH.slices(prefix, np.array([y2, lo2]) - lo, np.array([x2, hi2]) - lo + size)
                        g2, f2 = mix64(hashes + mix64(np.array([g + 31 * x2, lo2], np.int64).view(np.uint64))).view(np.int64).tolist()
                        out.append((g2, f2, g, f, twice, lo2, hi2, x2, y2, content[lo2 - lo : hi2 - lo + size]))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), *(b.schema.field(f).type for f in FRAGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return groups.select(*FRAGMENT).mapInArrow(run, "g2 long, f2 long, g long, f long, twice boolean, lo long, hi long, x long, y long, content binary")


def _clash(kind: str) -> Column:
    return F.raise_error(F.lit("two different fragments have equal hashes; choose another base of SliceHash")).cast(kind)


def _open_groups(classes: DataFrame) -> DataFrame:
    """(g) of the groups in which a fragment is left that is not known to be there twice, and another one."""
    return classes.groupBy("g").agg(F.count(F.lit(1)).alias("d"), F.count_if(~F.col("twice")).alias("single")).where("d > 1 and single > 0").select("g")


def _matches(rows: DataFrame, size: int, group_rows: int) -> DataFrame:
    """_search of fragments in open groups. Groups of over group_rows fragments are halved until they are small; what is equal in a half is there twice."""
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("d"))
    parts = parts_for(rows.sparkSession, rows.count(), 4096)
    small = rows.join(counts.where(F.col("d") <= group_rows).select("g"), "g", "left_semi")
    found = saved(_search(small.repartition(parts, "g").sortWithinPartitions("g"), size))
    large = saved(rows.join(counts.where(F.col("d") > group_rows).select("g"), "g", "left_semi"))
    if large.isEmpty():
        discard(large)
        return found
    halves = saved(_halved(large, size))
    discard(large)
    classes = halves.groupBy("g2", "f2").agg((F.bool_or("twice") | (F.count(F.lit(1)) > 1)).alias("twice"), F.min("content").alias("content"), F.max("content").alias("other"), *[F.min(c).alias(c) for c in ("lo", "hi", "x", "y")])
    classes = classes.select(F.col("g2").alias("g"), F.col("f2").alias("f"), "twice", "lo", "hi", "x", "y", F.when(F.col("content") == F.col("other"), F.col("content")).otherwise(_clash("binary")).alias("content"))
    classes = saved(classes)
    own = halves.where("not twice").select(F.col("g").alias("g0"), F.col("f").alias("f0"), F.col("g2").alias("g"), F.col("f2").alias("f"))
    equal = own.join(classes.where("twice").select("g", "f", F.col("lo").alias("first"), F.col("hi").alias("last")), ["g", "f"])
    below = own.join(_matches(saved(classes.join(_open_groups(classes), "g", "left_semi")), size, group_rows), ["g", "f"])
    return found.unionByName(equal.unionByName(below).select(F.col("g0").alias("g"), F.col("f0").alias("f"), "first", "last"))


def repeat_spans(docs: DataFrame, size: int, group_rows: int = 128, hot: int = 1000) -> DataFrame:
    """Spans (k, t, a, e) that together cover what repeats in docs (k, t, text), t a hash of the text."""
    every = saved(_anchor_table(docs.where(F.octet_length("text") >= size), size))
    parts = parts_for(docs.sparkSession, every.count(), 200_000)
    per = _counted(every).repartition(parts, "g").groupBy("g", "f").agg(F.sum("n").alias("n"), F.min("o").alias("o"), F.max("q").alias("q"))
    about = per.groupBy("g").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("d"), F.count_if(F.col("n") == 1).alias("single")).where("m > 1")
    repeated = saved(per.join(about.select("g", ((F.col("d") > 1) & (F.col("single") > 0)).alias("open")), "g"))
    ends = F.when(F.col("n") > 1, F.array("o", "q")).otherwise(F.array("o"))
    wanted = repeated.select("g", "f", "n", "open", F.posexplode(ends).alias("i", "at")).select("g", "f", "n", (F.col("open") & (F.col("i") == 0)).alias("whole"), "at.*")
    parts_of = saved(_fragments(docs, wanted, size))
    same = parts_of.where("n > 1").groupBy("g", "f").agg(F.min("digest").alias("u"), F.max("digest").alias("v"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    equal = same.select("g", "f", F.when(F.col("u") == F.col("v"), F.col("lo")).otherwise(_clash("long")).alias("first"), F.col("hi").alias("last"))
    rows = parts_of.where("content is not null").select("g", "f", (F.col("n") > 1).alias("twice"), "lo", "hi", F.lit(SEED - size).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "content").dropDuplicates(["g", "f"])
    singles = _matches(saved(rows), size, group_rows)
    found = saved(equal.unionByName(singles).join(repeated.select("g", "f", "n"), ["g", "f"]).select(F.col("g").alias("g_"), F.col("f").alias("f_"), "n", "first", "last"))
    own = (F.col("g") == F.col("g_")) & (F.col("f") == F.col("f_"))
    if found.count() <= 250_000:
        spans = every.join(F.broadcast(found), own)
    else:  # fragments with many copies apart, so that no task gets all of one; they are few
        spans = narrowed(every, found.where(F.col("n") > hot), own, how="inner").unionByName(every.join(found.where(F.col("n") <= hot).hint("merge"), own))
    return spans.select("k", "t", (F.col("p") + F.col("first")).alias("a"), (F.col("p") + F.col("last") + size).alias("e"))


def word_windows(text: bytes, words: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (hash, start, end) of the windows of `words` words (ASCII whitespace parts them) that are under `size` bytes."""
    codes = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], (codes != 32) & ((codes < 9) | (codes > 13)), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if len(start) < words:
        return
    start, end = start[: len(start) - words + 1], end[words - 1 :]
    short = end - start < size
    start, end = start[short], end[short]
    for base in np.unique(start // SEGMENT) * SEGMENT:
        own = (start >= base) & (start < base + SEGMENT)
        prefix = _HASH.prefix(codes[base : base + SEGMENT + size])
        yield _HASH.slices(prefix, start[own] - base, end[own] - base).view(np.int64), start[own], end[own]


def word_spans(docs: DataFrame, words: int, size: int) -> DataFrame:
    """Spans (k, t, a, e) of docs (k, t, text) that are windows of `words` words, under `size` bytes, which are there twice."""
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for i, t in enumerate(b.column("text")):
                for x in word_windows(t.as_py().encode("utf-8", "surrogatepass"), words, size):
                    rows.append(np.full(len(x[0]), i))
                    parts.append(x)
            if rows:
                take = pa.array(np.concatenate(rows))
                h, a, e = (pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([h, b.column("k").take(take), b.column("t").take(take), a, e], names=["h", "k", "t", "a", "e"])

    every = saved(docs.where(F.octet_length("text") >= 2 * words - 1).mapInArrow(run, f"h long, k {kind}, t long, a long, e long"))
    twice = saved(every.groupBy("h").count().where("count > 1").select(F.col("h").alias("twice")))
    return narrowed(every, twice, F.col("h") == F.col("twice")).select("k", "t", "a", "e")


def without_repeats(df: DataFrame, size: int = 400, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """df with `kept` (binary), `kept_text` (string) and `spans` (array of start, end): the UTF-8 bytes of each text without every byte
    that a string of `size` bytes covers which also begins anywhere else; these as text, without characters that a cut went through;
    and the maximal runs of what is removed.

    Strings are judged on the input; they may overlap, and lie in the same text; matches never cross rows. Null and short
    texts lose nothing; a row that is there twice loses all its windows; an empty df gives an empty result. Columns named
    kept, kept_text or spans are replaced.

    Each window of `size` bytes is owned by its anchor, the SEED-byte string in it of least hash, so equal windows have
    equal anchors at equal places, and only fragments (what the windows of one anchor cover) with the same anchor can share
    a window. Fragments with equal hashes are verified to be equal by their SHA-256 (an error, where they are not), and are there
    twice or more. Groups with other fragments beside
    go, by the quarter megabyte, into a run-length Burrows-Wheeler index whose matching statistics tell where long matches begin. A group of over
    group_rows different fragments (a passage that very many rows share) is cut at the middle of its windows, and either
    half is grouped anew by the bytes common to its windows, until groups are small or equal.

    words: strings of that many whole words go too where they are shorter than `size`; such windows are few and found by
    their hashes.
    """
    df = df.drop("kept", "kept_text", "spans")
    k, t, body = (fresh(df.columns, f"__{x}") for x in ("k", "t", "text"))
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("k"), F.xxhash64(whole).alias("t"), whole.alias("text"))
    spans = repeat_spans(docs, size)
    if words:
        spans = spans.unionByName(word_spans(docs, words, size))
    spans = spans.groupBy("k", "t").agg(F.sort_array(F.collect_set(F.struct("a", "e"))).alias("__spans"))
    spans = saved(spans.select(F.col("k").alias(k), F.col("t").alias(t), "__spans"))
    keyed = df.withColumns({body: whole, t + "_": F.xxhash64(whole)})
    same = F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.col(t + "_") == F.col(t))
    keys = spans.select(k, t)
    hit = narrowed(keyed, keys, same).join(spans, same).select(*df.columns, body, "__spans")
    rest = narrowed(keyed, keys, same, how="left_anti").select(*df.columns, body, F.lit(None).cast(spans.schema["__spans"].dataType).alias("__spans"))
    joined = hit.unionByName(rest)
    schema = T.StructType([*df.schema, *T._parse_datatype_string("kept binary, kept_text string, spans array<struct<start: bigint, end: bigint>>").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            kept, texts, runs = [], [], []
            for x, found in zip(b.column(body), b.column("__spans").to_pylist(), strict=True):
                raw, merged = x.as_py().encode("utf-8", "surrogatepass"), []
                for s in found or []:
                    if merged and s["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["e"])
                    else:
                        merged.append([s["a"], s["e"]])
                at = [0, *(y for m in merged for y in m), len(raw)]
                pieces = [raw[i:j] for i, j in zip(at[::2], at[1::2], strict=True)]
                kept.append(b"".join(pieces))
                texts.append("".join(p.decode("utf-8", "ignore") for p in pieces) if merged else x.as_py())
                runs.append([{"start": i, "end": j} for i, j in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in df_columns], pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(runs, kind)], names=[*df_columns, "kept", "kept_text", "spans"])

    df_columns = df.columns
    return joined.mapInArrow(cut, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats over 400 bytes or more in all documents, removed."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))


OP8_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT rid, h, unnest(range(0, len(h) // 2 - 399)) AS s FROM d WHERE len(h) >= 800
), w AS (
  SELECT rid, s, md5(substr(h, 2 * s + 1, 800)) AS x FROM p
), r AS (
  SELECT rid, s FROM (SELECT *, count(*) OVER (PARTITION BY x) AS n FROM w) WHERE n > 1
), i AS (
  SELECT rid, s, sum(CASE WHEN s > prev + 400 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS run
  FROM (SELECT *, lag(s) OVER (PARTITION BY rid ORDER BY s) AS prev FROM r)
), m AS (
  SELECT rid, min(s) AS a, max(s) + 400 AS e FROM i GROUP BY rid, run
), g AS (
  SELECT rid, a, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS b FROM m
), k AS (
  SELECT rid, sum(e - a) AS gone, count(*) AS spans, max(e) AS last,
    string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS head,
    string_agg(regexp_replace(regexp_replace(substr(h, 2 * b + 1, 2 * (a - b)), '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''), '' ORDER BY a) AS head_text
  FROM g JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256,
  decode(unhex(CASE WHEN gone IS NULL THEN h ELSE head_text || regexp_replace(substr(h, 2 * last + 1), '^([89AB].)+', '') END)) AS text
FROM d LEFT JOIN k USING (rid)
"""
