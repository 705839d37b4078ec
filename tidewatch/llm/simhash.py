"""SimHash near-duplicates with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, mix64, narrowed, parts_for, saved, table
from .components import components

FAN = 8
FINGERPRINTS = 6  # of the near-duplicate stage


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; of all words where there are fewer; none without a word."""
    from xxhash import xxh64_intdigest

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = [0, *(ends[: len(own) - words] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprinted(df: DataFrame, words: int = 5, text: str = "text") -> DataFrame:
    """df without its text, with `fp` (the fingerprint as a signed long). A null text is an empty one: 0."""
    kept = [f for f in df.schema if f.name not in (text, "fp")]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(text)], np.uint64)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(fps.view(np.int64))], names=schema.names)

    return df.select(*[f.name for f in kept], text).mapInArrow(run, schema)


def set_hash(hashes: np.ndarray) -> int:
    """64 bits that stand for a set of hashes, given distinct and in order; 0 for none."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.astype("<u8").tobytes(), 42) if len(hashes) else 0


def fingerprint_list(hashes: np.ndarray, count: int) -> list[int]:
    """`count` independent fingerprints of the hashes; the first is `fingerprint`."""
    return [fingerprint(mix64(hashes ^ np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if i else hashes) for i in range(count)]


_ODD = np.random.default_rng(64).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_bits(hashes: np.ndarray) -> int:
    """64 bits, one of each of 64 minimum hashes: two sets of similarity s agree in about half of them and half of s more."""
    if not len(hashes):
        return 0
    low = np.full(64, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i : i + 4096, None] * _ODD).min(0))
    return int(np.packbits((mix64(low) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")[0])


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray code."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


def near_pairs(group: np.ndarray, fps: np.ndarray, radius: int, most: int = 1 << 20, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs in the same group whose fingerprints differ in at most radius bits.

    The entries are sorted by group and Gray rank. Each FAN neighbours share a node, which holds the bits that all of them
    have in common (mask and pattern); nodes of FAN nodes hold what these have in common, up to a root. Pairs of nodes are
    opened from the root down; a pair goes, with all below it, once the differences in the bits shared on both sides
    exceed the radius, or if no group reaches into both. root: pairs of entries with one root are left out; entries are sorted by it within
    their group, so that pairs of nodes with one root go too, and what is united costs nothing.
    """
    one = np.arange(len(fps)) if root is None else root
    order = np.lexsort((gray_rank(fps), group) if root is None else (gray_rank(fps), one, group))
    g, v, u = group[order], fps[order], one[order]
    levels = [(v, np.full(len(v), ~np.uint64(0)), g, g, u, u)]
    while len(levels[-1][0]) > 1:
        p, m, lo, hi, least, last = levels[-1]
        at = np.arange(0, len(p), FAN)
        first = np.repeat(p[at], np.diff([*at, len(p)]))
        mask = np.bitwise_and.reduceat(m & ~(p ^ first), at)
        levels.append((p[at] & mask, mask, lo[at], hi[np.minimum(at + FAN, len(p)) - 1], np.minimum.reduceat(least, at), np.maximum.reduceat(last, at)))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(v) > 1 else []
    step = np.arange(FAN)
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            yield order[a], order[b]
            continue
        if len(a) > most // FAN**2:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        p, m, lo, hi, least, last = levels[level - 1]
        i = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(step, FAN), len(a))
        j = np.repeat(b * FAN, FAN * FAN) + np.tile(step, FAN * len(a))
        ok = (i < len(p)) & (j < len(p)) & ((i < j) if level == 1 else (i <= j))
        i, j = i[ok], j[ok]
        ok = (lo[j] <= hi[i]) & (np.bitwise_count((p[i] ^ p[j]) & m[i] & m[j]) <= radius)
        if root is not None:
            ok &= (least[i] != last[j]) | (last[i] != least[j])
        if ok.any():
            stack.append((level - 1, i[ok], j[ok]))


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """Smallest position of each one's component; root: from earlier pairs."""
    root = np.arange(n) if root is None else root
    for a, b in pairs:
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _blocks(n: int, bits: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks of the lowest bits."""
    edge = [bits * i // n for i in range(n + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(n)]


def simhash_links(fps: DataFrame, radius: int = 3, group_rows: int = 2048, rows_per_task: int = 100_000, levels: int = 4) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` as all pairs within the radius would.

    Each fingerprint goes to a group for each of radius + 1 blocks of its bits (the topmost nodes: two within the radius
    agree in a block), where a Gray-order index finds the pairs. Groups of over group_rows are dealt again by each of
    radius + 1 blocks of the bits that are left, `levels` times in all, which loses no pair either; after that, those in a group agree in most of their bits.
    A task unites what it finds and returns a link to
    the smallest for each fingerprint, so dense groups do not return all their pairs. Null fingerprints are ignored.
    """
    fps = fps.where(F.col("fp").isNotNull()).select("fp")
    spark, rest, width, done = fps.sparkSession, F.col("rest"), 64, None

    def bits(shift: int, size: int) -> F.Column:
        return F.shiftrightunsigned(rest, shift).bitwiseAND((1 << size) - 1)

    def without(shift: int, size: int) -> F.Column:
        above = F.shiftleft(F.shiftrightunsigned(rest, shift + size), shift) if shift + size < 64 else F.lit(0).cast("long")
        return above.bitwiseOR(bits(0, shift)) if shift else above

    rows = fps.select("fp", F.lit(0).cast("long").alias("g"), F.col("fp").alias("rest"))
    for level in range(levels):
        blocks = _blocks(radius + 1, width)
        keys = F.array(*[F.struct(F.xxhash64(F.lit(level), "g", F.lit(i), bits(s, w)).alias("g"), without(s, w).alias("rest")) for i, (s, w) in enumerate(blocks)])
        rows = rows.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
        width -= max(w for _, w in blocks)
        large = saved(rows.groupBy("g").count().where(F.col("count") > group_rows).select(F.col("g").alias("large")))
        last = level == levels - 1 or width <= radius or large.isEmpty()
        part = rows if last else narrowed(rows, large, rows["g"] == large["large"], how="left_anti")
        done = part.select("g", "fp") if done is None else done.unionByName(part.select("g", "fp"))
        if last:
            break
        rows = saved(narrowed(rows, large, rows["g"] == large["large"]).select("fp", "g", "rest"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("g").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if rows:
            g, v = (np.concatenate(x) for x in zip(*rows, strict=True))
            root = roots(len(v), near_pairs(g, v.view(np.uint64), radius))
            a, b = v, v[root]
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    parts = parts_for(spark, fps.count() * (radius + 1), rows_per_task)
    return done.repartition(parts, "g").mapInArrow(search, "a long, b long")


def simhash_components(slim: DataFrame, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """slim (key, fp) with component_id: the smallest key that links of fingerprints reach, its own included.

    Null fingerprints are groups of their own, with their own key.
    """
    low = slim.groupBy("fp").agg(F.min(key).alias("low"))
    distinct = saved(low)
    root = components(simhash_links(distinct, radius)).withColumnRenamed("node", "fp")
    united = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = united.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = united.join(smallest, "root").select("fp", "component_id")
    return slim.join(by_fp, "fp", "left").withColumn("component_id", F.when(F.col("fp").isNotNull(), F.col("component_id")).otherwise(F.col(key)))


LIKE, HUB = 1, 2  # kinds of proposals, added where both are of one pair
AGREED = 7  # bits of a weight that are LIKE's; HUB's lie above
CHUNK, PIVOTS = 4096, 32


def close_pairs(batches: Iterator[pa.RecordBatch], radius: int, agree: float, similarity: float, thin: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different nodes `s` in a task's groups `g` whose fingerprints `fp` differ in at most radius bits and
    whose minimum-hash bits `bits` agree in `agree` or more; kind 0.

    thin: groups of over CHUNK nodes are cut into chunks, which share PIVOTS of their nodes, and only pairs within chunks are looked at yet. Those groups
    and groups with over that many pairs a node give, for each node a and all its groups of the task, its likest partner b (kind LIKE, weight: bits
    that agree) and the one with most partners (kind HUB, weight: partners, above AGREED bits; ties: the smaller node, so that tables choose alike), in one
    row where these are the same (kind LIKE | HUB), and are named in `open`: their other pairs are still to come. Without thin, nodes have `root`, `size`, `own` (how many of their shingles no other of these nodes has), `hub`
    (another node) and `delta` (shingles of only one of node and hub, without the own): pairs of one root go, those of one
    hub that are as similar as is asked are links (weight 1), of which a task returns only as many as connect the same nodes; those of two hubs if it is possible (weight 0).
    """
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    s = rows.column("s").to_numpy()
    order = np.argsort(s, kind="stable")
    column = lambda name: rows.column(name).to_numpy()[order]
    s, g, v, x = s[order], column("g"), column("fp").view(np.uint64), column("bits").view(np.uint64)
    group = np.unique(g, return_inverse=True)[1]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())

    size_of = np.bincount(group)
    large = np.flatnonzero(size_of > CHUNK) if thin is not None else size_of[:0]
    place, part = np.arange(len(s)), group.astype(np.int64)
    if len(large):  # chunks, each with the same pivots
        mixed = mix64(s.view(np.uint64))
        chunk = (mixed % np.maximum(1, size_of[group] // CHUNK).astype(np.uint64)).astype(np.int64)
        part = part << 32 | chunk
        more = []
        for k in large:
            own = np.flatnonzero(group == k)
            pivots = own[np.argsort(mixed[own], kind="stable")[:PIVOTS]]
            for c in range(size_of[k] // CHUNK):
                extra = pivots[chunk[pivots] != c]
                more.append((extra, np.full(len(extra), int(k) << 32 | c)))
        place = np.concatenate([place, *(m[0] for m in more)])
        part = np.concatenate([part, *(m[1] for m in more)])

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b in near_pairs(part, v[place], radius, 1 << 18, root[place] if thin is None else None):
            a, b = place[a], place[b]
            same = 64 - np.bitwise_count(x[a] ^ x[b]).astype(np.int64)
            ok = same >= agree
            if thin is None:
                ok &= root[a] != root[b]
                for i, j in ((a, b), (b, a)):  # what the texts have in common, and what they hold together, by what only one of them has
                    ok &= size[i] - own[i] >= similarity * (size[i] + own[j])
            if ok.any():
                yield a[ok], b[ok], same[ok]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shingles in common, of nodes of one hub."""
        shared = np.zeros(len(a), np.int64)
        edge = np.searchsorted(np.cumsum(many[a]), np.arange(0, many[a].sum(), 1 << 19)[1:])
        for part in np.split(np.arange(len(a)), edge):
            n = many[a[part]]
            pair = np.repeat(np.arange(len(part)), n)
            at = np.repeat(begin[a[part]] - (np.cumsum(n) - n), n) + np.arange(len(pair))
            wanted = b[part][pair] << 32 | flat[at]
            hit = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted if len(known) else np.zeros(0, bool)
            shared[part] = np.bincount(pair[hit], minlength=len(part))
        apart = many[a] + many[b] - 2 * shared + own[a] + own[b]
        return (size[a] + size[b] - apart) // 2

    def batch(a: np.ndarray, b: np.ndarray, weight: int = 0) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        n = len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, kinds[2]), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, weight, np.int64))], names=CLOSE)

    if thin is None:
        root, size, own, hubs = (column(c) for c in ("root", "size", "own", "hub"))
        lists = rows.column("delta").combine_chunks().take(pa.array(order))
        flat, many = lists.flatten().to_numpy().view(np.uint32).astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64)
        begin = np.cumsum(many) - many
        known = np.sort(np.repeat(np.arange(len(s)), many) << 32 | flat)
        near = np.unique(s, return_inverse=True)[1]
        united = np.arange(len(s))
        for a, b, _ in found():
            one = hubs[a] == hubs[b]
            yield batch(s[a[~one]], s[b[~one]])
            a, b = a[one], b[one]
            both = common(a, b)
            like = both >= similarity * (size[a] + size[b] - both)
            united = roots(len(s), iter([(near[a[like]], near[b[like]])]), united)
        i = np.flatnonzero(united != np.arange(len(s)))
        first = np.searchsorted(near, i)
        yield batch(s[first], s[np.searchsorted(near, united[i])], 1)
        return
    partners = np.zeros(len(s), np.int64)
    for a, b, _ in found():
        np.add.at(partners, a, 1)
        np.add.at(partners, b, 1)
    count = np.bincount(group)
    dense = (np.bincount(group, partners) > 2 * thin * count) | (count > CHUNK)
    node = np.unique(s, return_inverse=True)[1]
    likest, hub = np.full(len(s), -1), np.full(len(s), -1)  # at a node's number: the best of all groups of the task
    back = len(s) - 1
    for a, b, same in found():
        many = dense[group[a]]
        if not many.all():
            yield batch(s[a[~many]], s[b[~many]])
        for i, j in ((a[many], b[many]), (b[many], a[many])):
            np.maximum.at(likest, node[i], same[many] << 40 | (back - j))
            np.maximum.at(hub, node[i], partners[j] << 40 | (back - j))
    i = np.flatnonzero(likest >= 0)
    own = s[np.searchsorted(node, i)]
    best, partner = {}, {}
    for kind, top in ((LIKE, likest[i]), (HUB, hub[i])):
        best[kind], partner[kind] = top >> 40, s[back - (top & ((1 << 40) - 1))]
    one = partner[LIKE] == partner[HUB]
    for kind, rows in ((LIKE, ~one), (HUB, ~one), (LIKE | HUB, one)) if len(i) else ():
        weight = best[LIKE] * bool(kind & LIKE) | best[HUB] * bool(kind & HUB) << AGREED
        n = rows.sum()
        yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(partner[kind & LIKE or HUB][rows]), pa.nulls(n, kinds[2]), pa.array(np.full(n, kind, np.int32)), pa.array(weight[rows])], names=CLOSE)
    if len(i):
        first = np.unique(group, return_index=True)[1][dense]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(first), k) if c != "open" else pa.array(g[first], pa.int32()) for c, k in zip(CLOSE, kinds, strict=True)], names=CLOSE)


CLOSE = ["a", "b", "open", "kind", "weight"]


def with_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """close_pairs' first look with one row a node for both of its proposals: b and weight are LIKE's, hub and partners HUB's."""

    def rows(columns: list[pa.Array], hub: pa.Array, partners: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, hub, partners], names=[*CLOSE, "hub", "partners"])

    held = []
    for x in batches:
        named = pc.greater(x.column("kind"), 0).fill_null(False)
        held.append(x.filter(named))
        x = x.filter(pc.invert(named))
        yield rows(x.columns, pa.nulls(x.num_rows, pa.int64()), pa.nulls(x.num_rows, pa.int64()))
    if not held:
        return
    a, b, kind, weight = (pa.Table.from_batches(held).column(c).to_numpy() for c in ("a", "b", "kind", "weight"))
    own, at = np.unique(a, return_inverse=True)
    partner, best = np.zeros((2, len(own)), np.int64), np.zeros((2, len(own)), np.int64)
    for i, (bit, value) in enumerate(((LIKE, weight & ((1 << AGREED) - 1)), (HUB, weight >> AGREED))):
        of = kind & bit > 0
        partner[i, at[of]], best[i, at[of]] = b[of], value[of]
    n = len(own)
    yield rows([pa.array(own), pa.array(partner[0]), pa.nulls(n, pa.int32()), pa.array(np.full(n, LIKE | HUB, np.int32)), pa.array(best[0])], pa.array(partner[1]), pa.array(best[1]))


def candidates(nodes: DataFrame, radius: int, agree: float, similarity: float, thin: int | None = None, among: DataFrame | None = None, tables: int = 16, bits: int = 14, seed: int = 5, rows_per_task: int = 200_000) -> DataFrame:
    """close_pairs of nodes (s, fps, bits, and root, size, own, hub and delta without thin) for radii that blocks are too many for; with thin, as with_hubs gives them.

    Nodes have FINGERPRINTS independent fingerprints, and for each are grouped by `bits` of its bits, chosen at random without
    replacement for each table; two whose fingerprints differ in d bits share a group in one of its tables with probability
    1 - (1 - C(64 - d, bits) / C(64, bits)) ** tables. In each group a Gray-order index finds all pairs within the radius; a
    pair is missed only where every fingerprint misses it. By the normal angle law, with radius 18, equal-sized sets of similarity
    0.8 are found with probability 0.9989 (0.9996 at 0.82, 0.9999 at 0.85). among: only the groups in its column `open`.
    """
    rng = np.random.default_rng(seed)
    masks = [int(sum(1 << int(b) for b in rng.choice(64, bits, replace=False))) for _ in range(tables * FINGERPRINTS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    fps = [F.col("fps")[i // tables] for i in range(len(masks))]
    keys = F.array(*[F.struct(F.hash(F.lit(i), fps[i].bitwiseAND(F.lit(m))).alias("g"), fps[i].alias("fp")) for i, m in enumerate(signed)])
    own = [c for c in nodes.columns if c in ("s", "bits", "root", "size", "own", "hub", "delta")]
    dealt = nodes.select(*own, F.explode(keys).alias("key")).select(*own, "key.*")
    if among is not None:
        dealt = narrowed(dealt, among, dealt["g"] == among["open"])
    parts = parts_for(nodes.sparkSession, nodes.count() * len(masks), rows_per_task)
    dealt, kind = dealt.repartition(parts, "g"), "a long, b long, open int, kind int, weight long"
    if thin is None:
        return dealt.mapInArrow(lambda batches: close_pairs(batches, radius, agree, similarity, None), kind)
    return dealt.mapInArrow(lambda batches: with_hubs(close_pairs(batches, radius, agree, similarity, thin)), f"{kind}, hub long, partners long")


def near_duplicates(df: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 18, text: str = "text", key: str = "doc_id", thin: int = 1) -> DataFrame:
    """(key, t, fp, root, component_id): t is a hash of the text; rows whose root agrees are near-duplicates, and
    component_id is the smallest key among them.

    Fingerprints are of the distinct shingles. Those within the radius are candidates, and linked if the Jaccard similarity of their shingle sets (32-bit
    hashes of `words`-word shingles) is at least `similarity`. Only texts of equal shingle sets stand for each other; different
    ones of equal fingerprints are candidates like any other. Candidates whose 64 minimum-hash bits agree in 12 (some five standard deviations) fewer than the
    similarity leads to expect are dropped in the group's task.

    Of dense groups (over `thin` pairs a node) two links a node are verified first: to its likest partner and to the partner
    with most partners, over all tables. Then every pair there that these have not united is, in the groups' tasks, so that the many unlike pairs of a large
    family are told apart without a join: texts that such links connect, verified or not, have one hub, the text to which most of them
    point; by how each of two texts differs from the hub, it is known how they differ from each other. That difference is what is sent. Shingles that a single
    text of all these holds are sent as a number; and as texts of m and n shingles, u and v of them their own, are at most
    (m - u) / (m + v) similar, most pairs go without a look at their differences.

    Null texts are empty ones; texts without a word are a group of their own. Null keys go to the group of their text; rows that are there twice are
    both returned. Other columns play no part.
    """
    docs = df.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(text).alias("text"))
    schema = T.StructType([*docs.select("k", "t").schema, T.StructField("s", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType())), T.StructField("bits", T.LongType())])

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
            fps = np.array([fingerprint_list(h, FINGERPRINTS) for h in sets], np.uint64).reshape(-1, FINGERPRINTS).view(np.int64)
            bits = np.array([min_bits(h) for h in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * FINGERPRINTS), pa.array(fps.ravel()))
            same = np.array([set_hash(h) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), pa.array(same), lists, pa.array(bits)], names=schema.names)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique((shingle_hashes(t.as_py(), words) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in b.column("text")]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("s"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *sets])))], names=["s", "shingles"])

    rows = saved(docs.mapInArrow(fingerprints, schema))
    nodes = saved(rows.groupBy("s").agg(F.min("k").alias("low"), F.min(F.struct("t", "k", "fps", "bits")).alias("one")).select("s", "low", "one.*"))
    agree = 32 + 32 * similarity - 12

    def shingles(wanted: DataFrame) -> DataFrame:
        """Shingle sets of the nodes in wanted (s)."""
        need = saved(wanted.join(nodes, "s").select("s", F.col("t").alias("need_t"), F.col("k").alias("need_k")))
        same = (F.col("t") == F.col("need_t")) & F.col("k").eqNullSafe(F.col("need_k"))
        texts = narrowed(docs, need, same).join(need, same).select("s", "text")
        out = saved(texts.mapInArrow(shingled, "s long, shingles array<int>").dropDuplicates(["s"]))
        discard(need)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are as similar as is asked."""
        sets = shingles(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct())
        both = pairs.join(sets.select(F.col("s").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        out = saved(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"))
        discard(sets)
        return out

    def between(pairs: DataFrame, root: DataFrame) -> DataFrame:
        """The pairs as links of their ends' roots (node, root; a node without one is its own), each once; pairs of one root go. Its components and
        root make those of all links together, and no link is walked that is united already."""
        of = lambda side: root.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        ends = [F.coalesce(f"root_{c}", c) for c in ("a", "b")]
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
        return saved(both.where("a <> b").distinct())

    found = saved(candidates(nodes, radius, agree, similarity, thin))
    best = [F.min(F.struct((-F.col(w)).alias("w"), F.col(b).alias("b"))).alias(b) for w, b in (("weight", "b"), ("partners", "hub"))]
    proposed = saved(found.where("kind > 0").groupBy("a").agg(*best).select("a", F.explode(F.array("b.b", "hub.b")).alias("b")))
    first = found.where("kind = 0").select("a", "b").unionByName(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = saved(first.distinct())
    linked = verified(pairs)
    root, merged = components(linked), None
    dense = saved(found.where(F.col("open").isNotNull()).select("open").distinct())
    if not dense.isEmpty():
        parted = nodes.join(proposed.select(F.col("a").alias("s")).distinct(), "s").join(root.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
        sets = shingles(parted.select("s"))
        once = sets.select("s", F.explode("shingles").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s")).where("n = 1")
        mine = saved(sets.join(once.groupBy("s").agg(F.collect_list("x").alias("mine")), "s", "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<int>"))))
        families = components(between(proposed, root)).select(F.col("node").alias("root"), F.col("root").alias("family"))
        family = saved(parted.select(F.col("s").alias("node"), "root").join(families, "root", "left").select("node", F.coalesce("family", "root").alias("family")))
        votes = proposed.join(family, proposed["b"] == family["node"]).groupBy("family", "b").count().groupBy("family").agg(F.min(F.struct((-F.col("count")).alias("w"), "b")).alias("best"))
        hub = votes.select("family", F.col("best.b").alias("hub"))
        of = family.select(F.col("node").alias("s"), "family").join(hub, "family").select("s", "hub")
        center = mine.select(F.col("s").alias("hub"), F.col("shingles").alias("center"), F.array_except("shingles", "mine").alias("rest")).join(of.select("hub").distinct(), "hub")
        apart = F.concat(F.array_except(F.array_except("shingles", "center"), "mine"), F.array_except("rest", "shingles"))
        delta = mine.join(of, "s").join(saved(center), "hub").select("s", "hub", F.size("shingles").cast("long").alias("size"), F.size("mine").cast("long").alias("own"), apart.alias("delta"))
        parted = parted.join(delta.where(F.col("size") - F.col("own") >= similarity * F.col("size")), "s")
        more = saved(candidates(saved(parted), radius, agree, similarity, among=dense).select("a", "b", "weight").distinct())
        open_pairs = saved(more.where("weight = 0").select("a", "b").join(pairs, ["a", "b"], "left_anti"))
        merged = components(between(more.where("weight = 1").select("a", "b").unionByName(verified(open_pairs)), root)).select(F.col("node").alias("root"), F.col("root").alias("least"))
        discard(sets, mine, family, more, open_pairs)
    discard(found, proposed, pairs, linked, dense)
    united = nodes.select("s", "low").join(root.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    if merged is not None:
        united = united.join(merged, "root", "left").select("s", "low", F.coalesce("least", "root").alias("root"))
    smallest = united.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("k", "t", F.col("fps")[0].alias("fp"), "s").join(united.join(smallest, "root").select("s", "root", "component_id"), "s").select(F.col("k").alias(key), "t", "fp", "root", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 3 or fewer differing bits of 3-word fingerprints."""
    slim = saved(fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3))
    return simhash_components(slim, 3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
