"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import fingerprints, language, lm, mixing, packing, sharding, simhash, suffix, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light under winter copper field morning seven paper glass wonder small river bank".split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(WORDS, rng.integers(5, 200))) for _ in range(60)]
    passage = " ".join(rng.choice(WORDS, 120))
    texts += [texts[0], texts[0], texts[1] + " end", "front " + passage + " one", passage + " two", "", "  \n ", "ÄÖÜ ß — ½ 漢字", "x" * 5000, "12 34 !!", "lone\x1cword\x85end <|endoftext|> a"]
    out = [(i, t, "en" if i % 2 else "fr", "s", None) for i, t in enumerate(texts)]
    return [*out, (None, None, None, None, None), (7, "again seven", None, "s", 1), (70, None, "en", "s", 0), out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def bag(df, *cols):
    return Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*cols).collect())


def test_sharding(docs, nothing, rows):
    clash = docs.withColumn("shard", F.lit(9)).withColumn("Slot", F.lit("x"))
    out = sharding.shuffled_shards(clash, 7, rows_per_part=10, rows_per_run=3).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == len(rows) and sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert (out["_shard"] == 9).all() and (out["_slot"] == "x").all()
    assert sharding.shuffled_shards(nothing, 7).count() == 0


def test_communication_matrix_is_that_of_a_permutation():
    row, col = [5, 0, 7, 3], [4, 4, 4, 3]
    total = np.zeros((4, 4))
    for seed in range(3000):
        m = sharding.communication_matrix(row, col, seed)
        assert m.sum(1).tolist() == row and m.sum(0).tolist() == col
        total += m
    assert np.abs(total / 3000 - np.outer(row, col) / 15).max() < 0.1
    rng = np.random.default_rng(0)
    far = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(20)]
    assert abs(np.mean(far) - 300_000) < 600


def test_packing_round_trip(docs, nothing, rows):
    encoder = packing.Encoder()
    pieces = packing.token_pieces(docs, 16, with_ids=True)
    out = packing.packed(pieces, 16, rows_per_run=20).toPandas()
    want = Counter()
    for r in rows:
        ids = encoder.exact.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 16):
            part = np.array(ids[s : s + 16], "<u4").tobytes()
            want[(r[0], s, len(part) // 4, zlib.crc32(part), len(ids), part)] += 1
    got = Counter((None if k != k else int(k), *(int(v) for v in r), bytes(b)) for k, *r, b in out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]].itertuples(index=False))
    assert got == want
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered["offset"] == ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]).all()
    assert ordered.groupby("sequence_id")["length"].sum().max() <= 16
    assert sorted(set(out["sequence_id"])) == list(range(out["sequence_id"].nunique()))
    assert packing.packed(packing.token_pieces(nothing, 16), 16).count() == 0


def test_shortest_pack_first_places_all():
    rng = np.random.default_rng(1)
    hist = {int(k): int(v) for k, v in zip(range(1, 101), rng.integers(0, 50, 100), strict=True)}
    packs = packing.shortest_pack_first(hist, 100)
    placed = Counter()
    for pattern, n in packs:
        assert sum(pattern) <= 100
        for x in pattern:
            placed[x] += n
    assert placed == Counter({k: v for k, v in hist.items() if v})
    assert sum(k * v for k, v in hist.items()) / 100 / sum(n for _, n in packs) > 0.95


def naive_phrases(text):
    seen, start, end = set(), 0, 1
    while end <= len(text):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
        end += 1
    return seen


def test_phrases(docs, nothing, rows):
    for _, t, *_ in rows:
        seen = set()
        fingerprints.parse(t or "", 0, seen, [])
        assert seen == naive_phrases(t or "")
        assert fingerprints.likeness(fingerprints.fingerprint(t or ""), fingerprints.fingerprint(t or "")) == 1
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = bag(fingerprints.edit_likeness(docs, rows_per_run=5), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    want = Counter()
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        changed = fingerprints.edited(text, after)
        own, other, following = (fingerprints.fingerprint(x) for x in (text, changed, after))
        want[(r[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), fingerprints.likeness(own, other), fingerprints.likeness(own, following))] += 1
    assert got == want
    assert fingerprints.edit_likeness(nothing).count() == 0


def test_likeness_follows_the_phrase_sets():
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abcdefgh "), 3000))
    near = base[:2900] + "".join(rng.choice(list("abcdefgh "), 100))
    far = "".join(rng.choice(list("ijklmnop "), 3000))
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f(base), f(near)) > 0.7 > 0.2 > fingerprints.likeness(f(base), f(far))


def words_of(t):
    return (t or "").encode().lower().split()


def naive_fingerprint(t, n):
    w = words_of(t)
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, nothing, rows):
    fps = {simhash.fingerprint(simhash.shingle_hashes(r[1], 3)) == naive_fingerprint(r[1], 3) for r in rows}
    assert fps == {True}
    out = simhash.simhash_components(simhash.fingerprinted(docs.select("doc_id", "text"), 3), 3).collect()
    assert len(out) == len(rows)
    f = {r["fp"] & (2**64 - 1) for r in out}
    group = {x: x for x in f}
    for x in f:
        for y in f:
            if (x ^ y).bit_count() <= 3:
                low = min(group[x], group[y])
                old = {group[x], group[y]}
                group = {k: low if v in old else v for k, v in group.items()}
    low = {}
    for r in out:
        if r["doc_id"] is not None:
            k = group[r["fp"] & (2**64 - 1)]
            low[k] = min(low.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == low.get(group[r["fp"] & (2**64 - 1)]) for r in out)
    assert simhash.simhash_components(simhash.fingerprinted(nothing.select("doc_id", "text"), 3), 3).count() == 0


@pytest.mark.parametrize("group_rows", [2, 10_000])
def test_links_of_dense_groups(spark, group_rows):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = {int(b) ^ int(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False))) for b in base for _ in range(30)}
    values = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    d = np.bitwise_count(values[:, None] ^ values[None])
    want = simhash.roots(len(values), iter([np.nonzero(d <= 3)]))
    links = simhash.simhash_links(df, 3, group_rows).collect()
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    a, b = (np.array([place[r[c]] for r in links], int) for c in "ab")
    assert (d[a, b] <= 64).all() and (simhash.roots(len(values), iter([(a, b)])) == want).all()
    pairs = {tuple(sorted(p)) for x, y in simhash.near_pairs(np.zeros(len(values)), values, 9) for p in zip(x, y, strict=True)}
    assert pairs == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if d[i, j] <= 9}


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(30):
        words = rng.choice(vocab, 300)
        copy = words.copy()
        copy[rng.choice(300, 5, replace=False)] = "other"
        texts += [" ".join(words), " ".join(copy)]
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(out[2 * i + 1] == 2 * i for i in range(30)) >= 29 and all(out[2 * i] == 2 * i for i in range(30))


def test_near_duplicates_verifies_pairs_beyond_the_nearest(spark):
    """Families of texts of which the likest pairs fall short of the similarity and a few others reach it: all are found."""
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(3):
        base = rng.choice(vocab, 200)
        for _ in range(60):
            own = base.copy()
            n = rng.integers(2, 5)
            own[rng.choice(200, n, replace=False)] = rng.choice(vocab, n)
            texts.append(" ".join(own))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    a, b = np.array(near).T
    want = simhash.roots(len(texts), iter([(a, b)]))
    assert len(set(want.tolist())) > 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for thin in (1, 1000):
        out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, radius=30, thin=thin).collect()}
        assert sum(out[i] != want[i] for i in range(len(texts))) <= 3  # pairs that share no table


def test_near_duplicates_of_one_large_family(spark):
    """Copies of one text with up to nine words changed: the near ones unite, the others are told apart within the groups; rows that are there twice, nulls and clashing names do no harm."""
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(3000)]
    base = rng.choice(vocab, 150)
    texts = []
    for i in range(400):
        own = base.copy()
        own[rng.choice(150, i % 10, replace=False)] = rng.choice(vocab[:40], i % 10)
        texts.append(" ".join(own))
    texts += [texts[5], None, "", " ".join(rng.choice(vocab, 150))]
    rows = [*((i, t, 1, "x", 2) for i, t in enumerate(texts)), (5, texts[5], 1, "x", 2), (None, texts[7], 1, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s int, fp string, root int")
    sets = [set((simhash.shingle_hashes(t, 5) >> np.uint64(32)).tolist()) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    a, b = np.array(near).T
    want = simhash.roots(len(texts), iter([(a, b)]))
    assert 50 < len(set(want.tolist())) < 350
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    out = {r["doc_id"]: r["component_id"] for r in got}
    assert [out[i] for i in range(len(texts))] == want.tolist() and out[None] == want[7]


def test_united_near_duplicates_are_not_linked_again(spark, monkeypatch):
    """Links of a later step are of the roots of the step before, however many texts of a family these have united."""
    rng = np.random.default_rng(14)
    base = rng.choice([f"w{i}" for i in range(3000)], 150)
    texts = []
    for i in range(300):
        own = base.copy()
        own[rng.choice(150, i % 10, replace=False)] = rng.choice(["x", "y", "z"], i % 10)
        texts.append(" ".join(own))
    calls, components = [], simhash.components

    def recorded(links):
        out = components(links)
        calls.append(({x for r in links.select("a", "b").collect() for x in r}, {r["node"]: r["root"] for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "components", recorded)
    simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    first = calls[0][1]
    assert len(calls) == 3 and first and all(first.get(x, x) == x for ends, _ in calls[1:] for x in ends)


def test_near_pairs_leave_out_what_is_united():
    rng = np.random.default_rng(17)
    fps = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    group, root = rng.integers(0, 3, 400), rng.integers(0, 4, 400)
    got = {tuple(sorted(p)) for a, b in simhash.near_pairs(group, fps, 3, root=root) for p in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if near[i, j] and group[i] == group[j] and root[i] != root[j]}
    assert want <= got and all(root[i] != root[j] or (i, j) in got for i, j in want)
    assert {p for p in got if root[p[0]] != root[p[1]]} == want


def test_large_groups_are_cut_into_chunks(monkeypatch):
    """Chunks with pivots propose links that unite a family, and the second look at what they left finds all other pairs."""
    monkeypatch.setattr(simhash, "CHUNK", 40)
    rng = np.random.default_rng(18)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    fps = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    table = pa.table({"s": np.arange(300), "g": np.zeros(300, np.int32), "fp": fps.view(np.int64), "bits": np.zeros(300, np.int64)})
    out = pa.Table.from_batches(list(simhash.close_pairs(iter(table.to_batches()), 4, 40, 0.8, 1))).to_pandas()
    links = out[out["kind"] > 0]
    assert set(links["a"]) == set(range(300)) and out["open"].notna().sum() == 1
    a, b = links["a"].to_numpy(int), links["b"].to_numpy(int)
    assert len(set(simhash.roots(300, iter([(a, b)])).tolist())) == 1 and (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()


def test_proposals_and_links_of_a_task_follow_its_nodes():
    """A family that is in many groups of a task gets a row for each node and kind of proposal, and as many links as connect it, not one for each group or pair."""
    rng = np.random.default_rng(19)
    n, groups = 60, 12
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    fps = (base ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))).view(np.int64)
    bits = rng.integers(0, 8, n)
    every = np.arange(n * groups) % n
    columns = {"s": every, "g": (np.arange(n * groups) // n).astype(np.int32), "fp": fps[every], "bits": bits[every]}
    run = lambda table, thin: pa.Table.from_batches(list(simhash.close_pairs(iter(table.to_batches()), 4, 40, 0.8, thin))).to_pandas()
    out = run(pa.table(columns), 1)
    named = out[out["kind"] > 0].astype(int, errors="ignore")
    assert out["open"].notna().sum() == groups and len(named) <= 2 * n and not (named["kind"] == 0).any()
    same = 64 - np.bitwise_count((bits[:, None] ^ bits[None]).astype(np.uint64)).astype(int)
    np.fill_diagonal(same, -1)
    for a, b, kind, weight in named[["a", "b", "kind", "weight"]].astype(int).itertuples(index=False):
        if kind & simhash.LIKE:
            assert weight % (1 << simhash.AGREED) == same[a].max() and b == same[a].argmax()
        if kind & simhash.HUB:
            assert b == (0 if a else 1) and weight >> simhash.AGREED == n - 1
    for kind in (simhash.LIKE, simhash.HUB):
        assert sorted(named.loc[named["kind"].astype(int) & kind > 0, "a"].astype(int)) == list(range(n))

    one = pa.table(columns | {"root": every, "size": np.full(len(every), 100), "own": np.zeros(len(every), np.int64), "hub": np.zeros(len(every), np.int64)})
    links = run(one.append_column("delta", pa.array([[]] * len(every), pa.list_(pa.int32()))), None)
    assert len(links) == n - 1 and (links["weight"] == 1).all()
    assert len(set(simhash.roots(n, iter([(links["a"].to_numpy(int), links["b"].to_numpy(int))])).tolist())) == 1


def test_both_proposals_of_a_node_are_one_row_of_a_task(spark, monkeypatch):
    """A node gives one row in a task for both kinds of proposals, which are those of close_pairs."""
    rng = np.random.default_rng(20)
    base = rng.choice([f"w{i}" for i in range(3000)], 150)
    texts = []
    for i in range(300):
        own = base.copy()
        own[rng.choice(150, i % 10, replace=False)] = rng.choice(["x", "y", "z"], i % 10)
        texts.append(" ".join(own))
    calls, candidates = [], simhash.candidates

    def recorded(nodes, *args, **kind):
        out = simhash.saved(candidates(nodes, *args, **kind).withColumn("task", F.spark_partition_id()))
        calls.append((nodes, args, out))
        return out.drop("task")

    monkeypatch.setattr(simhash, "candidates", recorded)
    simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    nodes, args, out = calls[0]
    rows = out.where("kind > 0").collect()
    assert len({r["task"] for r in rows}) > 1 and len({(r["task"], r["a"]) for r in rows}) == len(rows)
    monkeypatch.setattr(simhash, "with_hubs", lambda batches: (b.append_column("hub", pa.nulls(len(b), pa.int64())).append_column("partners", pa.nulls(len(b), pa.int64())) for b in batches))
    want = set()
    for r in candidates(nodes, *args).where("kind > 0").collect():
        want |= {("like", r["a"], r["b"], r["weight"] % (1 << simhash.AGREED))} if r["kind"] & simhash.LIKE else set()
        want |= {("hub", r["a"], r["b"], r["weight"] >> simhash.AGREED)} if r["kind"] & simhash.HUB else set()
    assert want == {("like", r["a"], r["b"], r["weight"]) for r in rows} | {("hub", r["a"], r["hub"], r["partners"]) for r in rows}


def test_near_duplicates_recall_at_the_similarity(spark):
    """Pairs of texts at similarity 0.8 or just above, and of repeated shingles, are found."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(400):
        words = rng.choice(vocab, 190)
        copy = words.copy()
        copy[[20, 60, 100, 140][: 4 if i % 2 else 3]] = "other"
        line = " ".join(rng.choice(vocab, 3)) + " "
        texts += [" ".join(words), line * (60 if i % 4 == 0 else 0) + " ".join(copy)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = [i for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(near) > 350
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(out[i + 1] == i for i in near) >= 0.99 * len(near)


def test_near_duplicates_verifies_equal_fingerprints(spark):
    """A line repeated often fixes a fingerprint of all shingles, whatever else the texts hold; without it, equal fingerprints are no proof."""
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(3000)]
    texts = ["one two three four five " * 200 + " ".join(rng.choice(vocab, 150)) for _ in range(6)]
    texts += [texts[0].upper(), "  " + texts[1], "", None, "one two"]
    assert len({simhash.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts[:6]}) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0, 7: 1, 8: 8, 9: 8, 10: 10}
    few = spark.createDataFrame([(0, "a b c d e f"), (1, "g h i j k l")], "doc_id long, text string")
    equal = simhash.fingerprint_list
    try:
        simhash.fingerprint_list = lambda hashes, count: [0] * count
        assert {r["component_id"] for r in simhash.near_duplicates(few).collect()} == {0, 1}
    finally:
        simhash.fingerprint_list = equal


def covered(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                mask[i : i + size] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("size", [100, 400])
def test_suffix(docs, nothing, rows, size):
    raw = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, m in zip(rows, raw, covered(raw, size), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        edge = [0, *(np.flatnonzero(np.diff(m)) + 1).tolist(), len(t)]
        pieces = [t[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True) if j > i and not m[i]]
        want[r[0], kept, "".join(p.decode("utf-8", "ignore") for p in pieces) if m.any() else r[1] or ""] += 1
    clash = docs.withColumn("kept", F.lit(1)).withColumn("k", F.lit("extra")).withColumn("t", F.lit(0))
    assert bag(suffix.without_repeats(clash, size), "doc_id", "kept", "kept_text") == want
    assert suffix.without_repeats(nothing, size).count() == 0


def test_suffix_cuts_no_character_in_two(spark):
    rng = np.random.default_rng(3)
    core = "".join(rng.choice(list("abcdé漢😀 "), 200))
    texts = ["x漢" + core + "漢y", "z字" + core + "字w", "é" + core, "è" + core]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["kept_text"] for r in suffix.without_repeats(df, 100).collect()}
    raw = [t.encode() for t in texts]
    for i, (t, m) in enumerate(zip(raw, covered(raw, 100), strict=True)):
        edge = [0, *(np.flatnonzero(np.diff(m)) + 1).tolist(), len(t)]
        assert out[i] == "".join(t[a:b].decode("utf-8", "ignore") for a, b in zip(edge[:-1], edge[1:], strict=True) if not m[a])


@pytest.mark.parametrize("group_rows", [2, 128])
def test_suffix_of_shared_anchors(spark, group_rows):
    """Many different fragments about one anchor, matches of exactly the length and one byte less, a text twice, a text within itself."""
    rng = np.random.default_rng(13)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    core = say(260)
    texts = [say(rng.integers(0, 60)) + core[int(rng.integers(0, 60)) : 260 - int(rng.integers(0, 60))] + say(rng.integers(0, 60)) for _ in range(60)]
    one, two, three = say(120), say(119), say(150)
    texts += ["p" + one + "q", "r" + one + "s", "t" + two + "u", "v" + two + "w", texts[0], three + "-" + three, "a" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("t", F.xxhash64("text"))
    raw = [t.encode() for t in texts]
    masks = [np.zeros(len(t), bool) for t in raw]
    for r in suffix.repeat_spans(df, 120, group_rows).collect():
        masks[r["k"]][r["a"] : r["e"]] = True
    assert [m.tolist() for m in masks] == [m.tolist() for m in covered(raw, 120)]


def test_suffix_of_texts_beyond_a_segment(spark):
    rng = np.random.default_rng(14)
    long = rng.integers(97, 123, suffix.SEGMENT + 3000, dtype=np.uint8)
    for at in (100, suffix.SEGMENT - 600, suffix.SEGMENT - 399, suffix.SEGMENT + 5, suffix.SEGMENT + 1500):
        long[at : at + 500] = long[2000:2500]
    texts = [bytes(long).decode(), bytes(long[suffix.SEGMENT - 1000 : suffix.SEGMENT + 700]).decode()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in suffix.without_repeats(df).collect()}
    raw = [t.encode() for t in texts]
    for i, (t, m) in enumerate(zip(raw, covered(raw, 400), strict=True)):
        assert bytes(got[i]) == bytes(np.frombuffer(t, np.uint8)[~m])


def test_run_index():
    rng = np.random.default_rng(6)
    core = bytes(rng.integers(97, 101, 300, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 99, 40, dtype=np.uint8)) + core[i * 9 : i * 9 + 80] for i in range(15)] + [b"a" * 90]
    small = [[bytes(rng.integers(97, 99, rng.integers(0, 12), dtype=np.uint8)) for _ in range(rng.integers(1, 6))] for _ in range(300)]
    for texts, sizes in [(texts, (8, 30)), *((t, (1, 3, 6)) for t in small)]:
        for size in sizes:
            got = suffix.RunIndex(texts).long_matches(size)
            seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
            assert [g.tolist() for g in got] == [[i for i in range(len(t) - size + 1) if seen[t[i : i + size]] > 1] for t in texts]


def test_topk(spark):
    rng = np.random.default_rng(7)
    vecs = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(300)]
    vecs += [(i, [0.1] * 16) for i in range(300, 420)] + [(420, None), (421, [float("nan")] * 16), (422, [None] + [0.0] * 15), (None, [0.3] * 16), (423, [1.0, 2.0]), (424, [float("inf")] * 16), (425, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    v = topk.integer_vectors(df)
    got = bag(topk.top_inner_products(v, v.where("vec_id % 20 = 0"), 20, pivots=8, block=16, query_block=8), "query_id", "rank", "vec_id", "score")
    good = {i: np.zeros(16, np.int64) for i, x in vecs if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    for i, x in vecs:
        if i in good:
            good[i][: len(x)] = np.floor(64 * np.array(x, np.float32).astype(float))
    want = Counter()
    for q in good:
        if q % 20 == 0:
            best = sorted((-int(good[q] @ good[o]), o) for o in good if o != q)[:20]
            want.update((q, n, o, -s) for n, (s, o) in enumerate(best, 1))
    assert got == want
    assert topk.top_inner_products(v.where("false"), v.where("false")).count() == 0


def test_lm(docs, nothing, rows):
    texts = [(r[1] or "").encode() for r in rows]
    ws = ["".join(chr(c) for c in t).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") for t in texts]
    ws = [[w for w in x if w] for x in ws]
    uni, bi = Counter(w for x in ws for w in x), Counter(p for x in ws for p in zip(x, x[1:], strict=False))
    total = sum(uni.values())
    want = Counter()
    for r, x in zip(rows, ws, strict=True):
        u, b, rest, score = Counter(x), Counter(zip(x, x[1:], strict=False)), total - len(x), 0
        for i, w in enumerate(x):
            one = uni[w] - u[w]
            s = np.log(one / rest) if one else np.log(0.4) - np.log(rest + 1)
            if i:
                two = bi[(x[i - 1], w)] - b[(x[i - 1], w)]
                s = np.log(two / (uni[x[i - 1]] - u[x[i - 1]])) if two else s + np.log(0.4)
            score += int(np.floor(s * 1e6 + 0.5))
        want[(r[0], len(x), score)] += 1
    got = bag(lm.lm_scores(docs), "doc_id", "n_tokens", "score_micro")
    assert sum(got.values()) == sum(want.values())
    for a, b in zip(sorted(got.elements(), key=str), sorted(want.elements(), key=str), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 2
    assert lm.lm_scores(nothing).count() == 0
    assert lm.lm_scores(docs, order=3).count() == len(rows)


def test_language(spark, docs, nothing, rows):
    rng = np.random.default_rng(8)
    own = {"aa": "ka lo mi ta re".split(), "bb": "zu xe vro pli gno".split()}
    texts = [(i, " ".join(rng.choice(own[k], 30)), k, None, None) for i in range(80) for k in own]
    train = spark.createDataFrame(texts[:100], DOCS)
    langs, proto = language.fit_language(train)
    assert langs == ["aa", "bb"]
    out = language.predict_language(spark.createDataFrame(texts[100:], DOCS).withColumn("score", F.lit("x")), langs, proto).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in out)
    odd = language.predict_language(docs, langs, proto)
    assert odd.count() == len(rows)
    assert {r["lang_pred"] for r in odd.where("text is null or text in ('', '  \n ', '12 34 !!')").collect()} == {"und"}
    assert language.fit_language(nothing)[0] == []
    assert {r["lang_pred"] for r in language.predict_language(docs, *language.fit_language(nothing)).collect()} == {"und"}


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    ids = np.sort(rng.integers(0, 6, (3, toxicity.WINDOW)), 1)[:, ::-1].copy()
    x = (rng.standard_normal((5, toxicity.FIXED + toxicity.WORD_DIM + toxicity.CHAR_DIM)) * 0.5).astype(np.float32)
    weights = np.array([1, -2, 0.5], np.float32)
    value = lambda: float((net.run(ids, {s: net.gates(x, s) for s in "fb"}) * weights).sum())
    keep = []
    net.run(ids, {s: net.gates(x, s) for s in "fb"}, keep)
    grads, _ = net.grads(ids, x, weights, keep)
    for k in ("uf", "ub", "xf", "bb", "att", "att_v", "out"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = value()
        net.p[k][at] = old - 1e-2
        down = value()
        net.p[k][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(grads[k][at]), rel=0.02, abs=1e-4)


def naive_logit(net, x):
    """One window's logit, word by word; x: the words' input vectors, at least one (or none: a window of padding)."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((max(len(x), 1), 2 * h))
    for k, side in enumerate("fb"):
        s = np.zeros(h)
        for t in range(len(x)) if side == "f" else reversed(range(len(x))):
            g, u = x[t] @ p[f"x{side}"] + p[f"b{side}"], p[f"u{side}"]
            z, r = sig(g[:h] + s @ u[:, :h]), sig(g[h : 2 * h] + s @ u[:, h : 2 * h])
            s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * (s @ u[:, 2 * h :]))
            states[t, k * h : (k + 1) * h] = s
    a = np.exp(np.tanh(states @ p["att"] + p["att_b"]) @ p["att_v"])
    return float(a / a.sum() @ states @ p["out"] + p["out_b"][0])


def test_toxicity_scores_every_window(rows):
    rng = np.random.default_rng(15)
    texts = [r[1] for r in rows if r[1] is None or len(r[1]) < 1500]
    net = toxicity.train(texts[:40], rng.integers(0, 2, 40), 0.3, rounds=2, steps=20)
    got = toxicity.Scorer(net)(texts)
    for t, g in zip(texts, got, strict=True):
        x = net.embed(*net.inputs(toxicity.word_list(t))).astype(float)
        want = max(naive_logit(net, x[i : i + toxicity.WINDOW]) for i in range(max(1, len(x) - toxicity.WINDOW + 1)))
        assert g == pytest.approx(want, abs=2e-3)
    assert toxicity.Scorer(net)(["", None, "one two"]).shape == (3,) and len(toxicity.Scorer(net)([])) == 0
    long = " ".join(rng.choice(WORDS, 45_000))
    words = long.split()
    assert toxicity.Scorer(net)([long])[0] == pytest.approx(max(toxicity.Scorer(net)([" ".join(words[i : i + 5010]) for i in range(0, 45_000, 5000)])), abs=1e-4)


def test_toxicity(spark, docs, nothing, rows):
    rng = np.random.default_rng(9)
    text = lambda bad: " ".join([*rng.choice(WORDS, rng.integers(20, 120)), *(["grimble" + rng.choice(["a", "ox", "ing"])] if bad else []), *rng.choice(WORDS, 20)])
    labelled = [(1000 + i, text(i % 3 == 0), None, None, None) for i in range(240)]
    labels = spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(180)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    every = docs.unionByName(spark.createDataFrame(labelled, DOCS))
    net = toxicity.fit_toxicity(every, labels)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(every.select("doc_id", "text"), net).collect()}
    assert all(out[1000 + i]["predicted"] == int(i % 3 == 0) for i in range(180, 240))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert toxicity.score_toxicity(docs, net).count() == len(rows)
    assert toxicity.score_toxicity(nothing, net).count() == 0
    few = toxicity.fit_toxicity(every, labels, most_bytes=20_000)
    assert np.isfinite(few.p["out_b"]).all()
    clash = every.withColumn("score", F.lit("x")).withColumn("predicted", F.lit(7)).withColumn("key", F.lit(1))
    assert toxicity.score_toxicity(clash, net).where("score between 0 and 1").count() == every.count()
    blank = toxicity.fit_toxicity(nothing, labels.where("false"))
    assert toxicity.score_toxicity(docs, blank).where("score is null").count() == 0


def evidence(text):
    tokens = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", (text or "").lower())
    own = set(tokens)
    often = f"#{int(np.floor(2 * np.log2(len(tokens) / len(own))))}" if own else "#none"
    return own | {"^" + w[: mixing.BEGINNING] for w in own if len(w) > mixing.BEGINNING} | {often}


def test_mixing(spark, docs, nothing, rows):
    rng = np.random.default_rng(10)
    kinds = {"good": ["fine", "clearing"], "low": ["spam", "buying"], "toxic": ["nasty", "vilest"]}
    own = np.repeat(list(kinds), [180, 90, 90])
    texts = [(i, " ".join([*rng.choice(WORDS, 40), *rng.choice(kinds[k], 5)]), None, None, None) for i, k in enumerate(own)]
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(own.tolist())], "doc_id long, domain string")
    df = spark.createDataFrame(texts, DOCS)
    targets = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    out = mixing.mixed(df, labels, targets).toPandas()
    mass = {d: (out["rate"] * out["n_tokens"] * out[f"p_{d}"]).sum() / out["n_tokens"].sum() for d in kinds}
    assert all(abs(mass[d] - targets[d]) < 0.001 for d in kinds) and (out["rate"] >= 0).all()
    odd = mixing.mixed(docs.withColumn("k", F.lit(1)).withColumn("copies", F.lit("x")), labels, targets)
    assert odd.count() == len(rows) and odd.where("rate is null or n_tokens is null").count() == 0
    with pytest.warns(UserWarning, match="no document rates"):
        assert mixing.mixed(df, labels.where("false"), targets).where("abs(p_good + p_low + p_toxic - 1) > 1e-9").count() == 0
    assert mixing.mixed(nothing, labels, targets).count() == 0


def test_posteriors_against_brute_force(spark, docs, rows):
    rng = np.random.default_rng(11)
    kinds = {"good": ["fine", "clearing"], "low": ["spam!!", "buying"], "toxic": ["nasty", "vilest"]}
    own = np.repeat(list(kinds), 60)
    texts = [(1000 + i, " ".join([*rng.choice(WORDS, rng.integers(2, 40)), *rng.choice(kinds[k], 2)]), None, None, None) for i, k in enumerate(own)]
    labels = spark.createDataFrame([(1000 + i, k) for i, k in enumerate(own.tolist())] + [(None, "low"), (1000, None)], "doc_id long, domain string")
    every = docs.unionByName(spark.createDataFrame(texts, DOCS))
    coefficients, weights = mixing.fit_domains(every, labels)
    weight = {r["bucket"]: np.array([r[d] for d in mixing.DOMAINS]) for r in weights.collect()}
    shown = sorted(set().union(*(evidence(r[1]) for r in [*rows, *texts])))
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in shown], "w string").select("w", mixing._bucket(F.col("w")).alias("b")).collect()}
    want = {}
    for r in [*rows, *texts]:
        x = np.append(sum((weight.get(bucket[w], np.zeros(3)) for w in evidence(r[1])), np.zeros(3)), 1.0)
        z = np.exp(np.array([0.0, *(np.array(coefficients) @ x)]))
        want[r[0], r[1] or ""] = (len(words_of(r[1])), z / z.sum())
    got = every.select("doc_id", "text").distinct().join(mixing.domain_posteriors(every, coefficients, weights), F.expr("doc_id <=> k and xxhash64(coalesce(text, '')) = t")).collect()
    assert len(got) == len(want)
    for r in got:
        n, p = want[r["doc_id"], r["text"] or ""]
        assert r["n_tokens"] == n and np.abs(p - [r[f"p_{d}"] for d in mixing.DOMAINS]).max() < 1e-9
    labelled = [r for r in got if (r["doc_id"] or 0) >= 1000]
    assert sum(max(kinds, key=lambda d: r[f"p_{d}"]) == own[r["doc_id"] - 1000] for r in labelled) > 0.95 * len(labelled)


@pytest.mark.parametrize(("targets", "most"), [((0.8, 0.15, 0.05), None), ((0.34, 0.33, 0.33), None), ((0.9, 0.08, 0.02), 1.0), ((0.01, 0.01, 0.98), None)])
def test_rates_are_optimal(spark, targets, most):
    """No other solver gets a smaller objective: projected gradient from many steps, and the optimality conditions."""
    rng = np.random.default_rng(12)
    p = rng.dirichlet([0.5, 0.3, 0.2], 300)
    n = rng.integers(0, 500, 300)
    df = spark.createDataFrame([(1, int(k), *map(float, x)) for k, x in zip(n, p, strict=True)], "copies long, n_tokens long, p_good double, p_low double, p_toxic double")
    goal = dict(zip(mixing.DOMAINS, targets, strict=True))
    out, at, residual = mixing.mixing_rates(df, goal, most=most)
    got = out.toPandas()
    p, n, r = got[["p_good", "p_low", "p_toxic"]].to_numpy(), got["n_tokens"].to_numpy(), got["rate"].to_numpy()
    top = np.inf if most is None else most
    assert np.allclose(r, np.clip(1 + p @ np.array(at), 0, top))
    start, slack = n @ p, 1e-5
    want = np.array(targets) * n.sum()
    value = lambda r: (((r * n) @ p - want) ** 2 / start).sum() + slack * (n * (r - 1) ** 2).sum()
    other = np.ones(300)
    for _ in range(20_000):
        other = np.clip(other - 0.3 * (p @ (((other * n) @ p - want) / start) + slack * (other - 1)), 0, top)
    assert value(r) <= value(other) * 1.001 + 1e-6 * n.sum()
    assert abs(residual - np.abs((r * n) @ p - want).max() / n.sum()) < 1e-9


def test_tokens_of_random_unicode():
    """The fast path gives what the tokenizer gives, whatever the characters."""
    rng = np.random.default_rng(16)
    pools = [(32, 127), (0, 32), (0xA0, 0x250), (0x2010, 0x2028), (0x370, 0x600), (0x1E00, 0x2100), (0x3040, 0x3100), (0x4E00, 0x5000), (0x1F300, 0x1F700), (0x0, 0xD800)]
    encoder = packing.Encoder()
    for i in range(600):
        low, high = pools[i % len(pools)]
        text = "".join(chr(c) for c in rng.integers(low, high, rng.integers(0, 60)) if not 0xD800 <= c < 0xE000)
        text = text + rng.choice(["", " ", "  \n", "'s ", " <|endoftext|> "]) + "".join(rng.choice(list("ab 1'.\t"), 10))
        assert encoder(text) == np.array(encoder.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_language_of_held_out_documents(spark):
    out = language.op2_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in out)


def test_shards_are_drawn_uniformly(spark):
    """Over many seeds a row falls into each shard, and into each slot of it, about equally often."""
    df = spark.range(12).cache()
    shard, slot = np.zeros((12, 3)), np.zeros((12, 4))
    for seed in range(40):
        for r in sharding.shuffled_shards(df, 3, seed=1000 * seed, rows_per_part=5, rows_per_run=2).collect():
            shard[r["id"], r["shard"]] += 1
            slot[r["id"], r["slot"]] += 1
    for seen in (shard, slot):
        expected = 40 / seen.shape[1]
        assert ((seen - expected) ** 2 / expected).sum() < 12 * (seen.shape[1] - 1) * 1.9
