"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SliceHash, held_out, table

WINDOW = 5  # words; a window begins at every word
FOLDS = 4  # of the training documents, for their log-odds
HIDDEN, ATTENTION, WORD_DIM, CHAR_DIM, FIXED = 8, 4, 4, 4, 3
TABLE = 1 << 16
WORD_ROWS, CHAR_ROWS = 4096, 8192
_WORDS = re.compile(r"\w+").findall
_HASH = SliceHash()
_EDGE = "\x02"


def word_list(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, hashes of the 3- to 5-character slices of all words (edges marked), and where each word's begin. Many words are taken in turn, to keep memory low."""
    if len(words) > 20_000:
        parts = [gram_hashes(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        before = np.cumsum([0, *(len(g) for _, g, _ in parts[:-1])])
        return np.concatenate([w for w, _, _ in parts]), np.concatenate([g for _, g, _ in parts]), np.concatenate([b + n for (_, _, b), n in zip(parts, before, strict=True)])
    codes = np.frombuffer((_EDGE + _EDGE.join(words) + _EDGE).encode("utf-32-le", "surrogatepass"), np.uint32)
    prefix = _HASH.prefix(codes)
    edge = np.flatnonzero(codes == 2)
    lo, hi = edge[:-1], edge[1:] + 1  # with both edges
    owner = np.repeat(np.arange(len(words)), hi - lo)
    at = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + lo[owner]
    hashes, owners = [], []
    for n in (3, 4, 5):
        ok = at + n <= hi[owner]
        hashes.append(_HASH.slices(prefix, at[ok], at[ok] + n))
        owners.append(owner[ok])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    begin = np.searchsorted(own[order], np.arange(len(words)))
    return _HASH.slices(prefix, lo, hi), np.concatenate(hashes)[order], begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Inputs of a word: log-odds of its hash, the largest and mean log-odds of its character slices (from training
    documents), a word vector and the mean of its slices' vectors. Two gated recurrent layers read a window, one from
    each end; attention pools their states; one logit comes out."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        d, h = FIXED + WORD_DIM + CHAR_DIM, HIDDEN
        self.word_odds, self.gram_odds = np.zeros(TABLE, np.float32), np.zeros(TABLE, np.float32)
        w = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"words": w(WORD_ROWS, WORD_DIM, k=0.05), "chars": w(CHAR_ROWS, CHAR_DIM, k=0.05), "att": w(2 * h, ATTENTION), "att_b": w(ATTENTION, k=0), "att_v": w(ATTENTION), "out": w(2 * h), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": w(d, 3 * h), f"b{side}": w(3 * h, k=0), f"u{side}": w(h, 3 * h)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fixed inputs, word rows, slice rows and their beginnings; for no word too."""
        if not words:
            return np.zeros((0, FIXED), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, gram, begin = gram_hashes(words)
        odds = self.gram_odds[gram % np.uint64(TABLE)]
        count = np.diff([*begin, len(gram)])
        fixed = np.stack([self.word_odds[word % np.uint64(TABLE)], np.maximum.reduceat(odds, begin), np.add.reduceat(odds, begin) / count], axis=1)
        return fixed.astype(np.float32), (word % np.uint64(WORD_ROWS)).astype(np.int64), (gram % np.uint64(CHAR_ROWS)).astype(np.int64), begin

    def embed(self, fixed: np.ndarray, word: np.ndarray, gram: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros((0, FIXED + WORD_DIM + CHAR_DIM), np.float32)
        count = np.diff([*begin, len(gram)])[:, None].astype(np.float32)
        return np.concatenate([fixed, self.p["words"][word], np.add.reduceat(self.p["chars"][gram], begin) / count], axis=1)

    def gates(self, x: np.ndarray, side: str) -> list[np.ndarray]:
        """Inputs of the update, reset and candidate gates of each word; the row of the padding, all zero, comes first.
        Those of the first two are halved, for the sigmoid is half a tanh."""
        g = np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), x @ self.p[f"x{side}"] + self.p[f"b{side}"]])
        return [np.ascontiguousarray(g[:, k * HIDDEN : (k + 1) * HIDDEN]) * np.float32(f) for k, f in enumerate((0.5, 0.5, 1))]

    def run(self, ids: np.ndarray, gates: dict[str, list[np.ndarray]], keep: list | None = None) -> np.ndarray:
        """Logits of windows: ids (windows x WINDOW) of rows of gates, 0 where the window is padded at its end."""
        n, h, half = len(ids), HIDDEN, np.float32(0.5)
        turned = np.ascontiguousarray(ids.T)
        full = bool(ids.all())
        states = np.zeros((len(turned), n, 2 * h), np.float32)
        for k, side in enumerate("fb"):
            u = self.p[f"u{side}"]
            uz, ur, un = u[:, :h] * half, u[:, h : 2 * h] * half, np.ascontiguousarray(u[:, 2 * h :])
            gz, gr, gn = gates[side]
            s = np.zeros((n, h), np.float32)
            for t in range(len(turned)) if side == "f" else range(len(turned) - 1, -1, -1):
                at = turned[t]
                z, r, cand, rn = gz.take(at, 0), gr.take(at, 0), gn.take(at, 0), s @ un
                for gate, weight in ((z, uz), (r, ur)):
                    gate += s @ weight
                    np.tanh(gate, out=gate)
                    gate *= half
                    gate += half
                cand += r * rn
                np.tanh(cand, out=cand)
                new = s - cand
                new *= z
                new += cand
                on = None if full else (at > 0)[:, None]
                if keep is not None:
                    keep.append((side, t, s, z, r, cand, rn, True if full else on))
                s = new if full else np.where(on, new, s)
                states[t, :, k * h : (k + 1) * h] = s
        e = states.reshape(-1, 2 * h) @ self.p["att"]
        e += self.p["att_b"]
        e = np.tanh(e, out=e).reshape(len(turned), n, -1)
        a = e @ self.p["att_v"]
        if not full:
            a = np.where(turned > 0, a, np.float32(-30))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        if keep is not None:
            keep.append((states, e, a, pooled))
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def slide(self, words: np.ndarray, gates: dict[str, list[np.ndarray]]) -> np.ndarray:
        """run() of the windows that begin at every word of a row of words: their steps are stretches of the same gate inputs, and the first
        step, from the empty state, is made once a word."""
        n, h, half = len(words) - WINDOW + 1, HIDDEN, np.float32(0.5)
        if n < 1:
            return np.zeros(0, np.float32)
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        for k, side in enumerate("fb"):
            u = self.p[f"u{side}"]
            uz, ur, un = u[:, :h] * half, u[:, h : 2 * h] * half, np.ascontiguousarray(u[:, 2 * h :])
            gz, gr, gn = (g[words] for g in gates[side])
            begin = np.tanh(gn) * (half - half * np.tanh(gz))
            order = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
            s = begin[order[0] : order[0] + n]
            states[order[0], :, k * h : (k + 1) * h] = s
            for t in order[1:]:
                z, r = gz[t : t + n] + s @ uz, gr[t : t + n] + s @ ur
                for gate in (z, r):
                    np.tanh(gate, out=gate)
                    gate *= half
                    gate += half
                r *= s @ un
                r += gn[t : t + n]
                np.tanh(r, out=r)
                new = s - r
                new *= z
                new += r
                s = new
                states[t, :, k * h : (k + 1) * h] = s
        e = states.reshape(-1, 2 * h) @ self.p["att"]
        e += self.p["att_b"]
        a = np.tanh(e, out=e).reshape(WINDOW, n, -1) @ self.p["att_v"]
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        return np.einsum("tn,tn->n", a, states @ self.p["out"]) + self.p["out_b"][0]

    def grads(self, ids: np.ndarray, x: np.ndarray, d_logit: np.ndarray, keep: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of x, for those of the logits."""
        p, h = self.p, HIDDEN
        states, e, a, pooled = keep.pop()
        out = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_s = a * (d_a - (a * d_a).sum(0))
        out["att_v"] = np.einsum("tn,tnh->h", d_s, e)
        d_e = d_s[:, :, None] * p["att_v"] * (1 - e * e)
        out["att"] = np.einsum("tni,tnj->ij", states, d_e)
        out["att_b"] = d_e.sum((0, 1))
        d_states += d_e @ p["att"].T
        d_x = np.zeros_like(x)
        carry: dict[str, np.ndarray] = {}
        for side in "fb":
            out |= {f"u{side}": np.zeros_like(p[f"u{side}"]), f"x{side}": np.zeros_like(p[f"x{side}"]), f"b{side}": np.zeros_like(p[f"b{side}"])}
        while keep:
            side, t, s, z, r, cand, rn, on = keep.pop()
            k = slice(0, h) if side == "f" else slice(h, 2 * h)
            d = d_states[t, :, k] + carry.get(side, 0)
            d_new = np.where(on, d, 0)
            d_cand = d_new * (1 - z) * (1 - cand * cand)
            d_z = d_new * (s - cand) * z * (1 - z)
            d_r = d_cand * rn * r * (1 - r)
            d_rec = np.concatenate([d_z, d_r, d_cand * r], axis=1)
            d_gate = np.concatenate([d_z, d_r, d_cand], axis=1)
            carry[side] = np.where(on, 0, d) + d_new * z + d_rec @ p[f"u{side}"].T
            out[f"u{side}"] += s.T @ d_rec
            rows = ids[:, t]
            seen = rows > 0
            out[f"x{side}"] += x[rows[seen] - 1].T @ d_gate[seen]
            out[f"b{side}"] += d_gate[seen].sum(0)
            np.add.at(d_x, rows[seen] - 1, d_gate[seen] @ p[f"x{side}"].T)
        return out, d_x


def joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' word rows one after the other, each padded by zeros to a window at least; where each begins, and how many windows it has."""
    sizes = np.array([max(len(r), WINDOW) for r in rows], np.int64)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int64)
    for r, b in zip(rows, begin, strict=True):
        out[b : b + len(r)] = r
    return out, begin, sizes - WINDOW + 1


def largest(net: Network, gates: dict[str, list[np.ndarray]], rows: list[np.ndarray], step: int = 16_384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: the largest logit of its overlapping windows (one begins at every word), where that window begins in the joined words; and these words.

    Windows without padding are read off the joined words, all that begin in a stretch at once; windows that lie over two documents
    are made, and left out. A document shorter than a window is its own, padded."""
    words, begin, count = joined(rows)
    logit = np.full(len(words), -np.inf, np.float32)
    for i in range(0, len(words) - WINDOW + 1, step):
        logit[i : i + min(step, len(words) - WINDOW + 1 - i)] = net.slide(words[i : i + step + WINDOW - 1], gates)
    short = np.array([i for i, r in enumerate(rows) if len(r) < WINDOW], np.int64)
    for i in range(0, len(short), 4096):
        at = begin[short[i : i + 4096]]
        logit[at] = net.run(words[at[:, None] + np.arange(WINDOW)], gates)
    inside = np.zeros(len(words), bool)
    inside[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())] = True
    logit = np.where(inside, logit, -np.inf)
    best = np.maximum.reduceat(logit, begin)
    where = np.flatnonzero(logit == np.repeat(best, count + WINDOW - 1))
    owner = np.searchsorted(begin, where, "right") - 1
    return best, where[np.unique(owner, return_index=True)[1]], words


class Scorer:
    """Logits of texts: the largest of each text's windows. Words' gate inputs are kept, up to `most` words."""

    def __init__(self, net: Network, most: int = 150_000) -> None:
        self.net, self.most = net, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.gates = {side: [np.zeros((1, HIDDEN), np.float32)] * 3 for side in "fb"}

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > self.most:
            self.clear()
        lists = [word_list(t) for t in texts]
        new = list({w for ws in lists for w in ws if w not in self.index})
        if new:
            start = len(self.index) + 1
            self.index.update(zip(new, range(start, start + len(new)), strict=True))
            x = self.net.embed(*self.net.inputs(new))
            for side in "fb":
                self.gates[side] = [np.concatenate([a, b[1:]]) for a, b in zip(self.gates[side], self.net.gates(x, side), strict=True)]
        find = self.index.__getitem__
        return [np.fromiter(map(find, ws), np.int64, len(ws)) for ws in lists]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return largest(self.net, self.gates, self.rows(texts))[0].astype(np.float64)


def _log_odds(hashes: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """Of each bucket: log of the share of toxic documents with it over that of the others, drawn to 0 where rare; by the documents
    of all other folds for each fold, and last by all."""
    seen = np.zeros((FOLDS, 2, TABLE))
    size = np.zeros((FOLDS, 2))
    for h, k, f in zip(hashes, y, fold, strict=True):
        seen[f, k, np.unique(h % np.uint64(TABLE)).astype(np.int64)] += 1
        size[f, k] += 1
    out = []
    for f in range(FOLDS + 1):
        n, total = seen.sum(0), np.maximum(size.sum(0), 1)
        if f < FOLDS:
            n, total = n - seen[f], np.maximum(size.sum(0) - size[f], 1)
        out.append(np.log((n[1] / total[1] + 4 / total.sum()) / (n[0] / total[0] + 4 / total.sum())).astype(np.float32))
    return out


def train(texts: list[str | None], y: np.ndarray, prior: float, seed: int = 0, rounds: int = 5, steps: int = 200, batch: int = 64, rate: float = 0.02) -> Network:
    """Fits on documents' labels: each round takes every document's largest window (at first by the log-odds) and trains
    on these. A document's log-odds come from the other folds' documents, so the network learns how far to trust them on texts that they have
    not seen; those of all documents stay in it. prior: the share of toxic documents, which the last bias is set for."""
    net, rng, y = Network(seed), np.random.default_rng(seed), np.asarray(y, np.int64)
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["out_b"][:] = np.log((prior + 1e-3) / (1 - prior + 1e-3))
        return net
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in word_list(t)], np.int64) for t in texts]
    vocab = list(place) or ["\x02"]
    word, gram, begin = gram_hashes(vocab)
    end = np.append(begin[1:], len(gram)).astype(np.int64)
    own = [np.unique(d) for d in docs]
    fold = rng.permutation(len(docs)) % FOLDS
    word_odds = _log_odds([word[u] for u in own], y, fold)
    gram_odds = _log_odds([np.concatenate([gram[begin[i] : end[i]] for i in u]) if len(u) else gram[:0] for u in own], y, fold)
    fixed = []
    for net.word_odds, net.gram_odds in zip(word_odds, gram_odds, strict=True):  # those of all come last and stay
        f, wrow, grow, begin = net.inputs(vocab)
        fixed.append(f)
    fixed = np.concatenate(fixed[:FOLDS])
    n = len(vocab)
    slot = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    chosen = np.zeros((len(docs), WINDOW), np.int64)
    for turn in range(rounds):
        for f in range(FOLDS):  # one fold's gate inputs at a time, to keep memory low
            part = np.flatnonzero(fold == f)
            if not len(part):
                continue
            rows, own_fixed = [docs[i] + 1 for i in part], fixed[f * n : (f + 1) * n]
            if turn:
                x = net.embed(own_fixed, wrow, grow, begin)
                at, words = largest(net, {side: net.gates(x, side) for side in "fb"}, rows)[1:]
            else:
                words, first, count = joined(rows)
                best = np.lib.stride_tricks.sliding_window_view(np.concatenate([[0.0], own_fixed[:, 0] + own_fixed[:, 1]])[words], WINDOW).max(1)
                at = np.array([a + best[a : a + c].argmax() for a, c in zip(first, count, strict=True)])
            ids = words[at[:, None] + np.arange(WINDOW)]
            chosen[part] = np.where(ids > 0, ids + f * n, 0)
        for _ in range(-(-steps * batch // len(y))):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                w = chosen[part]
                used, inverse = np.unique(w[w > 0] - 1, return_inverse=True)
                local = np.zeros_like(w)
                local[w > 0] = inverse + 1
                bare = used % n
                size = end[bare] - begin[bare]
                grams = grow[np.repeat(begin[bare] - (np.cumsum(size) - size), size) + np.arange(size.sum())] if len(used) else grow[:0]
                x = net.embed(fixed[used], wrow[bare], grams, (np.cumsum(size) - size).astype(np.int64))
                keep: list = []
                logit = net.run(local, {side: net.gates(x, side) for side in "fb"}, keep)
                grad, d_x = net.grads(local, x, ((_sigmoid(logit) - y[part]) / len(part)).astype(np.float32), keep)
                grad["words"], grad["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
                np.add.at(grad["words"], wrow[bare], d_x[:, FIXED : FIXED + WORD_DIM])
                np.add.at(grad["chars"], grams, np.repeat(d_x[:, FIXED + WORD_DIM :] / size[:, None], size, axis=0).astype(np.float32))
                step += 1
                for k, g in grad.items():
                    m, v = slot[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.p[k] -= (rate / (1 + step / 150) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    sampled = y.mean()
    net.p["out_b"] -= np.float32(np.log(sampled / (1 - sampled)) - np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_class: int = 2000, most_bytes: int = 48 << 20, seed: int = 0) -> Network:
    """Trains on about per_class labelled documents of either label (all, if fewer), chosen by a hash of the key, and of these, in the hash's
    order, on as many as most_bytes of whole texts hold; a longer text than what is left of them is passed over.

    Rows without key or label take no part; a key labelled twice counts twice. The driver gets these texts only.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    share = {k: min(1.0, per_class / max(1, counts.get(k, 0))) for k in (0, 1)}
    place = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_000)) / 1_000_000
    chosen = rows.where(place < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").withColumns({"t": F.xxhash64("text"), "place": place})
    left, take = most_bytes, []
    for r in sorted(found.select("key", "t", "place", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).distinct().collect(), key=lambda r: (r["place"], r["key"], r["t"])):
        if r["n"] <= left:
            left -= r["n"]
            take.append((r["key"], r["t"]))
    if len(take) < found.select("key", "t").distinct().count():
        kept = docs.sparkSession.createDataFrame(take, found.select("key", "t").schema)
        found = found.join(F.broadcast(kept), ["key", "t"], "left_semi")
    texts = sorted(found.select("key", "y", "text").collect(), key=lambda r: (r["key"], r["y"], r["text"] or ""))
    return train([r["text"] for r in texts], np.array([r["y"] for r in texts], np.int64), counts.get(1, 0) / max(1, sum(counts.values())), seed)


def score_toxicity(df: DataFrame, net: Network, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """df without its text, with `score` (0 to 1; the largest over all overlapping windows) and `predicted` (0 or 1).

    Every whole text is scored; null and empty texts as a window of padding. Rows stay where they are: no exchange.
    Columns named score or predicted are replaced.
    """
    kept = [f for f in df.schema if f.name not in (text, "score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            score = []
            for i in range(0, b.num_rows, 256):
                score.append(1 / (1 + np.exp(-scorer(b.column(text)[i : i + 256].to_pylist()))))
            s = np.concatenate([np.empty(0), *score])
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return df.select(*[f.name for f in kept], text).mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit_toxicity(docs, labels.where(~held_out(3, 1)))
    return score_toxicity(docs.select("doc_id", held_out(3, 1).alias("held_out"), "text"), net)
