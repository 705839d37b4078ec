"""Mixing sources to target weights: soft domain membership and least-squares document rates. DataFrame functions only."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

BUCKETS = 1 << 18
BEGINNING = 5  # characters of a word's beginning, which counts beside the word
PARTS = 3
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.90, "low": 0.08, "toxic": 0.02}
_OTHERS = DOMAINS[1:]  # the classes of the regression; the first domain is its reference


def _bucket(shown: Column) -> Column:
    return F.pmod(F.xxhash64(shown), F.lit(BUCKETS)).cast("int")


def _evidence(docs: DataFrame, text: str, *own: str) -> DataFrame:
    """own, n_tokens (words that white space parts) and `evidence`: buckets of what the text shows, each once: its words and runs of signs, the
    beginnings of its longer words, and how often it repeats itself (twice the binary logarithm of tokens over different ones).

    Each step is a column of its own, so that no expression over a whole text is evaluated twice."""
    whole = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^ \t-\r]+")).cast("long").alias("n_tokens")
    tokens = whole.select(*own, words, F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s]+)"), F.lit(1)).alias("tokens"))
    long = F.filter("tokens", lambda w: F.char_length(w) > BEGINNING)
    shown = tokens.select(*own, "n_tokens", F.transform("tokens", _bucket).alias("words"), F.transform(long, lambda w: _bucket(F.concat(F.lit("^"), F.substring(w, 1, BEGINNING)))).alias("starts"))
    distinct = shown.select(*own, "n_tokens", "starts", F.size("words").alias("n"), F.array_distinct("words").alias("distinct"))
    often = F.when(F.col("n") == 0, "#none").otherwise(F.concat(F.lit("#"), F.floor(2 * F.log2(F.col("n") / F.greatest(F.lit(1), F.size("distinct")))).cast("string")))
    return distinct.select(*own, "n_tokens", F.array_distinct(F.array_append(F.concat("distinct", "starts"), _bucket(often))).alias("evidence"))


def label_domain() -> Column:
    """Domain of a labelled row; null where the labels do not tell."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")


def _sums(docs: DataFrame, weights: DataFrame, text: str, own: list[str]) -> DataFrame:
    """own, copies, n_tokens and for each domain the sum of the weights of what the text shows; one row for each own.

    Each row ends in a mark, which keeps and counts it; of its evidence only what the table of weights (broadcast; its size
    is bounded) has goes on, and it is pre-aggregated before the exchange."""
    each = _evidence(docs, text, *own).select(*own, "n_tokens", F.explode(F.array_append("evidence", F.lit(-1))).alias("bucket"))
    marked = weights.unionByName(docs.sparkSession.createDataFrame([(-1, *[0.0] * len(DOMAINS))], weights.schema))
    sums = each.join(F.broadcast(marked), "bucket").groupBy(*own).agg(F.max("n_tokens").alias("n_tokens"), F.count_if(F.col("bucket") == -1).alias("copies"), *[F.sum(d).alias(d) for d in DOMAINS])
    return sums.select(*own, "copies", "n_tokens", *[(F.col(d) / F.col("copies")).alias(d) for d in DOMAINS])


def _shares(p: list[list[float]]) -> list[Column]:
    """Posteriors of the domains under the regression's coefficients: for each of _OTHERS, those of the sums and a constant."""
    x = [*(F.col(d) for d in DOMAINS), F.lit(1.0)]
    z = [F.lit(0.0), *(sum((F.lit(float(c)) * v for c, v in zip(row, x, strict=True)), F.lit(0.0)) for row in p)]
    e = [F.exp(v - F.greatest(*z)) for v in z]
    return [v / sum(e[1:], e[0]) for v in e]


def _regression(rows: DataFrame, ridge: float = 0.1, rounds: int = 25) -> list[list[float]]:
    """Coefficients of a multinomial logistic regression of `domain` on the sums, by Newton steps; a step sends the driver
    the sums of gradient and curvature. The ridge keeps it finite where classes do not overlap or are not there."""
    n = len(DOMAINS) + 1
    x = [*(F.col(d) for d in DOMAINS), F.lit(1.0)]
    p = np.zeros((len(_OTHERS), n))
    for _ in range(rounds):
        q = [F.col(f"q_{d}") for d in _OTHERS]
        at = rows.select("*", *[c.alias(f"q_{d}") for d, c in zip(DOMAINS, _shares(p.tolist()), strict=True)])
        miss = [((F.col("domain") == d).cast("double") - q[i]) * v for i, d in enumerate(_OTHERS) for v in x]
        pairs = [(a, b, j, k) for a in range(len(q)) for b in range(a, len(q)) for j in range(n) for k in range(j, n)]
        bend = [q[a] * (F.lit(float(a == b)) - q[b]) * x[j] * x[k] for a, b, j, k in pairs]
        got = [v or 0.0 for v in at.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(miss + bend)]).first()]
        slope = np.array(got[: p.size]) - ridge * p.reshape(-1)
        curve = ridge * np.eye(p.size)
        for (a, b, j, k), v in zip(pairs, got[p.size :], strict=True):
            for r, c in {(a * n + j, b * n + k), (a * n + k, b * n + j), (b * n + k, a * n + j), (b * n + j, a * n + k)}:
                curve[r, c] += v
        step = np.linalg.solve(curve, slope).reshape(p.shape)
        p = p + step
        if np.abs(step).max() < 1e-7:
            break
    else:
        warnings.warn(f"the posteriors' regression has not settled in {rounds} steps; the last one was {np.abs(step).max():.2g}", stacklevel=3)
    return p.tolist()


def fit_domains(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_domain: int = 3000, smoothing: float = 1.0, threshold: float = 1.0, seed: int = 11) -> tuple[list[list[float]], DataFrame]:
    """Coefficients of the domains' posteriors, and for each of BUCKETS buckets of evidence its weight for each domain: by how much its
    log lift (share of the domain's documents that show it, over that of all) exceeds threshold; 0 where it does not.

    labels has the key and `domain`. About per_domain rows of each domain (all, if fewer), chosen by a hash of the key, are looked at; rows
    without key or domain are not. The coefficients are fitted on sums that come, for each of PARTS parts of these rows, from
    the weights of the other parts, so that posteriors are those of texts which the weights have not seen; the weights returned are those of all. The table has at most BUCKETS rows and may be broadcast; buckets that tell nothing are not in it.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("domain").isin(*DOMAINS)).select(F.col(key).alias("key"), "domain")
    counts = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    share = F.lit(0.0)
    for d in DOMAINS:
        share = F.when(F.col("domain") == d, min(1.0, per_domain / max(1, counts.get(d, 0)))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_000)) / 1_000_000 < share).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(PARTS)))
    texts = saved(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key"))
    n = {(r[0], r[1]): r[2] for r in texts.groupBy("domain", "part").count().collect()}
    shown = _evidence(texts, "text", "domain", "part").select("domain", "part", F.explode("evidence").alias("bucket")).groupBy("bucket")
    seen = saved(shown.agg(*[F.count_if((F.col("domain") == d) & (F.col("part") == f)).alias(f"{d}_{f}") for d in DOMAINS for f in range(PARTS)]))

    def weights(parts: list[int]) -> DataFrame:
        """By the labelled rows of these parts."""
        rows = {d: sum(n.get((d, f), 0) for f in parts) for d in DOMAINS}
        count = {d: sum((F.col(f"{d}_{f}") for f in parts), F.lit(0)) for d in DOMAINS}
        whole = sum(count.values(), F.lit(0)) / max(1, sum(rows.values()))
        lift = {d: F.log((count[d] + smoothing) / (whole * rows[d] + smoothing)) for d in DOMAINS}
        own = seen.select("bucket", *[F.greatest(x - threshold, F.lit(0.0)).alias(d) for d, x in lift.items()])
        return own.where(" or ".join(f"{d} > 0" for d in DOMAINS))

    unseen = [_sums(texts.where(F.col("part") == f).withColumn("t", F.xxhash64("text")), weights([g for g in range(PARTS) if g != f]), "text", ["key", "t", "domain"]) for f in range(PARTS)]
    rows = unseen[0]
    for more in unseen[1:]:
        rows = rows.unionByName(more)
    return _regression(saved(rows)), saved(weights(list(range(PARTS))))


def domain_posteriors(docs: DataFrame, coefficients: list[list[float]], weights: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each different (key, text): key k, t (hash of the text), copies, n_tokens (words that white space parts) and p_<domain>.
    A null text is an empty one; a text without words gets what the labelled rows without words have."""
    own = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(text).alias("text"))
    rows = _sums(own, weights, "text", ["k", "t"])
    return rows.select("k", "t", "copies", "n_tokens", *[c.alias(f"p_{d}") for d, c in zip(DOMAINS, _shares(coefficients), strict=True)])


STEPS = (1.0, 0.5, 0.2, 0.05, 0.01, 0.001)


def mixing_rates(members: DataFrame, targets: dict[str, float], total: float | None = None, keep: str | None = None, most: float | None = None, slacks: tuple[float, ...] = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5), tolerance: float = 1e-6, rounds: int = 30) -> tuple[DataFrame, list[float], float]:
    """members (copies, n_tokens, p_<domain>) with `rate`; the multipliers that make the rates; and the residual: the largest miss
    of a target, in shares of the total.

    The rates minimise the sum over domains of (expected tokens - target)^2 / (tokens at rate 1), plus a slack times the token-weighted square
    of their distance from 1, over rates from 0 to `most`: of all rates that match the targets (or, where none do, come closest),
    those next to 1. Expected tokens are the sum of rate x n_tokens x posterior. A rate is 1 and the gradient steps so far, which are
    linear in the posteriors, projected on the bounds; so a state of the descent is one multiplier a domain. The problem is solved for
    each of the slacks in turn, each from where the last ended. A round sends the driver the expected tokens and the second moments
    of the posteriors of documents between the bounds, by which the step is scaled, for each of STEPS; the one that comes closest
    is taken. It ends where the optimality conditions hold to `tolerance` of the total, or where no step comes closer. A domain without tokens keeps multiplier 0.

    total: of all targets; the tokens at rate 1, if not given. keep: the domain whose tokens at rate 1 are to be its target, which gives the total.
    """
    weight = F.col("n_tokens") * F.col("copies")
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = len(DOMAINS)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def unbounded(at: np.ndarray) -> Column:
        return F.lit(1.0) + sum((F.lit(float(x)) * c for x, c in zip(at, p, strict=True)), F.lit(0.0))

    def rate(at: np.ndarray) -> Column:
        r = F.greatest(F.lit(0.0), unbounded(at))
        return r if most is None else F.least(F.lit(float(most)), r)

    def sums(places: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Expected tokens and moments at each place."""
        rows = members.select(weight.alias("w"), *p, *[c for i, at in enumerate(places) for c in (rate(at).alias(f"r{i}"), unbounded(at).alias(f"u{i}"))])
        free = [(F.col(f"u{i}") > 0) if most is None else (F.col(f"u{i}") > 0) & (F.col(f"u{i}") < most) for i in range(len(places))]
        got = rows.agg(*[x.alias(f"x{i}_{k}") for i in range(len(places)) for k, x in enumerate([*(F.sum(F.col("w") * F.col(f"r{i}") * c) for c in p), *(F.sum(F.when(free[i], F.col("w") * p[a] * p[b])) for a, b in pairs)])]).first()
        out = []
        for i in range(len(places)):
            own = [float(v or 0.0) for v in got[i * (n + len(pairs)) : (i + 1) * (n + len(pairs))]]
            moments = np.zeros((n, n))
            for (a, b), v in zip(pairs, own[n:], strict=True):
                moments[a, b] = moments[b, a] = v
            out.append((np.array(own[:n]), moments))
        return out

    at = np.zeros(n)
    now, moments = sums([at])[0]
    held, size = now > 0, np.maximum(now, 1.0)
    if keep:
        total = now[DOMAINS.index(keep)] * sum(targets.values()) / targets[keep]
    total = float(now.sum()) if total is None else total
    goal = np.array([targets[d] * total / sum(targets.values()) for d in DOMAINS])
    for slack in slacks if held.any() else ():
        off = lambda expected, at, slack=slack: np.where(held, expected - goal + slack * size * at, 0.0)
        for _ in range(rounds):
            miss = off(now, at)
            if np.abs(miss).max() <= tolerance * total:
                break
            step = np.where(held, np.linalg.solve(moments * np.outer(held, held) + np.diag(np.where(held, slack * size, 1.0)), miss), 0.0)
            places = [at - s * step for s in STEPS]
            found = sums(places)
            far = [np.linalg.norm(off(e, x) / np.sqrt(size)) for x, (e, _) in zip(places, found, strict=True)]
            best = int(np.argmin(far))
            if not far[best] < np.linalg.norm(miss / np.sqrt(size)) * (1 - 1e-6):
                break
            at, (now, moments) = places[best], found[best]
        else:
            warnings.warn(f"the rates have not settled in {rounds} rounds at slack {slack:g}", stacklevel=2)
    return members.withColumn("rate", rate(at)), at.tolist(), float(np.abs(now - goal).max() / total) if total else 0.0


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, text: str = "text", key: str = "doc_id", seed: int = 23, keep: str | None = None, most: float | None = None) -> DataFrame:
    """A row for each row of docs: key, t, n_tokens, p_<domain>, rate, and `repeats`, how often to take it: rate rounded up
    or down by a hash of key and text, so that its mean is the rate. keep, most: as in mixing_rates.

    Null keys and texts take part (a null text as an empty one); rows that are there twice have one rate; other columns play no part, whatever
    they are called. Empty docs give an empty result, and labels without a usable row equal posteriors. Targets that no rates match are
    warned of."""
    coefficients, weights = fit_domains(docs, labels, text, key)
    rated, _, residual = mixing_rates(saved(domain_posteriors(docs, coefficients, weights, text, key)), targets, total, keep, most)
    if residual > 0.01:
        within = "" if most is None else f" up to {most:g}"
        warnings.warn(f"no document rates{within} match the targets; the largest miss is {residual:.4f} of the tokens", stacklevel=2)
    draw = F.pmod(F.xxhash64(F.lit(seed), "k", "t"), F.lit(1 << 30)) / F.lit(1 << 30)
    each = rated.withColumn("repeats", F.floor(F.col("rate") + draw).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    return each.withColumnRenamed("k", key)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents towards 90 % good, 8 % low-quality and 2 % toxic tokens."""
    labels = table(spark, sf_dir, "labels").withColumn("domain", label_domain())
    out = mixed(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", "n_tokens", *[F.round(f"p_{d}", 6).alias(f"p_{d}") for d in DOMAINS], F.round("rate", 6).alias("rate"), "repeats")
