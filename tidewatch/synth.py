"""Seeded synthetic cohorts with known truth, and the benchmark over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import genus
from tidewatch.operators import abundance, metrics, scoring
from tidewatch.sources import dims

# Environmental genera without risk.
BACKGROUND = [
    "Sphingomonas", "Methylobacterium", "Acidovorax", "Comamonas", "Brevundimonas", "Pedobacter", "Hymenobacter", "Arthrobacter", "Microbacterium", "Massilia",
    "Chitinophaga", "Devosia", "Mesorhizobium", "Bradyrhizobium", "Caulobacter", "Bosea", "Novosphingobium", "Parvibaculum", "Steroidobacter", "Phenylobacterium",
]
# Scenarios as (samples, injected genera with their ranges, whether an alert is expected).
SCENARIOS = {
    "negative_controls": (12, {}, False),
    "low_contamination": (10, {"Salmonella": (0.01, 0.05)}, False),
    "high_cholera": (8, {"Vibrio": (0.20, 0.60)}, True),
    "critical_yersinia": (6, {"Yersinia": (0.30, 0.60)}, True),
    "multi_pathogen": (8, {"Salmonella": (0.05, 0.15), "Escherichia": (0.03, 0.10), "Listeria": (0.02, 0.08)}, True),
    "novel_agent": (8, {"Hypotheticus": (0.15, 0.40)}, None),
    "borderline_outbreak": (12, {"Salmonella": (0.08, 0.16)}, True),
    "cryptic_low_shed": (10, {"Vibrio": (0.02, 0.05)}, True),
    "endemic_flora_confounder": (12, {"Pseudomonas": (0.05, 0.10), "Streptococcus": (0.03, 0.07), "Acinetobacter": (0.02, 0.05)}, False),
    "near_threshold_negative": (10, {"Klebsiella": (0.04, 0.09)}, False),
}


# A reference community and its shares, of which every sample should raise an alert.
MOCK = {"Listeria": 0.141, "Pseudomonas": 0.042, "Bacillus": 0.174, "Escherichia": 0.101, "Salmonella": 0.104, "Lactobacillus": 0.184, "Enterococcus": 0.099, "Staphylococcus": 0.155}
# Genera that rise and fall together, and their mean shares, in the sweep.
CRYPTIC, LEVELS = ("Salmonella", "Escherichia", "Listeria", "Shigella"), (0.010, 0.020, 0.030, 0.040, 0.050, 0.065, 0.080)
MOST_INJECTED = 0.85
DEPTHS = (100_000, 500_000)
COUNTS = "scenario string, sample string, taxon string, reads double"
TRUTH = "scenario string, sample string, label boolean"


def _reads(name: str, samples: list[str], taxa: list[str], shares: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Rows of Poisson reads at a depth of its own for each sample (rows of shares)."""
    depth = rng.integers(*DEPTHS, size=len(samples))
    reads = rng.poisson(shares * depth[:, None])
    return [(name, s, t, float(x)) for s, row in zip(samples, reads, strict=True) for t, x in zip(taxa, row, strict=True)]


def scenario(name: str, seed: int) -> tuple[list[tuple], list[tuple]]:
    """(scenario, sample, taxon, reads) and (scenario, sample, label) rows: a Dirichlet background, uniform injections (in turn cut so that
    all of them stay within MOST_INJECTED), a depth of 100,000 to 500,000 reads with Poisson noise."""
    n, injected, alert = SCENARIOS[name]
    rng = np.random.default_rng(seed)
    background = rng.dirichlet(np.full(len(BACKGROUND), 2.0), n)
    extra = np.zeros((n, 0))
    for low, high in injected.values():
        room = MOST_INJECTED - extra.sum(1)
        extra = np.column_stack([extra, np.minimum(rng.uniform(low, high, n), np.maximum(room, 0))])
    samples = [f"WW_site_{i + 1:02d}" for i in range(n)]
    shares = np.column_stack([background * (1 - extra.sum(1, keepdims=True)), extra])
    return _reads(name, samples, [*BACKGROUND, *injected], shares, rng), [(name, s, alert) for s in samples]


def mock_community(seed: int = 42, replicates: int = 5) -> tuple[list[tuple], list[tuple]]:
    """Replicates of the reference community, all of which should alert."""
    share = np.array(list(MOCK.values()))
    samples = [f"mock_{i + 1:02d}" for i in range(replicates)]
    rows = _reads("mock_community", samples, list(MOCK), np.tile(share / share.sum(), (replicates, 1)), np.random.default_rng(seed))
    return rows, [("mock_community", s, True) for s in samples]


def correlated(level: float, seed: int, samples: int = 30, half: float = 0.005, together: float = 0.9) -> tuple[list[tuple], list[tuple]]:
    """A cohort in which the CRYPTIC genera follow one hidden course around a mean share."""
    rng = np.random.default_rng(seed)
    low, high = max(0.0, level - half), level + half
    course = rng.uniform(size=samples)
    extra = low + (high - low) * (together * course[:, None] + (1 - together) * rng.uniform(size=(samples, len(CRYPTIC))))
    background = rng.dirichlet(np.full(len(BACKGROUND), 2.0), samples)
    names = [f"WW_site_{i + 1:02d}" for i in range(samples)]
    name = f"sweep_{level:.3f}_{seed}"
    shares = np.column_stack([background * (1 - np.minimum(extra.sum(1, keepdims=True), MOST_INJECTED)), extra])
    return _reads(name, names, [*BACKGROUND, *CRYPTIC], shares, rng), [(name, s, True) for s in names]


def scenario_scores(spark: SparkSession, cohorts: list[tuple[list[tuple], list[tuple]]], full: bool = False, weights: dict[str, float] = scoring.WEIGHTS, trees: int = 200) -> DataFrame:
    """(scenario, sample, label, score, community, novelty, most) of the absolute scorer, taxa filtered within each scenario; most: the largest
    share of a known genus. full: with the cohort's novelty and, where a network is found, its communities; else both are 0. Without them all
    scenarios are one plan; with them each cohort has its own matrix."""
    rows = spark.createDataFrame([r for c, _ in cohorts for r in c], COUNTS)
    known = spark.createDataFrame([r for _, t in cohorts for r in t], TRUTH)
    return cohort_scores(rows, known, dims.pathogens(spark), sorted({t[0][0] for _, t in cohorts}) if full else [], weights, trees)


def cohort_scores(rows: DataFrame, known: DataFrame, pathogens: DataFrame, full: list[str] | tuple = (), weights: dict[str, float] = scoring.WEIGHTS, trees: int = 200, signals: DataFrame | None = None) -> DataFrame:
    """scenario_scores of any (scenario, sample, taxon, reads) with (scenario, sample, label); full: the scenarios that get signals of their own.
    signals: (sample, community, novelty) of the others, sample as scenario/sample."""
    from tidewatch.operators import graph, novelty, stats

    key = F.concat_ws("/", "scenario", "sample")
    size = rows.groupBy("scenario").agg(F.count_distinct("sample").alias("n"))
    kept = rows.groupBy("scenario", "taxon").agg(F.count_if(F.col("reads") > 0).alias("seen"), F.sum("reads").alias("total")).join(size, "scenario").where((F.col("seen") / F.col("n") >= 0.05) & (F.col("total") >= 10))
    rows = rows.join(kept.select("scenario", "taxon"), ["scenario", "taxon"], "left_semi")
    for name in full:
        own = rows.where(F.col("scenario") == name).select(key.alias("sample"), "taxon", "reads")
        share = abundance.normalized(own)
        ratio = abundance.clr(abundance.normalized(abundance.dense(own)))
        part = novelty.cohort_novelty(ratio, trees=trees)
        members = graph.communities(stats.cooccurrence(ratio), 8, 3)
        part = part.join(scoring.community_signal(share, members, scoring.pathogen_communities(members, pathogens)), "sample", "left").select("sample", "novelty", F.coalesce("community", F.lit(0.0)).alias("community"))
        signals = part if signals is None else signals.unionByName(part)
    rel = abundance.normalized(rows.select(key.alias("sample"), "taxon", "reads"))
    scores = scoring.score_absolute(rel, pathogens, signals, weights)
    most = scoring.detected(rel, pathogens).groupBy("sample").agg(F.max("rel").alias("most"))
    out = known.select("scenario", key.alias("sample"), "label").join(scores.select("sample", "score", "community", "novelty"), "sample", "left").join(most, "sample", "left")
    return out.select("scenario", "sample", "label", "score", "community", "novelty", F.coalesce("most", F.lit(0.0)).alias("most"))


def standard(seed: int = 42, names: list[str] | None = None, mock: bool = False) -> list[tuple[list[tuple], list[tuple]]]:
    """The six standard scenarios (or those named), each from a seed of its own; and the mock community."""
    own = [scenario(n, seed + i) for i, n in enumerate(names or list(SCENARIOS)[:6])]
    return own + ([mock_community(seed)] if mock else [])


def benchmark(spark: SparkSession, names: list[str] | None = None, seed: int = 42, threshold: float = 0.6, full: bool = False, mock: bool = True) -> DataFrame:
    """Confusion and ratios of the absolute scorer for each scenario."""
    return metrics.confusion(scenario_scores(spark, standard(seed, names, mock), full), ["scenario"], threshold)


def validation(spark: SparkSession, seed: int = 42, full: bool = False) -> DataFrame:
    """roc_summary over the pooled samples of all ten scenarios, the hard ones included; samples without a label do not count."""
    return metrics.roc_summary(scenario_scores(spark, standard(seed, list(SCENARIOS)), full))


def comparison(spark: SparkSession, seeds: list[int], threshold: float = 0.6, full: bool = False) -> DataFrame:
    """(seed, method, scenario, tp, ...) of four methods: any known genus at 1 %, abundance only, community only, and all signals."""
    out = None
    for seed in seeds:
        scored = scenario_scores(spark, standard(seed), full)
        plain = scenario_scores(spark, standard(seed)).select("sample", F.col("score").alias("alone")) if full else scored.select("sample", F.col("score").alias("alone"))
        part = confusion_by_method(scored, plain, threshold).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out


def confusion_by_method(scored: DataFrame, plain: DataFrame, threshold: float = 0.6, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, method, scenario, tp, ...) of the four methods of `comparison`; plain: (sample, alone), the scores without signals."""
    ways = {"threshold": F.when(F.col("most") >= 0.01, 0.65).otherwise(0.1), "abundance": F.col("alone"), "community": 0.65 * F.col("community"), "full": F.col("score")}
    each = scored.join(plain, "sample").select(*by, "scenario", "label", F.explode(F.map_from_arrays(F.array(*[F.lit(w) for w in ways]), F.array(*ways.values()))).alias("method", "score"))
    return metrics.confusion(each, [*by, "method", "scenario"], threshold)


def multi_seed(spark: SparkSession, seeds: int = 10, base: int = 42, threshold: float = 0.6, full: bool = False) -> DataFrame:
    """(method, measure, mean, low, high): macro means over the scenarios of each seed, and their interval over the seeds base + 1000 s."""
    return macro_interval(comparison(spark, [base + 1000 * s for s in range(seeds)], threshold, full))


def macro_interval(rows: DataFrame) -> DataFrame:
    """(method, measure, mean, low, high) of confusions by (seed, method, scenario)."""
    alarms = F.when((F.col("fp") > 0) | (F.col("tn") > 0), F.col("fp") / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))
    macro = rows.groupBy("method", "seed").agg(F.avg("f1").alias("f1"), F.avg("sensitivity").alias("sensitivity"), F.avg("specificity").alias("specificity"), F.avg(alarms).alias("false_alarms"))
    long = macro.unpivot(["method"], ["f1", "sensitivity", "specificity", "false_alarms"], "measure", "value").where(F.col("value").isNotNull())
    return metrics.interval(long, ["method", "measure"], "value")


def ablation(spark: SparkSession, seed: int = 42, threshold: float = 0.6, full: bool = True) -> DataFrame:
    """(left_out, f1): micro F1 without one signal's weight at a time (the others scaled up), and with all."""
    out = None
    for gone in (None, *scoring.WEIGHTS):
        left = {k: 0.0 if k == gone else v for k, v in scoring.WEIGHTS.items()}
        weights = {k: v / sum(left.values()) for k, v in left.items()}
        scored = scenario_scores(spark, standard(seed), full, weights)
        part = metrics.overall(metrics.confusion(scored, ["scenario"], threshold)).select(F.lit(gone or "none").alias("left_out"), F.col("micro_f1").alias("f1"))
        out = part if out is None else out.unionByName(part)
    return out


def abundance_sweep(spark: SparkSession, levels: tuple[float, ...] = LEVELS, seeds: int = 10, threshold: float = 0.6, full: bool = False) -> DataFrame:
    """(level, mean, low, high): the share of samples that alert in correlated cohorts at each mean share, over the seeds."""
    cohorts = [correlated(level, 4000 + s) for level in levels for s in range(seeds)]
    scored = scenario_scores(spark, cohorts, full).select(F.regexp_extract("scenario", r"sweep_([\d.]+)_", 1).cast("double").alias("level"), "scenario", (F.col("score") >= threshold).cast("double").alias("on"))
    return metrics.interval(scored.groupBy("level", "scenario").agg(F.avg("on").alias("rate")), ["level"], "rate")


def at_levels(counts: DataFrame, pathogens: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """counts (sample, taxon, reads, ...) once for each level, the reads of known genera scaled so that they are that share of a sample, the others to the
    rest; the total stays. Samples that have only the one or the other cannot be brought to a level and are left out."""
    own = counts.join(F.broadcast(pathogens.select("genus", F.lit(True).alias("known"))), genus(F.col("taxon")) == F.col("genus"), "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("genus")
    sums = own.groupBy("sample").agg(F.sum("reads").alias("all"), F.sum(F.when(F.col("known"), F.col("reads")).otherwise(0.0)).alias("hit")).where("hit > 0 and hit < all")
    each = own.join(sums, "sample").withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    scale = F.when(F.col("known"), F.col("level") * F.col("all") / F.col("hit")).otherwise((1 - F.col("level")) * F.col("all") / (F.col("all") - F.col("hit")))
    return each.withColumn("reads", F.col("reads") * scale).drop("known", "all", "hit")


def calibrate_squash(spark: SparkSession, scores: DataFrame, steps: tuple[float, ...] = (0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0), threshold: float = 0.6) -> DataFrame:
    """(k, tp, fp, tn, fn, sensitivity, specificity, youden) of elevations z / (z + k) for each k, best first; scores: (exceedance, risk_weight, tripwire, label)."""
    grid = scores.select("*", F.explode(F.array(*[F.lit(float(k)) for k in steps])).alias("k"))
    elevation = F.col("exceedance") / (F.col("exceedance") + F.col("k")) * (0.5 + 0.5 * F.col("risk_weight"))
    out = metrics.confusion(grid.select("k", "label", F.greatest(elevation, "tripwire").alias("score")), ["k"], threshold)
    return out.withColumn("youden", F.coalesce("sensitivity", F.lit(0.0)) + F.coalesce("specificity", F.lit(0.0)) - 1).orderBy(F.desc("youden"), "k")
