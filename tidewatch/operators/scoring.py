"""Risk scores of samples: absolute and relative to a baseline; annotations; alert rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.columns import clip, direct_detection, exceedance, genus, level_rank, resistance_score, risk_level, squash
from tidewatch.operators.baseline import with_baseline

WEIGHTS = {"abundance": 0.5, "community": 0.25, "novelty": 0.25}
CORROBORATION, TRIPWIRE_SCORE = 0.4, 0.85


def detected(rel: DataFrame, pathogens: DataFrame) -> DataFrame:
    """rel > 0 rows of known genera, with risk_weight and contribution. The dimension has a row for each known genus."""
    rows = rel.where("rel > 0").withColumn("genus", genus("taxon"))
    return rows.join(F.broadcast(pathogens), "genus").withColumn("contribution", F.col("risk_weight") * F.col("rel"))


def _signals(samples: DataFrame, signals: DataFrame | None, names: dict[str, float]) -> DataFrame:
    if signals is not None:
        samples = samples.join(signals.select("sample", *[c for c in names if c in signals.columns]), "sample", "left")
    return samples.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in samples.columns else F.lit(v) for c, v in names.items()})


def score_absolute(rel: DataFrame, pathogens: DataFrame, signals: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(sample, score, level, abundance_score, composite, direct, load, n_detected, top_taxon) for each sample of rel.

    signals: (sample, community, novelty), both 0 where missing.
    """
    order = W.partitionBy("sample").orderBy(F.desc("contribution"), "taxon")
    found = detected(rel, pathogens).withColumn("place", F.row_number().over(order))
    top = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    by = found.groupBy("sample").agg(F.least(F.sum("contribution"), F.lit(1.0)).alias("abundance_score"), F.count(F.lit(1)).alias("n_detected"), F.sum(F.when(F.col("place") <= 4, F.col("contribution"))).alias("load"), top("risk_weight").alias("w"), top("rel").alias("a"), top("taxon").alias("top_taxon"))
    every = _signals(rel.select("sample").distinct(), signals, {"community": 0.0, "novelty": 0.0}).join(by, "sample", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("abundance_score", "w", "a")} | {"n_detected": F.coalesce("n_detected", F.lit(0).cast("long"))}
    every = every.withColumns(zero).withColumn("load", F.when(F.col("n_detected") >= 2, F.col("load")).otherwise(0.0))
    composite = weights["abundance"] * F.col("abundance_score") + weights["community"] * F.col("community") + weights["novelty"] * clip(F.col("novelty"), 0, 1)
    every = every.withColumn("composite", composite).withColumn("direct", direct_detection(F.col("w"), F.col("a"), F.col("n_detected"), F.col("load")))
    every = every.withColumn("score", clip(F.greatest("composite", "direct"), 0, 1)).withColumn("level", risk_level(F.col("score")))
    return every.select("sample", "score", "level", "abundance_score", "community", "novelty", "composite", "direct", "load", "n_detected", "top_taxon")


def score_relative(rel: DataFrame, base: DataFrame, pathogens: DataFrame, tripwires: DataFrame, signals: DataFrame | None = None, space: str = "relative", value: str = "rel") -> DataFrame:
    """(sample, score, level, elevation, driver, tripwire, corroboration) for each sample of rel.

    A taxon's contribution is its squashed exceedance over the baseline, by half its risk weight upwards; the largest
    is the elevation. Novelty and temporal z (signals) add up to CORROBORATION of what is left to 1; a tripwire genus at
    its threshold gives TRIPWIRE_SCORE at least.
    """
    rows = with_baseline(detected(rel, pathogens), base, space)
    part = squash(exceedance(F.col(value), F.col("median"), F.col("scale")), 3.0 if space == "relative" else 2.0) * (0.5 + 0.5 * F.col("risk_weight"))
    best = rows.withColumn("part", part).groupBy("sample").agg(F.max("part").alias("elevation"), F.min_by("taxon", F.struct(-F.col("part"), "taxon")).alias("driver"))
    wired = rel.withColumn("genus", genus("taxon")).join(F.broadcast(tripwires), "genus").where(F.col("rel") >= F.col("min_rel")).groupBy("sample").agg(F.lit(TRIPWIRE_SCORE).alias("tripwire"))
    every = _signals(rel.select("sample").distinct(), signals, {"temporal_z": 0.0, "novelty": 0.0}).join(best, "sample", "left").join(wired, "sample", "left")
    every = every.withColumns({"elevation": F.coalesce("elevation", F.lit(0.0)), "tripwire": F.coalesce("tripwire", F.lit(0.0)), "corroboration": 0.5 * squash(F.col("temporal_z"), 2.0) + 0.5 * clip(F.col("novelty"), 0, 1)})
    raised = F.col("elevation") + (1 - F.col("elevation")) * CORROBORATION * F.col("corroboration")
    every = every.withColumn("score", clip(F.greatest(raised, "tripwire"), 0, 1)).withColumn("level", risk_level(F.col("score")))
    return every.select("sample", "score", "level", "elevation", "driver", "tripwire", "corroboration")


def pathogen_communities(members: DataFrame, pathogens: DataFrame, enrichment: float = 0.2) -> DataFrame:
    """(label) of communities in which known genera have at least this share. members: (taxon, label)."""
    known = members.withColumn("genus", genus("taxon")).join(F.broadcast(pathogens.select("genus", F.lit(1.0).alias("hit"))), "genus", "left")
    return known.groupBy("label").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share")).where(F.col("share") >= enrichment).select("label")


def community_signal(rel: DataFrame, members: DataFrame, flagged: DataFrame, least: float = 0.15) -> DataFrame:
    """(sample, community): 1 where at least this share of a sample's taxa with a community are in a flagged one."""
    own = rel.where("rel > 0").join(members, "taxon").join(F.broadcast(flagged.withColumn("hit", F.lit(1.0))), "label", "left")
    return own.groupBy("sample").agg(F.when(F.avg(F.coalesce("hit", F.lit(0.0))) >= least, 1.0).otherwise(0.0).alias("community"))


def annotate_resistance(found: DataFrame, resistance: DataFrame) -> DataFrame:
    """(sample, genus, ..., amr_score), one row for each sample and genus: its first detection's (largest contribution)."""
    first = found.withColumn("place", F.row_number().over(W.partitionBy("sample", "genus").orderBy(F.desc("contribution"), "taxon"))).where("place = 1")
    return first.select("sample", "genus", "taxon", "rel").join(F.broadcast(resistance), "genus").withColumn("amr_score", resistance_score(F.col("priority"), F.col("n_resistances"), F.col("rel")))


def annotate_lineages(rel: DataFrame, lineages: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Species at the threshold, with their context and weight (elevation by abundance)."""
    rows = rel.where(F.col("rel") >= threshold).withColumnRenamed("taxon", "species")
    return rows.join(F.broadcast(lineages), "species").withColumn("weight", F.col("risk_elevation") * F.col("rel"))


def alerts(report: DataFrame, min_level: str = "HIGH", min_score: float = 0.6, novelty_min: float | None = None, fire_on_cusum: bool = True, enabled: bool = True) -> DataFrame:
    """report rows (sample, score, level, novelty, cusum_alert, z_score) that a rule fires for, with reasons, worst first."""
    tests = [
        (level_rank(F.col("level")) >= level_rank(F.lit(min_level)), F.concat(F.lit("level "), "level")),
        (F.col("score") >= min_score, F.concat(F.lit("score "), F.format_number("score", 2))),
    ]
    if novelty_min is not None:
        tests.append((F.col("novelty") >= novelty_min, F.concat(F.lit("novelty "), F.format_number("novelty", 2))))
    if fire_on_cusum:
        tests.append((F.coalesce("cusum_alert", F.lit(False)) | F.coalesce(F.col("z_score") > 2.0, F.lit(False)), F.lit("temporal signal")))
    reasons = F.array_compact(F.array(*[F.when(test, text) for test, text in tests]))
    return report.withColumn("reasons", reasons).where((F.size("reasons") > 0) & F.lit(enabled)).orderBy(F.desc(level_rank(F.col("level"))), F.desc("score"), "sample")


def dashboard_alerts(report: DataFrame) -> DataFrame:
    return report.where(F.coalesce("cusum_alert", F.lit(False)) | F.coalesce(F.col("z_score") > 2.0, F.lit(False)) | F.col("level").isin("HIGH", "CRITICAL"))


def threshold_classifier(rel: DataFrame, pathogens: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(sample, score) of the plain comparison: 0.65 if any known genus reaches the threshold, else 0.1."""
    hit = detected(rel, pathogens).groupBy("sample").agg(F.max("rel").alias("most"))
    return rel.select("sample").distinct().join(hit, "sample", "left").select("sample", F.when(F.col("most") >= threshold, 0.65).otherwise(0.1).alias("score"))
