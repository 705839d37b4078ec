"""Sequencing depth: rarefaction curves, detection power, cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import poisson_power
from tidewatch.functions.special import log_depths, log_gamma, poisson_cdf, required_rate, whole_depth


VALUES = 1 << 12  # distinct counts of a sample held against its depths at once


def _expected(values: np.ndarray, times: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Expected number of taxa among each of the depths reads drawn without replacement, values being counts of reads and times how many taxa have each."""
    total = float((values * times).sum())
    m = np.minimum(depths.astype(float), np.floor(total))
    missing = np.zeros(len(m))
    for k in range(0, len(values), VALUES):
        rest = total - values[k : k + VALUES, None]
        possible = rest >= m
        safe = np.where(possible, rest - m, 0.0)
        log = log_gamma(rest + 1) - log_gamma(safe + 1) - log_gamma(np.array([total + 1])) + log_gamma(total - m + 1)
        missing += (np.where(possible, np.exp(np.where(possible, log, 0.0)), 0.0) * times[k : k + VALUES, None]).sum(0)
    return np.where(m > 0, times.sum() - missing, 0.0)


def _curves(counts: DataFrame, depths: Callable[[float], list[int]]) -> DataFrame:
    """(sample, depth, richness) at a sample's depths, all of them in one step from how many taxa have each count of reads."""
    times = counts.where("reads > 0").groupBy("sample", F.col("reads").cast("double").alias("reads")).agg(F.count(F.lit(1)).cast("double").alias("times"))
    each = times.groupBy("sample").agg(F.collect_list(F.struct("reads", "times")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("counts")
            flat, size = rows.flatten(), rows.value_lengths().to_numpy(zero_copy_only=False)
            values, many = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("reads", "times"))
            end = np.cumsum(size)
            at, found, place = [], [], []
            for i, (s, e) in enumerate(zip(end - size, end, strict=True)):
                own = np.array(depths(float((values[s:e] * many[s:e]).sum())), np.int64)
                at.append(own)
                found.append(_expected(values[s:e], many[s:e], own))
                place += [i] * len(own)
            join = lambda x, t: np.concatenate([*x, np.empty(0, t)])
            yield pa.RecordBatch.from_arrays([b.column("sample").take(pa.array(place, pa.int64())), pa.array(join(at, np.int64)), pa.array(join(found, float))], names=["sample", "depth", "richness"])

    return each.mapInArrow(run, f"sample {counts.schema['sample'].dataType.simpleString()}, depth long, richness double")


def rarefaction(counts: DataFrame, points: int = 20) -> DataFrame:
    """(sample, depth, richness) at depths from 1 read to all, evenly spaced in the logarithm."""
    return _curves(counts, lambda total: log_depths(total, points))


def richness(counts: DataFrame, depths: list[int]) -> DataFrame:
    """(sample, depth, richness) at the given depths; beyond a sample's reads its richness stays."""
    return _curves(counts, lambda _: sorted(set(depths)))


@dataclass(frozen=True)
class Plan:
    prevalence: float
    min_reads: int = 3
    cost_per_million: float = 20.0
    preparation: float = 20.0
    max_depth: int = 5_000_000

    def sensitivity(self, depth: float) -> float:
        return 1 - poisson_cdf(self.min_reads - 1, depth * self.prevalence)

    def cost(self, depth: float) -> float:
        return self.preparation + depth / 1e6 * self.cost_per_million

    def required_depth(self, confidence: float) -> int:
        if not 0 < self.prevalence <= 1:
            raise ValueError("prevalence must be above 0 and at most 1")
        if not 0 < confidence < 1:
            raise ValueError("confidence must lie between 0 and 1")
        if self.min_reads < 1:
            raise ValueError("min_reads must be 1 or more")
        return whole_depth(required_rate(confidence, self.min_reads), self.prevalence)


def sweep(spark: SparkSession, plan: Plan, points: int = 20) -> DataFrame:
    """(depth, sensitivity, cost) at depths from a thousandth of the largest on."""
    low = max(plan.max_depth / 1000, 1)
    grid = spark.range(points).select((low * F.pow(F.lit(plan.max_depth / low), F.col("id") / max(points - 1, 1))).cast("long").alias("depth")).distinct()
    return grid.select("depth", poisson_power(F.col("depth") * plan.prevalence, plan.min_reads).alias("sensitivity"), (plan.preparation + F.col("depth") / 1e6 * plan.cost_per_million).alias("cost"))


def targets(plan: Plan, confidences: tuple[float, ...] = (0.90, 0.95, 0.99)) -> list[dict]:
    return [{"confidence": c, "depth": d, "cost": plan.cost(d)} for c in confidences for d in [plan.required_depth(c)]]
