"""Running sums and extremes over a whole table in order of a column, without a window that has no key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64


def ranges(df: DataFrame, key: str, count: int = RANGES) -> DataFrame:
    """df with `range`, an int that grows with key: its place among some count quantiles of it. The quantiles are approximate
    and fixed numbers once they are found, so rows keep their range when they are computed again. Equal keys share a range; null keys come first."""
    cuts = df.agg(F.percentile_approx(F.col(key), [i / count for i in range(1, count)], 1000).alias("q")).first()["q"] or []
    above = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    return df.withColumn("range", F.size(F.filter(above, lambda c: c < F.col(key))))


def running(df: DataFrame, key: str, sums: dict[str, Column], ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `range`, and for each of sums its sum over all rows up to this one in descending order of key (then ties)."""
    parted = ranges(df, key).withColumns({f"_{n}": c for n, c in sums.items()})
    found = sorted(parted.groupBy("range").agg(*[F.sum(f"_{n}").alias(n) for n in sums]).collect(), key=lambda r: -r["range"])
    higher = {n: F.lit(0) for n in sums}
    for n in sums:
        so_far = 0
        for r in found:  # RANGES at most
            higher[n] = F.when(F.col("range") == r["range"], F.lit(so_far)).otherwise(higher[n])
            so_far += r[n] or 0
    order = W.partitionBy("range").orderBy(F.desc(key), *ties).rowsBetween(W.unboundedPreceding, 0)
    return parted.withColumns({n: F.sum(f"_{n}").over(order) + higher[n] for n in sums}).drop(*[f"_{n}" for n in sums])
