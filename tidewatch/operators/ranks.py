"""Order statistics of groups whose zeros have no rows, and of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT = 1 << 20  # rows of a key that one task sorts
CELLS = 256
FEW = 10_000  # keys whose cuts, 2 kB each, may be broadcast


def _pick(points: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, middle): the mean of the values at two ranks from 0, of points (key, v, w, before) whose weights come after `before` others."""
    so_far = F.sum("w").over(W.partitionBy(key).orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    at = lambda rank: F.min(F.when(F.col("so_far") > rank, F.col("v")))
    return points.withColumn("so_far", so_far).groupBy(key).agg(((at(low) + at(high)) / 2).alias("middle"))


def _sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df.hint("merge")


def celled_medians(points: DataFrame, n: int, key: str, cells: int = CELLS, few: bool = False) -> DataFrame:
    """(key, middle): medians of points (key, v, w) whose weights add up to n for each key, for keys with more rows than a task should sort.

    A key's values are dealt over cells between approximate quantiles; weights are added up by cell, and only the cells that hold the middle
    ranks are sorted, equal values as one. So a task gets about one row in `cells` of a key, whatever the quantiles' errors. few: there are FEW keys
    at most, and what is known of them is broadcast."""
    low, high = (n - 1) // 2, n // 2
    cuts = points.groupBy(key).agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 8 * cells).alias("cuts"))
    dealt = points.join(_sent(cuts, few), key).withColumn("cell", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = dealt.groupBy(key, "cell").agg(F.sum("w").alias("own"))
    before = F.sum("own").over(W.partitionBy(key).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("own")
    middle = sums.withColumn("before", before).where((F.col("before") <= high) & (F.col("before") + F.col("own") > low))
    kept = dealt.join(_sent(middle.select(key, "cell", "before"), few), [key, "cell"])  # two cells of a key at most
    return _pick(kept.groupBy(key, "v").agg(F.sum("w").alias("w"), F.min("before").alias("before")).withColumn("before", F.min("before").over(W.partitionBy(key))), key, low, high)


def _direct(own: DataFrame, n: int, key: str) -> DataFrame:
    """(key, median, mad) by windows over one exchange. The values that have no row are zeros before the others; their deviations are all the median, at
    the place where deviations reach it."""
    low, high = (n - 1) // 2, n // 2
    group = W.partitionBy(key)
    rows = own.withColumns({"i": F.row_number().over(group.orderBy("v")) - 1, "none": F.lit(n) - F.count(F.lit(1)).over(group)})
    at = lambda c, i, rank: F.max(F.when(F.col(i) == rank, F.col(c))).over(group)
    # negative values come before the zeros, the others after them
    place = F.when(F.col("v") < 0, F.col("i")).otherwise(F.col("i") + F.col("none"))
    rows = rows.withColumn("place", place)
    zero = F.lit(0.0)
    rows = rows.withColumn("median", (F.coalesce(at("v", "place", low), zero) + F.coalesce(at("v", "place", high), zero)) / 2)
    rows = rows.withColumn("off", F.abs(F.col("v") - F.col("median")))
    rows = rows.withColumn("j", F.row_number().over(group.orderBy("off")) - 1)
    rows = rows.withColumn("far", F.when(F.col("off") < F.abs("median"), F.col("j")).otherwise(F.col("j") + F.col("none")))
    rank = lambda r: F.coalesce(F.max(F.when(F.col("far") == r, F.col("off"))), F.abs(F.first("median")))
    return rows.groupBy(key).agg(F.first("median").alias("median"), ((rank(low) + rank(high)) / 2).alias("mad"))


def median_and_mad(values: DataFrame, value: str | Column, n: int, key: str = "taxon", hot: int = HOT) -> DataFrame:
    """(key, median, mad) of n values of each key: those of its rows, and a zero for each of the n that has no row. The median absolute deviation
    is not scaled. Keys have n rows at most; those with more than `hot` are not sorted whole. Null values count as missing."""
    own = values.select(key, (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v is not null")
    sizes = own.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.where(F.col("rows") > hot) if n > hot else None
    many = large.count() if large is not None else 0
    if many == 0:
        return _direct(own, n, key)
    few = many <= FEW
    small = _direct(own.join(large, key, "left_anti"), n, key)
    points = own.join(_sent(large.select(key), few), key, "left_semi").withColumn("w", F.lit(1).cast("long"))
    zeros = large.select(key, F.lit(0.0).alias("v"), (F.lit(n) - F.col("rows")).alias("w")).where("w > 0")
    medians = celled_medians(points.unionByName(zeros), n, key, few=few).withColumnRenamed("middle", "median")
    off = points.unionByName(zeros).join(_sent(medians, few), key).select(key, F.abs(F.col("v") - F.col("median")).alias("v"), "w")
    both = medians.join(celled_medians(off, n, key, few=few).withColumnRenamed("middle", "mad"), key)
    return small.unionByName(both.select(*small.columns))
