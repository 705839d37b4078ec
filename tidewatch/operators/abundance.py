"""Abundance in long form: counts (sample, taxon, reads), relative abundance, filters, log-ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.columns import genus, share


def total_reads(rows: DataFrame) -> DataFrame:
    """One row for each sample and taxon."""
    return rows.groupBy("sample", "taxon").agg(F.sum("reads").alias("reads"))


def normalized(counts: DataFrame) -> DataFrame:
    """counts with rel, the share of the sample's reads (0 for a sample without reads)."""
    return counts.withColumn("rel", share(F.col("reads"), F.sum("reads").over(W.partitionBy("sample"))))


def dense(counts: DataFrame, value: str = "reads", samples: DataFrame | None = None, taxa: DataFrame | None = None) -> DataFrame:
    """(sample, taxon, value) with a row, 0 if need be, for each of the samples and taxa.

    A cohort's taxa table is a dimension: it is sent to the samples' tasks as it is joined on nothing but itself.
    """
    samples = counts.select("sample").distinct() if samples is None else samples.select("sample").distinct()
    taxa = counts.select("taxon").distinct() if taxa is None else taxa.select("taxon").distinct()
    grid = samples.withColumn("taxon", F.explode(taxa.agg(F.array_sort(F.collect_set("taxon"))).scalar()))
    return grid.join(counts.select("sample", "taxon", value), ["sample", "taxon"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def prevalence(counts: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(taxon, prevalence, total): share of all samples with reads of it, and its reads."""
    n = (counts if samples is None else samples).agg(F.count_distinct("sample").alias("n"))
    seen = counts.groupBy("taxon").agg(F.count_if(F.col("reads") > 0).alias("seen"), F.sum("reads").alias("total"))
    return seen.withColumn("prevalence", F.col("seen") / n.scalar()).select("taxon", "prevalence", "total")


def filter_taxa(counts: DataFrame, min_prevalence: float = 0.1, min_total_reads: float = 50, rank_bump: bool = False) -> DataFrame:
    """counts of taxa that are frequent enough. rank_bump: the others' reads go to their genus, if that is another name."""
    keep = prevalence(counts).where((F.col("prevalence") >= min_prevalence) & (F.col("total") >= min_total_reads)).select("taxon")
    kept = counts.join(keep, "taxon", "left_semi").select("sample", "taxon", "reads")
    if not rank_bump:
        return kept
    rest = counts.join(keep, "taxon", "left_anti").withColumn("genus", genus("taxon")).where("genus <> taxon")
    return total_reads(kept.unionByName(rest.select("sample", F.col("genus").alias("taxon"), "reads")))


def clr(values: DataFrame, value: str = "reads", pseudocount: float = 0.5) -> DataFrame:
    """dense values with clr, the centred log-ratio within each sample."""
    log = F.log(F.col(value) + pseudocount)
    return values.withColumn("clr", log - F.avg(log).over(W.partitionBy("sample")))


def mean_abundance(rel: DataFrame) -> DataFrame:
    """Mean of each taxon over all samples, those without it included."""
    n = rel.agg(F.count_distinct("sample").alias("n"))
    return rel.groupBy("taxon").agg((F.sum("rel") / n.scalar()).alias("mean_rel"))


def top_taxa(rel: DataFrame, n: int = 50) -> DataFrame:
    return mean_abundance(rel).orderBy(F.desc("mean_rel"), "taxon").limit(n)


def merge_pairs(counts: DataFrame) -> DataFrame:
    """Samples whose name ends in _1 or _2 become one, with added reads, where both are there."""
    base = F.regexp_extract("sample", r"^(.+)_([12])$", 1)
    mates = counts.where(base != "").groupBy(base.alias("base")).agg(F.count_distinct("sample").alias("n")).where("n = 2").select("base")
    named = counts.join(mates, base == F.col("base"), "left")
    return total_reads(named.withColumn("sample", F.coalesce("base", "sample")))


def union_cohorts(a: DataFrame, b: DataFrame) -> DataFrame:
    return total_reads(a.select("sample", "taxon", "reads").unionByName(b.select("sample", "taxon", "reads")))


def novel_taxa(rel: DataFrame, reference: DataFrame | None = None, threshold: float = 0.001, factor: float = 5.0) -> DataFrame:
    """(sample, taxon, rel) of taxa at the threshold that the reference lacks, or that exceed their mean by the factor."""
    n = rel.agg(F.count_distinct("sample").alias("n")).scalar()
    rows = rel.withColumn("mean_rel", F.sum("rel").over(W.partitionBy("taxon")) / n)
    if reference is not None:
        known = reference.select("taxon").distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, "taxon", "left").withColumn("missing", F.col("known").isNull())
    else:
        rows = rows.withColumn("missing", F.lit(False))
    hit = ((F.col("rel") >= threshold) & F.col("missing")) | (F.col("rel") > factor * F.col("mean_rel"))
    return rows.where(hit).select("sample", "taxon", "rel")


def sample_difference(rel: DataFrame, a: str, b: str, threshold: float = 0.005, limit: int = 30, top: int = 50) -> DataFrame:
    """(class, taxon, before, after, delta) between two samples: appeared, disappeared, changed; limit rows of each."""
    few = rel.join(top_taxa(rel, top).select("taxon"), "taxon", "left_semi")
    both = few.where(F.col("sample").isin(a, b)).groupBy("taxon").agg(F.coalesce(F.sum(F.when(F.col("sample") == a, F.col("rel"))), F.lit(0.0)).alias("before"), F.coalesce(F.sum(F.when(F.col("sample") == b, F.col("rel"))), F.lit(0.0)).alias("after"))
    both = both.withColumn("delta", F.col("after") - F.col("before")).where(F.abs("delta") >= threshold)
    kind = F.when((F.col("before") == 0) & (F.col("after") > 0), "appeared").when((F.col("before") > 0) & (F.col("after") == 0), "disappeared").otherwise("changed")
    both = both.withColumn("class", kind)
    place = F.row_number().over(W.partitionBy("class").orderBy(F.desc(F.abs("delta")), "taxon"))
    return both.withColumn("place", place).where(F.col("place") <= limit).select("class", "taxon", "before", "after", "delta")
