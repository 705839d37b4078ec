"""Baselines of taxa: robust centre and scale, from all samples, controls or history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.abundance import clr, dense
from tidewatch.operators.ranks import median_and_mad

SCALE_FLOOR, NOVEL_SCALE, MAD_FACTOR, PSEUDOCOUNT = 1e-3, 5e-3, 1.4826, 1e-6


def fit(values: DataFrame, value: str = "rel", samples: int | None = None, taxa: DataFrame | None = None) -> DataFrame:
    """(taxon, median, scale) of each taxon over all samples; scale is the scaled median absolute deviation, at least SCALE_FLOOR.

    A sample without a row for a taxon has a zero there, so values need not be dense. samples: how many there are (else those that have
    a row). taxa: those that get a row in any case, with median 0 where none of the samples has them."""
    n = values.select("sample").distinct().count() if samples is None else samples
    found = median_and_mad(values, value, n).select("taxon", "median", F.greatest(MAD_FACTOR * F.col("mad"), F.lit(SCALE_FLOOR)).alias("scale"))
    if taxa is None:
        return found
    every = taxa.select("taxon").distinct().join(found, "taxon", "left")
    return every.select("taxon", F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("scale", F.lit(SCALE_FLOOR)).alias("scale"))


def fit_in(values: DataFrame, space: str = "relative", taxa: DataFrame | None = None) -> DataFrame:
    """fit of relative abundances in a space. Log-ratios need all taxa of a sample at once: these are filled in, samples times taxa."""
    if space == "relative":
        return fit(values, taxa=taxa)
    if space != "clr":
        raise ValueError(f"unknown space {space}")
    return fit(clr(dense(values, "rel", taxa=taxa), "rel", PSEUDOCOUNT), "clr")


def without_outliers(values: DataFrame, pathogen_taxa: DataFrame, fraction: float = 0.1, value: str = "rel") -> DataFrame:
    """values without the samples of largest pathogen load: max(1, round(n * fraction)) of n >= 5, if 3 or more remain."""
    load = values.join(F.broadcast(pathogen_taxa.select("taxon").distinct().withColumn("hit", F.lit(1.0))), "taxon", "left")
    load = load.groupBy("sample").agg(F.sum(F.col(value) * F.coalesce("hit", F.lit(0.0))).alias("load"))
    n = load.count()
    drop = max(1, round(n * fraction))
    if n < 5 or not 0 < fraction < 0.5 or n - drop < 3:
        return values
    return values.join(load.orderBy(F.desc("load"), "sample").limit(drop), "sample", "left_anti")


def fit_rolling(values: DataFrame, pathogen_taxa: DataFrame, fraction: float = 0.1, space: str = "relative") -> DataFrame:
    """Without the samples of largest pathogen load; taxa that only these have are known to be absent."""
    return fit_in(without_outliers(values, pathogen_taxa, fraction), space, values.select("taxon"))


def fit_controls(values: DataFrame, controls: DataFrame, space: str = "relative") -> DataFrame:
    """From control samples only. Raises ValueError if there is none of them."""
    own = values.join(controls.select("sample").distinct(), "sample", "left_semi")
    if own.isEmpty():
        raise ValueError("no control sample in the matrix")
    return fit_in(own, space, values.select("taxon"))


def resolve(values: DataFrame, controls: DataFrame | None = None, history: DataFrame | None = None, prior: DataFrame | None = None, pathogen_taxa: DataFrame | None = None, min_history: int = 8, space: str = "relative") -> tuple[str, DataFrame]:
    """The best baseline there is, with its space: controls, rolling history (min_history columns), a prior, or the cohort itself. A prior has its own space."""
    if controls is not None and not values.join(controls.select("sample"), "sample", "left_semi").isEmpty():
        tier, base = "controls", fit_controls(values, controls, space)
    elif history is not None and history.select("sample").distinct().count() >= min_history:
        tier, base = "rolling", fit_rolling(history, pathogen_taxa, space=space) if pathogen_taxa is not None else fit_in(history, space)
    elif prior is not None:
        return "prior", prior
    else:
        tier, base = "self", fit_in(values, space)
    return tier, base.withColumn("space", F.lit(space))


def space_of(base: DataFrame, otherwise: str = "relative") -> str:
    """The space that a baseline carries."""
    row = base.select("space").first() if "space" in base.columns else None
    return row["space"] if row and row["space"] else otherwise


def sample_log_ratios(rel: DataFrame, base: DataFrame, pseudocount: float = PSEUDOCOUNT) -> DataFrame:
    """rel with `clr`: log-ratios of each sample over the baseline's taxa and those that it brings along itself. A baseline taxon that a sample
    lacks counts as the pseudocount, so it needs no row: how many they are is enough."""
    here = rel.where("rel > 0")
    in_base = here.join(base.select("taxon", F.lit(1).alias("hit")), "taxon", "left").withColumn("log", F.log(F.col("rel") + pseudocount))
    n = base.count()
    sums = in_base.groupBy("sample").agg(F.sum("log").alias("s"), F.count(F.lit(1)).alias("m"), F.count("hit").alias("both"))
    missing = F.lit(n) - F.col("both")
    mean = (F.col("s") + missing * F.log(F.lit(pseudocount))) / (F.col("m") + missing)
    return in_base.join(sums.select("sample", mean.alias("mean")), "sample").withColumn("clr", F.col("log") - F.col("mean")).drop("log", "mean", "hit")


def save(base: DataFrame, root: str, site: str, org: str | None = None, space: str | None = None) -> str:
    """Writes a baseline (taxon, median, scale, with the space that it carries or the one given) for an organisation's site; one that is there
    is replaced. Returns its path."""
    path = _place(root, site, org)
    if space and "space" in base.columns and space_of(base, space) != space:
        raise ValueError(f"the baseline is in {space_of(base)} space, not {space}")
    base.select("taxon", "median", "scale", F.lit(space or space_of(base)).alias("space")).coalesce(1).write.mode("overwrite").json(path)
    return path


def load(spark: SparkSession, root: str, site: str, org: str | None = None) -> DataFrame | None:
    """The saved baseline of a site, or None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_place(root, site, org))
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("taxon string, median double, scale double, space string").json(at.toString())


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """A baseline in one JSON document: `median` and `scale` by taxon, and `space` (relative, if missing)."""
    rows = spark.read.schema("median map<string,double>, scale map<string,double>, space string").json(path, multiLine=True)
    each = rows.select(F.explode("median").alias("taxon", "median"), "scale", F.coalesce("space", F.lit("relative")).alias("space"))
    return each.select("taxon", "median", F.coalesce(F.try_element_at("scale", "taxon"), F.lit(SCALE_FLOOR)).alias("scale"), "space")


def _place(root: str, site: str, org: str | None) -> str:
    if "/" in site or ".." in site or (org and ("/" in org or ".." in org)):
        raise ValueError(f"not a name: {site}, {org}")
    return f"{root.rstrip('/')}/{org or '_selfhosted'}/{site}.baseline"


def with_baseline(rel: DataFrame, base: DataFrame, space: str = "relative") -> DataFrame:
    """rel with median and scale; taxa that the baseline lacks get 0 and NOVEL_SCALE, or in log-ratio space the least
    median and the middle scale."""
    base = base.select("taxon", "median", "scale")
    joined = rel.join(base, "taxon", "left")
    if space == "relative":
        return joined.withColumns({"median": F.coalesce("median", F.lit(0.0)), "scale": F.coalesce("scale", F.lit(NOVEL_SCALE))})
    low, middle = base.agg(F.min("median")).scalar(), base.agg(F.median("scale")).scalar()
    return joined.withColumns({"median": F.coalesce(F.col("median"), low), "scale": F.coalesce(F.col("scale"), middle)})


def recalibrated(scores: DataFrame, z_threshold: float = 2.0) -> DataFrame:
    """scores (sample, composite, direct, load): direct counts only where the load stands out in the cohort."""
    stats = scores.agg(F.avg("load").alias("m"), F.coalesce(F.stddev_samp("load"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
    z = F.when(F.col("n") > 1, (F.col("load") - F.col("m")) / (F.col("s") + 1e-10)).otherwise(0.0)
    out = scores.join(F.broadcast(stats)).withColumn("load_z", z)
    direct = F.when(F.col("load_z") >= z_threshold, F.col("direct")).otherwise(0.0)
    return out.withColumn("direct", direct).withColumn("score", F.least(F.greatest("composite", "direct", F.lit(0.0)), F.lit(1.0))).drop("m", "s", "n")


def cohort_spikes(values: DataFrame, value: str = "clr", z_threshold: float = 2.5) -> DataFrame:
    """(sample, spike): the largest |z| of any taxon across the samples, over three thresholds, at most 1."""
    over = W.partitionBy("taxon")
    z = F.abs(F.col(value) - F.avg(value).over(over)) / (F.stddev_pop(value).over(over) + 1e-10)
    return values.select("sample", z.alias("z")).groupBy("sample").agg(F.least(F.max("z") / (3 * z_threshold), F.lit(1.0)).alias("spike"))
