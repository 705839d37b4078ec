"""Queries of the operators over the driver's tables, with the SQL they must agree with.

Roles: sample := supplier, taxon := part name (genus: its first word), reads := quantity; site := event type or user,
t := day, x := mean value / 500.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import abundance, baseline, characterize, cluster, graph, metrics, novelty, planning, scoring, series, stats, tables, temporal
from tidewatch.streaming.signals import started, streamed_signals
from tidewatch.streaming.watch import stream_daily_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return abundance.total_reads(rows.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sample"), F.col("p_name").alias("taxon"), F.col("l_quantity").alias("reads")))


def rel(spark: SparkSession, sf: str) -> DataFrame:
    return abundance.normalized(counts(spark, sf))


def full(spark: SparkSession, sf: str) -> DataFrame:
    return abundance.normalized(abundance.dense(counts(spark, sf)))


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    """A pathogen dimension made of parts: each genus that is among the larger half by mean size."""
    sizes = load(spark, sf, "part").groupBy(C.genus("p_name").alias("genus")).agg(F.round(F.avg("p_size") / 50, 4).alias("risk_weight"))
    return sizes.where("risk_weight >= 0.5").withColumn("category", F.lit("part"))


def points(spark: SparkSession, sf: str, by: str = "event_type") -> DataFrame:
    """(site, t, x) of the events. A user's day is added up in the order of the table, so that its mean, and with it which days are equal, is the same to the last bit
    however the table is cut into tasks; a running sum does so without an array of the day. Event types have few days of many events, which are added up in parts."""
    rows = load(spark, sf, "events")
    line = [F.col(by).cast("string").alias("site"), F.date_format("ts", "yyyy-MM-dd").alias("t"), "value"]
    if by != "user_id":
        return rows.select(*line).groupBy("site", "t").agg((F.avg("value") / 500).alias("x"))
    so_far = W.partitionBy("site", "t").orderBy("file", "row").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(*line, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.select("site", "t", F.sum("value").over(so_far).alias("total"), F.count("value").over(so_far).alias("n"))
    return rows.groupBy("site", "t").agg((F.try_divide(F.max_by("total", "n"), F.max("n")) / 500).alias("x"))


COUNTS = """counts AS (
  SELECT 'S' || l_suppkey AS sample, p_name AS taxon, sum(l_quantity) AS reads FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), rel AS (
  SELECT *, reads / sum(reads) OVER (PARTITION BY sample) AS rel FROM counts
), grid AS (
  SELECT sample, taxon, coalesce(reads, 0) AS reads FROM (SELECT DISTINCT sample FROM counts) CROSS JOIN (SELECT DISTINCT taxon FROM counts) LEFT JOIN counts USING (sample, taxon)
), fullrel AS (
  SELECT *, reads / sum(reads) OVER (PARTITION BY sample) AS rel FROM grid
), clr AS (
  SELECT *, ln(reads + 0.5) - avg(ln(reads + 0.5)) OVER (PARTITION BY sample) AS clr FROM fullrel
)"""
DIM = """dim AS (
  SELECT split_part(p_name, ' ', 1) AS genus, round(avg(p_size) / 50, 4) AS risk_weight FROM part GROUP BY 1 HAVING round(avg(p_size) / 50, 4) >= 0.5
), det AS (
  SELECT sample, taxon, rel, genus, risk_weight, risk_weight * rel AS contribution FROM rel JOIN dim ON genus = split_part(taxon, ' ', 1) WHERE rel > 0
)"""
BASE = """base AS (
  SELECT taxon, median(rel) AS median, greatest(1.4826 * mad(rel), 1e-3) AS scale FROM fullrel GROUP BY taxon
)"""


def points_sql(by: str = "event_type") -> str:
    return f"p AS (SELECT CAST({by} AS VARCHAR) AS site, strftime(ts, '%Y-%m-%d') AS t, avg(value) / 500 AS x FROM events GROUP BY 1, 2)"


def two_sided(z: str) -> str:
    """SQL of the normal distribution's two-sided tail, from the series of the error function."""
    x = f"(abs({z}) / sqrt(2))"
    return f"CASE WHEN abs({z}) > 6 THEN 0 WHEN {z} = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln({x}) - lgamma(k + 1)) / (2 * k + 1))) END"


def student(rho: str, n: str) -> str:
    """SQL of Student's two-sided tail of a rank correlation, from the finite series of whole degrees of freedom."""
    c = f"(1 - {rho} * {rho})"  # the squared cosine of the angle whose tangent is t / sqrt(degrees)
    even = f"abs({rho}) * (1 + list_sum(list_transform(range(1, greatest(2, ({n} - 2) // 2)), lambda k: CASE WHEN ({n} - 2) // 2 > 1 THEN exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4) + k * ln({c})) ELSE 0 END)))"
    odd = f"2 / pi() * (asin(abs({rho})) + abs({rho}) * sqrt({c}) * (1 + list_sum(list_transform(range(1, greatest(2, ({n} - 3) // 2)), lambda k: CASE WHEN ({n} - 3) // 2 > 1 THEN exp(2 * lgamma(k + 1) + k * ln(4) - lgamma(2 * k + 2) + k * ln({c})) ELSE 0 END))))"
    return f"CASE WHEN {rho} = 0 THEN 1 ELSE greatest(1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END, 0) END"


LEVEL = "CASE WHEN {0} >= 0.8 THEN 'CRITICAL' WHEN {0} >= 0.6 THEN 'HIGH' WHEN {0} >= 0.3 THEN 'MODERATE' ELSE 'LOW' END"


@query(f"WITH {COUNTS} SELECT sample, taxon, reads, round(rel, 8) AS rel FROM rel")
def rel_abundance(spark, sf):  # noqa: ANN001, ANN201
    return rel(spark, sf).select("sample", "taxon", "reads", F.round("rel", 8).alias("rel"))


@query(f"""WITH {COUNTS}, n AS (SELECT count(DISTINCT sample) AS n FROM counts), k AS (
  SELECT taxon FROM counts CROSS JOIN n GROUP BY taxon, n HAVING count(*) FILTER (reads > 0) / CAST(any_value(n) AS DOUBLE) >= 0.5 AND sum(reads) >= 23000)
SELECT sample, taxon, reads, round(reads / sum(reads) OVER (PARTITION BY sample), 8) AS rel FROM counts SEMI JOIN k USING (taxon)""")
def prevalence_filter(spark, sf):  # noqa: ANN001, ANN201
    kept = abundance.filter_taxa(counts(spark, sf), 0.5, 23000)
    return abundance.normalized(kept).select("sample", "taxon", "reads", F.round("rel", 8).alias("rel"))


@query(f"""WITH {COUNTS}, k AS (SELECT taxon FROM counts GROUP BY taxon HAVING sum(reads) >= 23000)
SELECT sample, CASE WHEN k.taxon IS NULL THEN split_part(c.taxon, ' ', 1) ELSE c.taxon END AS taxon, sum(reads) AS reads FROM counts c LEFT JOIN k USING (taxon) GROUP BY 1, 2""")
def rank_bump(spark, sf):  # noqa: ANN001, ANN201
    return abundance.filter_taxa(counts(spark, sf), 0.1, 23000, rank_bump=True)


@query(f"""WITH {COUNTS}, n AS (SELECT count(DISTINCT sample) AS n FROM counts)
SELECT taxon, round(sum(rel) / (SELECT n FROM n), 8) AS mean_rel FROM rel GROUP BY taxon ORDER BY sum(rel) DESC, taxon LIMIT 50""")
def top50_taxa(spark, sf):  # noqa: ANN001, ANN201
    return abundance.top_taxa(rel(spark, sf)).withColumn("mean_rel", F.round("mean_rel", 8))


@query(f"WITH {COUNTS} SELECT sample, taxon, round(clr, 6) AS clr FROM clr")
def clr_counts(spark, sf):  # noqa: ANN001, ANN201
    return abundance.clr(full(spark, sf)).select("sample", "taxon", F.round("clr", 6).alias("clr"))


@query(f"WITH {COUNTS} SELECT sample, taxon, round(ln(rel + 1e-6) - avg(ln(rel + 1e-6)) OVER (PARTITION BY sample), 6) AS clr FROM fullrel")
def clr_relative(spark, sf):  # noqa: ANN001, ANN201
    return abundance.clr(full(spark, sf), "rel", 1e-6).select("sample", "taxon", F.round("clr", 6).alias("clr"))


@query("""WITH c AS (SELECT l_orderkey % 50 || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '_' || l_linenumber % 3 END AS sample, p_name AS taxon, sum(l_quantity) AS reads FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
b AS (SELECT regexp_extract(sample, '^(.+)_([12])$', 1) AS base FROM c WHERE regexp_matches(sample, '_[12]$') GROUP BY 1 HAVING count(DISTINCT sample) = 2)
SELECT coalesce(base, sample) AS sample, taxon, sum(reads) AS reads FROM c LEFT JOIN b ON base = regexp_extract(sample, '^(.+)_([12])$', 1) GROUP BY 1, 2""")
def paired_merge(spark, sf):  # noqa: ANN001, ANN201
    mate = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("_"), (F.col("l_linenumber") % 3).cast("string")))
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.concat((F.col("l_orderkey") % 50).cast("string"), mate).alias("sample"), F.col("p_name").alias("taxon"), F.col("l_quantity").alias("reads"))
    return abundance.merge_pairs(abundance.total_reads(rows))


@query(f"""WITH {COUNTS} SELECT sample, taxon, reads FROM counts UNION ALL
SELECT 'C' || o_custkey % 20, p_name, sum(l_quantity) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def cohort_union(spark, sf):  # noqa: ANN001, ANN201
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    other = rows.select(F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("sample"), F.col("p_name").alias("taxon"), F.col("l_quantity").alias("reads"))
    return abundance.union_cohorts(counts(spark, sf), other)


@query(f"WITH {COUNTS}, {DIM} SELECT sample, taxon, genus, risk_weight, round(contribution, 8) AS contribution FROM det")
def pathogen_detect(spark, sf):  # noqa: ANN001, ANN201
    return scoring.detected(rel(spark, sf), dimension(spark, sf)).select("sample", "taxon", "genus", "risk_weight", F.round("contribution", 8).alias("contribution"))


@query(f"WITH {COUNTS}, {BASE} SELECT taxon, round(median, 8) AS median, round(scale, 8) AS scale FROM base")
def robust_baseline_fit(spark, sf):  # noqa: ANN001, ANN201
    return baseline.fit(rel(spark, sf)).select("taxon", F.round("median", 8).alias("median"), F.round("scale", 8).alias("scale"))


@query(f"""WITH {COUNTS}, {DIM}, l AS (SELECT sample, sum(CASE WHEN split_part(taxon, ' ', 1) IN (SELECT genus FROM dim) THEN rel ELSE 0 END) AS load FROM fullrel GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY load DESC, sample) AS i FROM l), kept AS (SELECT sample FROM o WHERE i > greatest(1, round((SELECT count(*) FROM l) * 0.1)))
SELECT taxon, round(median(rel), 8) AS median, round(greatest(1.4826 * mad(rel), 1e-3), 8) AS scale FROM fullrel SEMI JOIN kept USING (sample) GROUP BY taxon""")
def rolling_fit_exclude_outliers(spark, sf):  # noqa: ANN001, ANN201
    values = rel(spark, sf)
    known = values.select("taxon").distinct().join(F.broadcast(dimension(spark, sf)), C.genus("taxon") == F.col("genus")).select("taxon")
    return baseline.fit_rolling(values, known).select("taxon", F.round("median", 8).alias("median"), F.round("scale", 8).alias("scale"))


@query(f"""WITH {COUNTS}, ctl AS (SELECT DISTINCT 'S' || s_suppkey AS sample FROM supplier WHERE s_acctbal > 5000)
SELECT taxon, round(median(rel), 8) AS median, round(greatest(1.4826 * mad(rel), 1e-3), 8) AS scale FROM fullrel SEMI JOIN ctl USING (sample) GROUP BY taxon""")
def controls_fit(spark, sf):  # noqa: ANN001, ANN201
    controls = load(spark, sf, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample"))
    return baseline.fit_controls(rel(spark, sf), controls).select("taxon", F.round("median", 8).alias("median"), F.round("scale", 8).alias("scale"))


@query(f"""WITH {DIM.split("), det AS")[0]}), c AS (SELECT strftime(l_shipdate, '%Y-%m') AS run, 'S' || l_suppkey % 7 AS site, p_name AS taxon, sum(l_quantity) AS reads FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 7 > 0 GROUP BY ALL),
nw AS (SELECT run FROM c GROUP BY 1 ORDER BY run DESC LIMIT 6), r AS (SELECT run || '::' || site AS sample, taxon, reads / sum(reads) OVER (PARTITION BY run, site) AS rel FROM c SEMI JOIN nw USING (run)),
g AS (SELECT sample, taxon, coalesce(rel, 0) AS rel FROM (SELECT DISTINCT sample FROM r) CROSS JOIN (SELECT DISTINCT taxon FROM r) LEFT JOIN r USING (sample, taxon)),
l AS (SELECT sample, sum(CASE WHEN split_part(taxon, ' ', 1) IN (SELECT genus FROM dim) THEN rel ELSE 0 END) AS load FROM g GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY load DESC, sample) AS i FROM l), kept AS (SELECT sample FROM o WHERE i > greatest(1, round((SELECT count(*) FROM l) * 0.1)))
SELECT taxon, round(median(rel), 8) AS median, round(greatest(1.4826 * mad(rel), 1e-3), 8) AS scale FROM g SEMI JOIN kept USING (sample) GROUP BY taxon""")
def history_baseline(spark, sf):  # noqa: ANN001, ANN201
    """A rolling baseline of the newest six months as runs, a column for each month and site; most taxa are missing from most columns."""
    rows = load(spark, sf, "lineitem").where("l_suppkey % 7 > 0").join(load(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    month = F.date_format("l_shipdate", "yyyy-MM")
    recent = rows.select(month.alias("run")).distinct().orderBy(F.desc("run")).limit(6)
    runs = rows.withColumn("run", month).join(F.broadcast(recent), "run", "left_semi")
    column = F.concat("run", F.lit("::S"), (F.col("l_suppkey") % 7).cast("string"))
    past = abundance.normalized(abundance.total_reads(runs.select(column.alias("sample"), F.col("p_name").alias("taxon"), F.col("l_quantity").alias("reads"))))
    known = past.select("taxon").distinct().join(F.broadcast(dimension(spark, sf)), C.genus("taxon") == F.col("genus")).select("taxon")
    return baseline.fit_rolling(past, known).select("taxon", F.round("median", 8).alias("median"), F.round("scale", 8).alias("scale"))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of two suppliers in three, made of their nation and balance."""
    own = load(spark, sf, "supplier").where("s_suppkey % 3 > 0")
    return own.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample"), (F.col("s_nationkey") % 2).cast("double").alias("community"), (F.col("s_nationkey") / 25).alias("novelty"), (F.greatest("s_acctbal", F.lit(0)) / 5000).cast("double").alias("temporal_z"))


@query(f"""WITH {COUNTS}, {DIM}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY contribution DESC, taxon) AS i FROM det),
g AS (SELECT sample, least(sum(contribution), 1) AS ab, count(*) AS n, CASE WHEN count(*) >= 2 THEN sum(contribution) FILTER (i <= 4) ELSE 0 END AS load, max(risk_weight) FILTER (i = 1) AS w, max(rel) FILTER (i = 1) AS a, max(taxon) FILTER (i = 1) AS top_taxon FROM r GROUP BY 1),
sg AS (SELECT 'S' || s_suppkey AS sample, s_nationkey % 2 AS community, s_nationkey / 25.0 AS novelty FROM supplier WHERE s_suppkey % 3 > 0),
s AS (SELECT g.*, .25 * coalesce(community, 0) + .25 * coalesce(novelty, 0) AS extra, greatest(CASE WHEN w >= .85 AND a >= .05 THEN .85 WHEN w >= .7 AND a >= .15 THEN .65 WHEN w >= .7 AND a >= .05 THEN .4 WHEN w >= .5 AND a >= .2 THEN .35 ELSE 0 END, CASE WHEN n < 2 THEN 0 WHEN load >= .1 THEN .62 WHEN load >= .04 THEN .38 ELSE 0 END) AS direct FROM g LEFT JOIN sg USING (sample))
SELECT sample, round(ab, 6) AS abundance_score, round(load, 6) AS load, CAST(direct AS DOUBLE) AS direct, top_taxon, round(greatest(.5 * ab + extra, direct), 6) AS score, {LEVEL.format('greatest(.5 * ab + extra, direct)')} AS level FROM s""")
def score_absolute(spark, sf):  # noqa: ANN001, ANN201
    out = scoring.score_absolute(rel(spark, sf), dimension(spark, sf), _signals(spark, sf))
    return out.select("sample", F.round("abundance_score", 6).alias("abundance_score"), F.round("load", 6).alias("load"), "direct", "top_taxon", F.round("score", 6).alias("score"), "level")


RELATIVE = f"""{COUNTS}, {DIM}, {BASE}, c AS (SELECT sample, taxon, least(greatest((rel - median) / scale, 0), 12) AS z, risk_weight FROM det JOIN base USING (taxon)),
e AS (SELECT sample, taxon, z / (z + 3) * (.5 + .5 * risk_weight) AS part FROM c), b AS (SELECT sample, max(part) AS elevation, arg_min(taxon, (-part, taxon)) AS driver FROM e GROUP BY 1),
t AS (SELECT DISTINCT sample FROM rel JOIN dim ON genus = split_part(taxon, ' ', 1) WHERE rel >= .02 + risk_weight / 100),
q AS (SELECT sample, elevation, driver, CASE WHEN t.sample IS NULL THEN 0 ELSE .85 END AS tripwire FROM b LEFT JOIN t USING (sample)),
sg AS (SELECT 'S' || s_suppkey AS sample, greatest(s_acctbal, 0) / 5000 AS tz, s_nationkey / 25.0 AS novelty FROM supplier WHERE s_suppkey % 3 > 0),
u AS (SELECT q.*, .5 * coalesce(tz / (tz + 2), 0) + .5 * coalesce(novelty, 0) AS corroboration FROM q LEFT JOIN sg USING (sample)),
scored AS (SELECT *, greatest(elevation + (1 - elevation) * .4 * corroboration, tripwire) AS score FROM u)"""


@query(f"WITH {RELATIVE} SELECT sample, round(score, 6) AS score, {LEVEL.format('score')} AS level, round(elevation, 6) AS elevation, driver, CAST(tripwire AS DOUBLE) AS tripwire, round(corroboration, 6) AS corroboration FROM scored")
def score_relative(spark, sf):  # noqa: ANN001, ANN201
    dim = dimension(spark, sf)
    wires = dim.select("genus", (0.02 + F.col("risk_weight") / 100).alias("min_rel"))
    out = scoring.score_relative(rel(spark, sf), baseline.fit(rel(spark, sf)), dim, wires, _signals(spark, sf))
    return out.select("sample", F.round("score", 6).alias("score"), "level", F.round("elevation", 6).alias("elevation"), "driver", "tripwire", F.round("corroboration", 6).alias("corroboration"))


@query(f"""WITH {COUNTS}, {DIM}, gc AS (SELECT sample, taxon, rel, ln(rel + 1e-6) - avg(ln(rel + 1e-6)) OVER (PARTITION BY sample) AS v FROM fullrel), base AS (SELECT taxon, median(v) AS median, greatest(1.4826 * mad(v), 1e-3) AS scale FROM gc GROUP BY taxon),
e AS (SELECT sample, taxon, least(greatest((v - median) / scale, 0), 12) AS z, risk_weight FROM gc JOIN base USING (taxon) JOIN dim ON genus = split_part(taxon, ' ', 1) WHERE rel > 0),
p AS (SELECT sample, max(z / (z + 2) * (.5 + .5 * risk_weight)) AS elevation, arg_min(taxon, (-(z / (z + 2) * (.5 + .5 * risk_weight)), taxon)) AS driver FROM e GROUP BY 1)
SELECT sample, round(elevation, 5) AS score, {LEVEL.format('round(elevation, 5)')} AS level, driver FROM p""")
def score_relative_clr(spark, sf):  # noqa: ANN001, ANN201
    """Scores in log-ratio space: baseline, samples and squash are those of that space."""
    own, dim = rel(spark, sf), dimension(spark, sf)
    base = baseline.fit_in(own, "clr")
    out = scoring.score_relative(baseline.sample_log_ratios(own, base), base, dim, dim.select("genus", F.lit(2.0).alias("min_rel")), None, "clr", "clr")
    return out.select("sample", F.round("score", 5).alias("score"), C.risk_level(F.round("score", 5)).alias("level"), "driver")


@query(f"WITH {RELATIVE} SELECT {LEVEL.format('score')} AS level, count(*) AS n FROM scored GROUP BY 1")
def level_counts(spark, sf):  # noqa: ANN001, ANN201
    return score_relative(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {COUNTS}, {DIM}, g AS (SELECT sample, sum(contribution) AS load FROM det GROUP BY 1)
SELECT sample, round((load - avg(load) OVER ()) / (stddev_samp(load) OVER () + 1e-10), 6) AS load_z, CASE WHEN (load - avg(load) OVER ()) / (stddev_samp(load) OVER () + 1e-10) >= 2 THEN CAST(.65 AS DOUBLE) ELSE CAST(.3 AS DOUBLE) END AS score FROM g""")
def recalibrate_load(spark, sf):  # noqa: ANN001, ANN201
    loads = scoring.detected(rel(spark, sf), dimension(spark, sf)).groupBy("sample").agg(F.sum("contribution").alias("load"))
    out = baseline.recalibrated(loads.withColumns({"composite": F.lit(0.3), "direct": F.lit(0.65)}))
    return out.select("sample", F.round("load_z", 6).alias("load_z"), "score")


@query(f"WITH {COUNTS} SELECT sample, round(least(max(abs(clr - m) / (s + 1e-10)) / 7.5, 1), 6) AS spike FROM (SELECT *, avg(clr) OVER (PARTITION BY taxon) AS m, stddev_pop(clr) OVER (PARTITION BY taxon) AS s FROM clr) GROUP BY sample")
def cohort_spike_z(spark, sf):  # noqa: ANN001, ANN201
    return baseline.cohort_spikes(abundance.clr(full(spark, sf))).select("sample", F.round("spike", 6).alias("spike"))


@query(f"""WITH {COUNTS}, n AS (SELECT count(DISTINCT sample) AS n FROM counts), m AS (SELECT *, sum(rel) OVER (PARTITION BY taxon) / (SELECT n FROM n) AS mean_rel FROM rel)
SELECT sample, taxon, round(rel, 8) AS rel FROM m WHERE rel >= .001 AND split_part(taxon, ' ', 1) NOT IN (SELECT split_part(p_name, ' ', 1) FROM part GROUP BY 1 HAVING avg(p_size) >= 25) OR rel > 1.5 * mean_rel""")
def novel_taxa_flag(spark, sf):  # noqa: ANN001, ANN201
    known = load(spark, sf, "part").groupBy(C.genus("p_name").alias("genus")).agg(F.avg("p_size").alias("s")).where("s >= 25")
    reference = load(spark, sf, "part").select(F.col("p_name").alias("taxon")).join(known, C.genus("taxon") == F.col("genus"))
    return abundance.novel_taxa(rel(spark, sf), reference, 0.001, 1.5).select("sample", "taxon", F.round("rel", 8).alias("rel"))


SERIES_COLUMNS = ("site", "t", "x")


@query(f"""WITH {points_sql('user_id')}, w AS (SELECT *, count(*) OVER b AS n, avg(x) OVER b AS m, stddev_samp(x) OVER b AS s FROM p WINDOW b AS (PARTITION BY site ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT site, t, n AS n_history, round(CASE WHEN n < 2 THEN x ELSE m END, 9) AS baseline_mean, round(CASE WHEN n < 2 THEN 0 ELSE (x - m) / (s + 1e-10) END, 6) AS z_score, CASE WHEN n < 2 THEN false ELSE (x - m) / (s + 1e-10) >= 2 END AS is_anomaly FROM w""")
def rolling_z(spark, sf):  # noqa: ANN001, ANN201
    return series.rolling_baseline(points(spark, sf, "user_id")).select("site", "t", "n_history", F.round("baseline_mean", 9).alias("baseline_mean"), F.round("z_score", 6).alias("z_score"), "is_anomaly")


@query(f"""WITH RECURSIVE {points_sql('user_id')}, i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t) AS i, count(*) OVER (PARTITION BY site) AS n FROM p),
b AS (SELECT *, avg(CASE WHEN i <= greatest(2, n // 2) THEN x END) OVER (PARTITION BY site) AS m, stddev_samp(CASE WHEN i <= greatest(2, n // 2) THEN x END) OVER (PARTITION BY site) AS s FROM i),
z AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END END AS z FROM b),
zm AS MATERIALIZED (SELECT * FROM z),
c AS (SELECT site, i, n, greatest(0, z - .5) AS u, greatest(0, -z - .5) AS d FROM zm WHERE i = 1 UNION ALL SELECT zm.site, zm.i, zm.n, greatest(0, u + z - .5), greatest(0, d - z - .5) FROM c JOIN zm ON zm.site = c.site AND zm.i = c.i + 1)
SELECT site, t, round(CASE WHEN c.n < 3 THEN 0 ELSE u END, 6) AS cusum_upper, round(CASE WHEN c.n < 3 THEN 0 ELSE d END, 6) AS cusum_lower, CASE WHEN c.n < 3 THEN 0 ELSE u END > 4 AS alert,
  CAST(i - coalesce(max(CASE WHEN CASE WHEN c.n < 3 THEN 0 ELSE u END <= 0 THEN i END) OVER (PARTITION BY site ORDER BY i), 0) AS INTEGER) AS streak FROM c JOIN zm USING (site, i)""")
def cusum_upper_lower(spark, sf):  # noqa: ANN001, ANN201
    return series.cusum(points(spark, sf, "user_id")).select("site", "t", F.round("cusum_upper", 6).alias("cusum_upper"), F.round("cusum_lower", 6).alias("cusum_lower"), "alert", "streak")


@query(f"""WITH {points_sql('user_id')}, i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t) AS i FROM p), n AS (SELECT site, count(*) AS n FROM i GROUP BY 1),
s AS (SELECT a.site, sum(sign(b.x - a.x)) AS s, median((b.x - a.x) / (b.i - a.i)) AS slope FROM i a JOIN i b ON a.site = b.site AND a.i < b.i GROUP BY 1)
SELECT site, n, CAST(CASE WHEN n < 4 THEN 0 ELSE s END AS DOUBLE) AS s, round(CASE WHEN n < 4 THEN 0 ELSE s / (n * (n - 1) / 2) END, 6) AS tau, round(CASE WHEN n < 4 THEN 0 ELSE slope END, 6) AS slope,
  round({two_sided("(CASE WHEN n < 4 THEN 0 ELSE (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) END)")}, 6) AS p_value FROM n LEFT JOIN s USING (site)""")
def mann_kendall(spark, sf):  # noqa: ANN001, ANN201
    return series.mann_kendall(points(spark, sf, "user_id")).select("site", "n", "s", *[F.round(c, 6).alias(c) for c in ("tau", "slope", "p_value")])


@query(f"""WITH RECURSIVE {points_sql()}, i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t) AS i FROM p),
h AS (SELECT a.site, CAST(1 AS BIGINT) AS i, a.x AS level, b.x - a.x AS trend, CAST(NULL AS DOUBLE) AS res FROM i a JOIN i b ON a.site = b.site AND a.i = 1 AND b.i = 2
UNION ALL SELECT h.site, i.i, .3 * x + .7 * (level + trend), .1 * (.3 * x + .7 * (level + trend) - level) + .9 * trend, x - (level + .1 * (.3 * x + .7 * (level + trend) - level) + .9 * trend) FROM h JOIN i ON h.site = i.site AND i.i = h.i + 1),
l AS (SELECT site, max(i) AS n, least(greatest(arg_max(level + trend, i), 0), 1) AS f, stddev_pop(res) AS s FROM h GROUP BY 1)
SELECT site, n, round(f, 6) AS forecast_next, round(least(greatest(f - 1.281551565545 * s, 0), 1), 6) AS ci_low, round(least(greatest(f + 1.281551565545 * s, 0), 1), 6) AS ci_high FROM l""")
def holt_forecast(spark, sf):  # noqa: ANN001, ANN201
    return series.holt_forecast(points(spark, sf)).select("site", "n", *[F.round(c, 6).alias(c) for c in ("forecast_next", "ci_low", "ci_high")])


@query(f"WITH {points_sql('user_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t DESC) AS i FROM p) SELECT site, t, round(x, 6) AS x FROM r WHERE i <= 10")
def history_last_n(spark, sf):  # noqa: ANN001, ANN201
    return series.last_points(points(spark, sf, "user_id"), 10).select("site", "t", F.round("x", 6).alias("x"))


TRENDS = f"""{points_sql('user_id')}, i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t) AS i FROM p), n AS (SELECT site, count(*) AS n, arg_max(x, i) AS cur FROM i GROUP BY 1),
s AS (SELECT a.site, sum(sign(b.x - a.x)) AS s, median((b.x - a.x) / (b.i - a.i)) AS slope FROM i a JOIN i b ON a.site = b.site AND a.i < b.i GROUP BY 1),
mk AS (SELECT n.site, n.n, cur, CASE WHEN n.n < 4 THEN 0 ELSE s / (n.n * (n.n - 1) / 2) END AS tau, CASE WHEN n.n < 4 THEN 0 ELSE slope END AS slope, CASE WHEN n.n < 4 THEN 0 ELSE (s - sign(s)) / sqrt(n.n * (n.n - 1) * (2 * n.n + 5) / 18) END AS z FROM n LEFT JOIN s ON n.site = s.site),
mp AS (SELECT *, {two_sided('z')} AS p FROM mk),
hh AS (SELECT a.site, CAST(1 AS BIGINT) AS i, a.x AS level, b.x - a.x AS trend, CAST(NULL AS DOUBLE) AS res FROM i a JOIN i b ON a.site = b.site AND a.i = 1 AND b.i = 2
UNION ALL SELECT hh.site, i.i, .3 * x + .7 * (level + trend), .1 * (.3 * x + .7 * (level + trend) - level) + .9 * trend, x - (level + .1 * (.3 * x + .7 * (level + trend) - level) + .9 * trend) FROM hh JOIN i ON hh.site = i.site AND i.i = hh.i + 1),
hl AS (SELECT site, least(greatest(arg_max(level + trend, i), 0), 1) AS f, 1.281551565545 * stddev_pop(res) AS half FROM hh GROUP BY 1),
tr AS (SELECT mp.*, coalesce(f, least(greatest(cur, 0), 1)) AS f, CASE WHEN f IS NULL THEN .1 ELSE half END AS half, CASE WHEN n < 3 THEN 'insufficient' WHEN p < .05 AND tau >= .3 THEN 'increasing' WHEN p < .05 AND tau <= -.3 THEN 'decreasing' ELSE 'stable' END AS trend FROM mp LEFT JOIN hl ON mp.site = hl.site)"""


@query(f"""WITH RECURSIVE {TRENDS}
SELECT site, n, trend, round(tau, 4) AS tau, round(p, 4) AS p_value, trend <> 'insufficient' AS enough, p < .05 AND abs(tau) >= .3 AND n >= 3 AS is_significant, round(f, 4) AS forecast_next,
  round(CASE WHEN n < 3 THEN 0 ELSE least(greatest(f - half, 0), 1) END, 4) AS ci_low, round(CASE WHEN n < 3 THEN 1 ELSE least(greatest(f + half, 0), 1) END, 4) AS ci_high FROM tr""")
def trend_report(spark, sf):  # noqa: ANN001, ANN201
    return series.trends(points(spark, sf, "user_id")).drop("summary", "sens_slope")


def fit_sql(name: str, source: str) -> str:
    """SQL of reweighted least squares of a log-linear Poisson trend through lists y with weights w, as a recursion until the means are still: the CTE
    `name` has each row's last step."""
    total = lambda e: f"list_sum(list_transform(range(len(y)), lambda i: {e}))"
    v, each = "w[i + 1] * exp(eta[i + 1])", "(w[i + 1] * exp(eta[i + 1]) * eta[i + 1] + w[i + 1] * (y[i + 1] - exp(eta[i + 1])))"
    return f"""{name}_r AS (SELECT site, t, 0 AS k, y, w, list_transform(y, lambda u: ln(u)) AS eta, CAST(0 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS slope, CAST(1 AS DOUBLE) AS moved FROM {source}
UNION ALL SELECT site, t, k + 1, y, w, list_transform(range(len(y)), lambda i: lv + sl * i), lv, sl, list_max(list_transform(range(len(y)), lambda i: abs(lv + sl * i - eta[i + 1]))) FROM (
  SELECT site, t, k, y, w, eta, (s2 * r0 - s1 * r1) / (s0 * s2 - s1 * s1) AS lv, (s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1) AS sl FROM (
    SELECT site, t, k, y, w, eta, {total(v)} AS s0, {total(v + " * i")} AS s1, {total(v + " * i * i")} AS s2, {total(each)} AS r0, {total(each + " * i")} AS r1 FROM {name}_r WHERE moved >= 1e-10 AND k < 100))),
{name} AS (SELECT *, len(y) AS n, greatest(1, {total("w[i + 1] * (y[i + 1] - exp(eta[i + 1])) ** 2 / exp(eta[i + 1])")} / greatest(len(y) - 2, 1)) AS phi, {total(v)} AS s0, {total(v + " * i")} AS s1, {total(v + " * i * i")} AS s2 FROM {name}_r QUALIFY row_number() OVER (PARTITION BY site, t ORDER BY k DESC) = 1)"""


FARRINGTON = f"""{points_sql('user_id')}, h AS (SELECT site, t, x * 1.0266940451745 AS x, 100 * (x * 1.0266940451745) AS now, coalesce(list(100 * (x * 1.0266940451745)) OVER (PARTITION BY site ORDER BY t ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), []) AS y FROM p),
able AS (SELECT site, t, y, list_transform(y, lambda u: CAST(1 AS DOUBLE)) AS w FROM h WHERE len(y) >= 4 AND list_min(y) < list_max(y)), {fit_sql("f1", "able")},
again AS (SELECT site, t, y, list_transform(range(n), lambda i: CASE WHEN abs(1.5 * (y[i + 1] ** (2 / 3) - exp(eta[i + 1]) ** (2 / 3)) / exp(eta[i + 1]) ** (1 / 6) / sqrt(phi)) > 2.58 THEN (2.58 / abs(1.5 * (y[i + 1] ** (2 / 3) - exp(eta[i + 1]) ** (2 / 3)) / exp(eta[i + 1]) ** (1 / 6) / sqrt(phi))) ** 2 ELSE CAST(1 AS DOUBLE) END) AS w FROM f1), {fit_sql("f2", "again")},
g AS (SELECT h.site, h.t, h.x, now, h.y, phi, slope, exp(level + slope * n) AS ex, (s2 - 2 * n * s1 + n * n * s0) / (s0 * s2 - s1 * s1) AS spread FROM h LEFT JOIN f2 ON h.site = f2.site AND h.t = f2.t),
q AS (SELECT *, 2 / 3 * ex ** (-1 / 3) * sqrt(greatest(phi * ex + ex * ex * spread, 1e-12)) AS sd FROM g),
o AS (SELECT *, (ex ** (2 / 3) + 1.6448536269514722 * sd) ** 1.5 AS lim, (now ** (2 / 3) - ex ** (2 / 3)) / (sd + 1e-12) AS z, coalesce(list_avg(y), 0) AS m FROM q)"""


@query(f"""WITH RECURSIVE {FARRINGTON} SELECT site, t, round(x, 6) AS x, round(coalesce(ex, m) / 100, 6) AS expected, round(coalesce(lim, 1.5 * m + 1e-6) / 100, 6) AS threshold, round(phi, 4) AS dispersion, round(slope, 5) AS trend_slope, round(coalesce(z, 0), 4) AS z,
  round(coalesce(greatest(z, 0) / (greatest(z, 0) + 2), 0), 4) AS exceedance, now > coalesce(lim, 1.5 * m + 1e-6) AS alarm, CASE WHEN ex IS NULL THEN 'insufficient or flat history' ELSE 'ok' END AS note FROM o""")
def farrington(spark, sf):  # noqa: ANN001, ANN201
    """Every user's day against a trend of the days before; the factor keeps values off the ties of rounding."""
    return series.aberrations(points(spark, sf, "user_id").withColumn("x", F.col("x") * 1.0266940451745)).withColumn("x", F.round("x", 6))


SHORT = f"""{points_sql('user_id')}, w AS (SELECT site, t, x * 1.0266940451745 AS x, coalesce(avg(x * 1.0266940451745) OVER b, 0) AS m FROM p WINDOW b AS (PARTITION BY site ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {SHORT} SELECT site, t, round(m, 6) AS expected, round(1.5 * m + 1e-8, 6) AS threshold, 100 * x > 1.5 * 100 * m + 1e-6 AS alarm FROM w")
def farrington_short_history(spark, sf):  # noqa: ANN001, ANN201
    return series.aberrations(points(spark, sf, "user_id").withColumn("x", F.col("x") * 1.0266940451745), window=3).select("site", "t", "expected", "threshold", "alarm")


@query(f"""WITH {points_sql('user_id')}, i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t) AS i FROM p)
SELECT site, t, i <= 500 AS warming, CASE WHEN i <= 500 THEN 'warmup' ELSE 'ok' END AS note FROM i""")
def farrington_warmup(spark, sf):  # noqa: ANN001, ANN201
    out = series.aberrations(points(spark, sf, "user_id"), window=None, min_history=500, warmup=True)
    return out.select("site", "t", F.col("expected").isNull().alias("warming"), "note")


@query(f"""WITH RECURSIVE {TRENDS}, nw AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t DESC) AS j FROM p), sh AS (SELECT site, t, x, row_number() OVER (PARTITION BY site ORDER BY t) AS i, count(*) OVER (PARTITION BY site) AS n FROM nw WHERE j <= 2001),
rb AS (SELECT site, i, n, x, count(*) OVER b AS k, avg(x) OVER b AS m, stddev_samp(x) OVER b AS sd FROM sh WINDOW b AS (PARTITION BY site ORDER BY i ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)),
bl AS (SELECT site, x, CASE WHEN k < 2 THEN 0 ELSE (x - m) / (sd + 1e-10) END AS z, x > 1.5 * coalesce(m, 0) + 1e-8 AS fa FROM rb WHERE i = n),
cb AS (SELECT *, avg(CASE WHEN i <= greatest(2, n // 2) THEN x END) OVER (PARTITION BY site) AS m, stddev_samp(CASE WHEN i <= greatest(2, n // 2) THEN x END) OVER (PARTITION BY site) AS sd FROM sh),
cz AS (SELECT site, i, n, CASE WHEN n < 3 THEN 0 ELSE (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END END AS z FROM cb),
cs AS (SELECT site, i, n, sum(z - .5) OVER (PARTITION BY site ORDER BY i) AS up FROM cz), cu AS (SELECT site, i, n, CASE WHEN n < 3 THEN 0 ELSE up - least(0, min(up) OVER (PARTITION BY site ORDER BY i)) END AS c FROM cs),
ft AS (SELECT bl.site, bl.z, c, tr.trend, tau, f, fa, list_filter([CASE WHEN bl.z >= 2 THEN 'baseline' END, CASE WHEN c > 4 THEN 'cusum' END, CASE WHEN fa THEN 'farrington' END, CASE WHEN tr.trend = 'increasing' THEN 'trend' END], lambda v: v IS NOT NULL) AS flags FROM bl JOIN cu ON bl.site = cu.site AND cu.i = cu.n JOIN tr ON bl.site = tr.site)
SELECT CAST(c_custkey AS VARCHAR) AS sample, round(c_acctbal / 10000, 6) AS score, coalesce(round(z, 3), 0) AS z_score, coalesce(z >= 2, false) AS baseline_anomaly, coalesce(round(c, 3), 0) AS cusum, coalesce(c > 4, false) AS cusum_alert, coalesce(fa, false) AS farrington_alarm, coalesce(trend, 'none') AS trend, coalesce(round(f, 4), 0) AS forecast_next, coalesce(array_to_string(flags, ','), '') AS flags,
  CASE WHEN c_acctbal / 10000 >= .6 THEN 'rule' WHEN len(flags) > 0 THEN 'temporal' ELSE 'none' END AS alert FROM customer LEFT JOIN ft ON ft.site = CAST(c_custkey AS VARCHAR)""")
def temporal_report(spark, sf):  # noqa: ANN001, ANN201
    """The report's join: scores of customers, temporal signals of users where there are any, alerts of rules and of signals alone."""
    score = F.col("c_acctbal") / 10000
    scores = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample"), score.cast("double").alias("score"), C.risk_level(score).alias("level"))
    signals = temporal.temporal_signals(points(spark, sf, "user_id"), window=1000, min_history=2001)
    report = temporal.with_temporal(scores, signals).join(signals.select(F.col("site").alias("sample"), "flags"), "sample", "left")
    fired = scoring.alerts(scores.withColumns({"novelty": F.lit(0.0), "cusum_alert": F.lit(False), "z_score": F.lit(0.0)}))
    merged = temporal.merged_alerts(fired, scores, signals).select("sample", F.when(F.startswith(F.col("reasons")[0], F.lit("temporal")), "temporal").otherwise("rule").alias("alert"))
    names = {"z_score": 0.0, "baseline_anomaly": False, "cusum": 0.0, "cusum_alert": False, "farrington_alarm": False, "trend": "none", "forecast_next": 0.0}
    return report.join(merged, "sample", "left").select("sample", F.round("score", 6).alias("score"), *[F.coalesce(F.col(f"temporal.{c}"), F.lit(v)).alias(c) for c, v in names.items()], F.coalesce(F.array_join("flags", ","), F.lit("")).alias("flags"), F.coalesce("alert", F.lit("none")).alias("alert"))


@query(f"""WITH {points_sql()}, e AS (SELECT CAST(event_type AS VARCHAR) AS site, strftime(ts, '%Y-%m-%d') AS t, count(*) AS v FROM events GROUP BY 1, 2), m AS (SELECT site, count(*) AS n, corr(x, v) AS r FROM p JOIN e USING (site, t) GROUP BY 1)
SELECT site, n AS n_matched, round(r, 6) AS r, r >= .5 AS concordant FROM m""")
def external_validation(spark, sf):  # noqa: ANN001, ANN201
    outside = load(spark, sf, "events").groupBy(F.col("event_type").alias("site"), F.date_format("ts", "yyyy-MM-dd").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return series.validate_external(points(spark, sf), outside).select("site", "n_matched", F.round("r", 6).alias("r"), "concordant")


RANKS = f"""{COUNTS}, rk AS (SELECT sample, taxon, rank() OVER (PARTITION BY taxon ORDER BY reads) + (count(*) OVER (PARTITION BY taxon, reads) - 1) / 2 AS r FROM grid)"""


@query(f"WITH {RANKS} SELECT a.taxon AS a, b.taxon AS b, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM rk a JOIN rk b ON a.sample = b.sample AND a.taxon < b.taxon GROUP BY 1, 2")
def spearman_rho_pairs(spark, sf):  # noqa: ANN001, ANN201
    return stats.spearman(full(spark, sf), "reads").select("a", "b", "n", F.round("rho", 6).alias("rho"))


@query("""WITH p AS (SELECT p_partkey, (p_retailprice - min(p_retailprice) OVER () + .01) / (max(p_retailprice) OVER () - min(p_retailprice) OVER () + .02) AS p FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS i, count(*) OVER () AS m FROM p)
SELECT p_partkey, round(least(min(p * m / i) OVER (ORDER BY i DESC), 1), 8) AS p_adj FROM r""")
def bh_adjust(spark, sf):  # noqa: ANN001, ANN201
    prices = load(spark, sf, "part")
    low, high = prices.agg(F.min("p_retailprice")).scalar(), prices.agg(F.max("p_retailprice")).scalar()
    tests = prices.select("p_partkey", ((F.col("p_retailprice") - low + 0.01) / (high - low + 0.02)).alias("p"))
    return stats.adjusted(tests).select("p_partkey", F.round("p_adj", 8).alias("p_adj"))


LINKED = f"""{COUNTS}, lk AS (SELECT sample, taxon, (reads + 1) * CASE WHEN length(taxon) % 4 = 0 THEN 1 + CAST(substr(sample, 2) AS BIGINT) % 7 ELSE 1 END AS x FROM grid),
rk AS (SELECT sample, taxon, rank() OVER (PARTITION BY taxon ORDER BY x) + (count(*) OVER (PARTITION BY taxon, x) - 1) / 2 AS r FROM lk),
pr AS (SELECT a.taxon AS a, b.taxon AS b, count(*) AS n, corr(a.r, b.r) AS rho FROM rk a JOIN rk b ON a.sample = b.sample AND a.taxon < b.taxon GROUP BY 1, 2),
pv AS (SELECT *, {student("rho", "n")} AS p FROM pr), o AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS i, count(*) OVER () AS m FROM pv),
q AS (SELECT *, least(min(p * m / i) OVER (ORDER BY i DESC), 1) AS p_adj FROM o)"""


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in which some taxa follow one course over the samples."""
    course = F.when(F.length("taxon") % 4 == 0, 1 + F.substring("sample", 2, 20).cast("long") % 7).otherwise(1)
    return full(spark, sf).select("sample", "taxon", ((F.col("reads") + 1) * course).alias("x"))


@query(f"WITH {LINKED} SELECT a, b, n, round(rho, 6) AS rho, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM q WHERE p_adj <= .05 AND abs(rho) >= .2")
def cooccurrence_edges(spark, sf):  # noqa: ANN001, ANN201
    return stats.cooccurrence(_linked(spark, sf), 0.2, 0.05, "x").select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("rho", "p", "p_adj")])


@query()
def sbm_membership(spark, sf):  # noqa: ANN001, ANN201
    return graph.communities(stats.cooccurrence(_linked(spark, sf), 0.2, 0.05, "x").select("a", "b"), 12, 10)


@query(f"WITH {COUNTS} SELECT a.sample AS a, b.sample AS b, round(sum(abs(a.rel - b.rel)) / sum(a.rel + b.rel), 6) AS distance FROM fullrel a JOIN fullrel b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY 1, 2")
def bray_curtis_pairs(spark, sf):  # noqa: ANN001, ANN201
    return stats.bray_curtis(full(spark, sf)).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"""WITH {COUNTS}, g AS (SELECT 'S' || s_suppkey AS sample, s_nationkey % 3 AS label FROM supplier), v AS (SELECT sample, taxon, reads AS x, label FROM grid JOIN g USING (sample)),
k AS (SELECT taxon, label, x, rank() OVER (PARTITION BY taxon ORDER BY x) + (count(*) OVER (PARTITION BY taxon, x) - 1) / 2 AS r FROM v),
n AS (SELECT taxon, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY 1), q AS (SELECT taxon, sum(s * s / m) AS q FROM (SELECT taxon, label, sum(r) AS s, count(*) AS m FROM k GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT taxon, sum(t * t * t - t) AS ties FROM (SELECT taxon, x, count(*) AS t FROM k GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT taxon, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM n JOIN q USING (taxon) JOIN t USING (taxon)),
p AS (SELECT *, round(exp(-h / 2), 6) AS p_value FROM h), o AS (SELECT *, row_number() OVER (ORDER BY p_value, taxon) AS i, count(*) OVER () AS m FROM p),
mn AS (SELECT taxon, max(m) / (min(m) + 1e-10) AS fold FROM (SELECT taxon, label, avg(x) AS m FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT taxon, round(h, 5) AS h, p_value, round(least(min(p_value * m / i) OVER (ORDER BY i DESC), 1), 6) AS p_adj, least(min(p_value * m / i) OVER (ORDER BY i DESC), 1) <= .05 AS significant, round(fold, 6) AS fold_change FROM o JOIN mn USING (taxon)""")
def kruskal_h(spark, sf):  # noqa: ANN001, ANN201
    groups = load(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample"), (F.col("s_nationkey") % 3).alias("label"))
    return stats.kruskal(full(spark, sf), groups, "reads").select("taxon", F.round("h", 5).alias("h"), "p_value", F.round("p_adj", 6).alias("p_adj"), "significant", F.round("fold_change", 6).alias("fold_change"))


@query()
def ward_clusters(spark, sf):  # noqa: ANN001, ANN201
    return cluster.ward_clusters(abundance.clr(full(spark, sf)))


@query()
def average_linkage_outbreaks(spark, sf):  # noqa: ANN001, ANN201
    values = full(spark, sf)
    return cluster.sample_outbreaks(values, values.where("rel > 0.03").select("sample"), 0.15)


@query()
def iforest_novelty(spark, sf):  # noqa: ANN001, ANN201
    return novelty.cohort_novelty(abundance.clr(full(spark, sf)))


def kmers_sql(sample: str, k: int = 6, letters: str = "a-z") -> str:
    """SQL of the profiles of documents' k-letter words, a sample for each value of an expression."""
    word = " || ".join(["c", *[f"lead(c, {i}) OVER w" for i in range(1, k)]])
    return f"""r AS (SELECT {sample} AS sample, row_number() OVER () AS id, lower(text) AS s FROM documents), e AS (SELECT sample, id, unnest(string_split(s, '')) AS c, unnest(range(length(s))) AS i FROM r),
k AS (SELECT sample, id, {word} AS kmer FROM e WINDOW w AS (PARTITION BY id ORDER BY i)), f AS (SELECT * FROM k WHERE regexp_full_match(kmer, '[{letters}]{{{k}}}')),
d AS (SELECT sample, id, kmer, count(*) AS c FROM f GROUP BY ALL), c AS (SELECT *, sum(c) OVER (PARTITION BY id) AS n FROM d), n AS (SELECT sample, count(*) AS reads FROM r GROUP BY 1), prof AS (SELECT sample, kmer, sum(c.c / CAST(c.n AS DOUBLE)) / any_value(reads) AS freq FROM c JOIN n USING (sample) GROUP BY 1, 2)"""


REFERENCE = """m AS (SELECT kmer, sum(freq) / any_value(n) AS mean, sum(freq * freq) / any_value(n) AS sq FROM base CROSS JOIN (SELECT count(DISTINCT sample) AS n FROM base) GROUP BY 1),
s AS (SELECT kmer, mean, sqrt(greatest(sq - mean * mean, 0)) AS sd FROM m), fl AS (SELECT greatest(quantile_cont(sd, .5), 1e-9) AS f FROM s WHERE sd > 0), kp AS (SELECT kmer, mean, sd FROM s, fl WHERE sd > f),
z AS (SELECT a.sample, kp.kmer, least(greatest((coalesce(freq, 0) - mean) / sd, -8), 8) AS z FROM (SELECT DISTINCT sample FROM prof) a CROSS JOIN kp LEFT JOIN prof p ON p.sample = a.sample AND p.kmer = kp.kmer),
zb AS (SELECT z.* FROM z SEMI JOIN base USING (sample)), ds AS (SELECT x.sample, y.sample AS other, sqrt(sum((x.z - y.z) * (x.z - y.z))) AS d FROM z x JOIN zb y ON x.kmer = y.kmer AND x.sample <> y.sample GROUP BY 1, 2),
nn AS (SELECT sample, avg(d) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d, other) AS i FROM ds) WHERE i <= 5 GROUP BY 1),
own AS (SELECT nn.* FROM nn SEMI JOIN base USING (sample)), cal AS (SELECT median(distance) AS md, 3 * 1.4826 * mad(distance) + 1e-9 AS sc FROM own)
SELECT sample, round(least(greatest((distance - md) / (sc + 1e-9), 0), 1), 4) AS novelty FROM nn, cal"""


def _profiles(spark: SparkSession, sf: str, sample: str = "source", k: int = 6) -> DataFrame:
    reads = load(spark, sf, "documents").select(F.expr(sample).alias("sample"), F.col("doc_id").alias("read_no"), F.lower("text").alias("seq"))
    return novelty.kmer_profiles(reads, k, "a-z", fold=False)


@query(f"WITH {kmers_sql('source', 4)} SELECT sample, kmer, round(freq, 8) AS freq FROM prof")
def kmer_profile(spark, sf):  # noqa: ANN001, ANN201
    return _profiles(spark, sf, k=4).select("sample", "kmer", F.round("freq", 8).alias("freq"))


@query(f"WITH {kmers_sql('source')}, base AS (SELECT * FROM prof), {REFERENCE}")
def kmer_knn_novelty(spark, sf):  # noqa: ANN001, ANN201
    return novelty.kmer_novelty(tables.cut(_profiles(spark, sf)))


@query(f"""WITH {kmers_sql("source || '-' || lang")}, base AS (SELECT * FROM prof WHERE ends_with(sample, '-en')), {REFERENCE} WHERE NOT ends_with(sample, '-en')""")
def kmer_background_novelty(spark, sf):  # noqa: ANN001, ANN201
    """Texts of other languages against English ones of all sources."""
    every = tables.cut(_profiles(spark, sf, "source || '-' || lang"))
    english = F.endswith("sample", F.lit("-en"))
    return novelty.kmer_novelty(every.where(~english), every.where(english))


CODES = """WITH c AS (SELECT label AS code, pos, avg(x) AS c FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2),
d AS (SELECT vec_id, code, sum((x - c) * (x - c)) AS d2 FROM (SELECT vec_id, unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) JOIN c USING (pos) GROUP BY 1, 2)"""


def _codes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vectors, and the mean of each label's as a codebook."""
    vectors = load(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = vectors.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.avg("col").alias("x")).groupBy(F.col("label").alias("code")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))
    return vectors, means


@query(f"{CODES} SELECT vec_id, arg_min(code, (d2, code)) AS code, round(min(d2), 5) AS distance2 FROM d GROUP BY 1")
def nearest_code(spark, sf):  # noqa: ANN001, ANN201
    return novelty.nearest_codes(*_codes(spark, sf)).select("vec_id", "code", F.round("distance2", 5).alias("distance2"))


SCORED = "s AS (SELECT lang, n_chars / (n_chars + 2000.0) AS score, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS label FROM documents LEFT JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    return docs.select("lang", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"), (F.col("quality") == 1).alias("label"))


CONFUSION = f"""{SCORED}, m AS (SELECT lang, count(*) FILTER (score >= .6 AND label) AS tp, count(*) FILTER (score >= .6 AND NOT label) AS fp, count(*) FILTER (score < .6 AND NOT label) AS tn, count(*) FILTER (score < .6 AND label) AS fn FROM s WHERE label IS NOT NULL GROUP BY 1),
r AS (SELECT *, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS sensitivity, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision, 2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0) AS f1 FROM m)"""


@query(f"WITH {CONFUSION} SELECT lang, tp, fp, tn, fn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM r")
def confusion_metrics(spark, sf):  # noqa: ANN001, ANN201
    out = metrics.confusion(_scored(spark, sf), ["lang"])
    return out.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "precision", "f1")])


@query(f"WITH {CONFUSION} SELECT round(avg(coalesce(f1, 0)) FILTER (sensitivity IS NOT NULL), 6) AS macro_f1, round(sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE), 6) AS micro_sensitivity, round(sum(tn) / CAST(sum(tn) + sum(fp) AS DOUBLE), 6) AS micro_specificity FROM r")
def macro_micro(spark, sf):  # noqa: ANN001, ANN201
    out = metrics.overall(metrics.confusion(_scored(spark, sf), ["lang"]))
    return out.select(*[F.round(c, 6).alias(c) for c in ("macro_f1", "micro_sensitivity", "micro_specificity")])


ROC = f"""{SCORED}, g AS (SELECT score, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS q FROM s WHERE label IS NOT NULL GROUP BY 1),
c AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM g WINDOW w AS (ORDER BY score DESC)),
pts AS (SELECT score AS threshold, tp, fp, tp / CAST(np AS DOUBLE) AS tpr, fp / CAST(nq AS DOUBLE) AS fpr FROM c)"""


@query(f"WITH {ROC} SELECT round(threshold, 10) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr FROM pts")
def roc_points(spark, sf):  # noqa: ANN001, ANN201
    return metrics.roc_points(_scored(spark, sf)).select(F.round("threshold", 10).alias("threshold"), "tp", "fp", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


@query(f"""WITH {ROC}, d AS (SELECT *, coalesce(lag(tpr) OVER o, 0) AS pt, coalesce(lag(fpr) OVER o, 0) AS pf FROM pts WINDOW o AS (ORDER BY threshold DESC))
SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auroc, round(sum((tpr - pt) * tp / (tp + fp)), 6) AS auprc, round(max(CASE WHEN tpr >= .95 THEN threshold END), 8) AS theta_sensitivity FROM d""")
def auroc(spark, sf):  # noqa: ANN001, ANN201
    return metrics.roc_summary(_scored(spark, sf)).select(*[F.round(c, n).alias(c) for c, n in (("auroc", 6), ("auprc", 6), ("theta_sensitivity", 8))])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, .025), 6) AS low, round(quantile_cont(value, .975), 6) AS high FROM events GROUP BY 1")
def percentile_ci(spark, sf):  # noqa: ANN001, ANN201
    return metrics.interval(load(spark, sf, "events"), ["event_type"], "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("""WITH c AS (SELECT l_suppkey AS k, p_name AS taxon, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), n AS (SELECT k, sum(x) AS n, count(*) AS s FROM c GROUP BY 1), d AS (SELECT unnest([10, 100, 1000]) AS depth)
SELECT 'S' || k AS sample, CAST(depth AS BIGINT) AS depth, round(any_value(s) - sum(exp(lgamma(n - x + 1) - lgamma(n - x - least(depth, n) + 1) - lgamma(n + 1) + lgamma(n - least(depth, n) + 1))) FILTER (n - x >= least(depth, n)), 4) AS richness FROM c JOIN n USING (k) CROSS JOIN d GROUP BY k, depth""")
def rarefaction(spark, sf):  # noqa: ANN001, ANN201
    return planning.richness(counts(spark, sf), [10, 100, 1000]).withColumn("richness", F.round("richness", 4))


@query("""WITH c AS (SELECT l_suppkey AS k, p_name AS taxon, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), n AS (SELECT k, sum(x) AS n, count(*) AS s FROM c GROUP BY 1),
d AS (SELECT DISTINCT k, depth FROM (SELECT k, unnest(list_append(list_transform(range(0, 19), lambda i: CAST(floor(exp(ln(n) * i / 19)) AS BIGINT)), CAST(n AS BIGINT))) AS depth FROM n) WHERE depth >= 1)
SELECT 'S' || k AS sample, depth, round(any_value(s) - coalesce(sum(exp(lgamma(n - x + 1) - lgamma(n - x - depth + 1) - lgamma(n + 1) + lgamma(n - depth + 1))) FILTER (n - x >= depth), 0), 4) AS richness FROM c JOIN n USING (k) JOIN d USING (k) GROUP BY k, depth""")
def rarefaction_curve(spark, sf):  # noqa: ANN001, ANN201
    return planning.rarefaction(counts(spark, sf)).withColumn("richness", F.round("richness", 4))


@query("SELECT p_partkey, round(1 - exp(-p_retailprice / 500) * (1 + p_retailprice / 500 + p_retailprice / 500 * p_retailprice / 500 / 2), 8) AS power FROM part")
def poisson_plan(spark, sf):  # noqa: ANN001, ANN201
    return load(spark, sf, "part").select("p_partkey", F.round(C.poisson_power(F.col("p_retailprice") / 500, 3), 8).alias("power"))


ALERTS = """r AS (SELECT c_custkey AS sample, c_acctbal / 10000 AS score, CASE WHEN c_acctbal / 10000 >= 0.8 THEN 'CRITICAL' WHEN c_acctbal / 10000 >= 0.6 THEN 'HIGH' WHEN c_acctbal / 10000 >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS level, c_nationkey / 25.0 AS novelty, c_nationkey = 7 AS cusum_alert, c_acctbal / 4000 AS z_score FROM customer)"""


def _report(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("c_acctbal") / 10000
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("sample"), score.alias("score"), C.risk_level(score).alias("level"), (F.col("c_nationkey") / 25.0).alias("novelty"), (F.col("c_nationkey") == 7).alias("cusum_alert"), (F.col("c_acctbal") / 4000).alias("z_score"))


@query(f"WITH {ALERTS} SELECT sample, level, CAST((level IN ('HIGH', 'CRITICAL'))::INT + (score >= .6)::INT + (novelty >= .9)::INT + (cusum_alert OR z_score > 2)::INT AS INTEGER) AS n_reasons FROM r WHERE level IN ('HIGH', 'CRITICAL') OR score >= .6 OR novelty >= .9 OR cusum_alert OR z_score > 2")
def alert_rules(spark, sf):  # noqa: ANN001, ANN201
    return scoring.alerts(_report(spark, sf), novelty_min=0.9).select("sample", "level", F.size("reasons").alias("n_reasons"))


@query(f"WITH {ALERTS} SELECT sample, level FROM r WHERE cusum_alert OR z_score > 2 OR level IN ('HIGH', 'CRITICAL')")
def dashboard_alerts(spark, sf):  # noqa: ANN001, ANN201
    return scoring.dashboard_alerts(_report(spark, sf)).select("sample", "level")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k FROM events")
def json_props(spark, sf):  # noqa: ANN001, ANN201
    return load(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"))


@query("SELECT page_id, array_to_string(list_filter(['href', 'table', 'script', 'license'], lambda w: contains(lower(html), w)), ',') AS hits FROM pages")
def keyword_scan(spark, sf):  # noqa: ANN001, ANN201
    return load(spark, sf, "pages").select("page_id", F.array_join(C.keyword_hits(F.col("html"), ["href", "table", "script", "license"]), ",").alias("hits"))


@query("SELECT item_id, unnest(CASE WHEN length(text) <= 150 THEN [text] ELSE list_transform(range(0, length(text) - 149, 75), lambda i: substr(text, i + 1, 150)) END) AS w FROM benchmark")
def seq_windows(spark, sf):  # noqa: ANN001, ANN201
    return load(spark, sf, "benchmark").select("item_id", F.explode(C.read_windows(F.col("text"))).alias("w"))


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS i FROM documents) SELECT source, doc_id FROM s WHERE i <= 5")
def hash_sample_topn(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"))
    return load(spark, sf, "documents").withColumn("i", place).where("i <= 5").select("source", "doc_id")


@query("""SELECT 'both' AS kind, n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers_only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf):  # noqa: ANN001, ANN201
    c, s = load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    kinds = {"both": c.intersect(s), "customers_only": c.subtract(s), "any": c.union(s).distinct()}
    out = None
    for name, rows in kinds.items():
        part = rows.select(F.lit(name).alias("kind"), "k")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {COUNTS}, n AS (SELECT count(DISTINCT sample) AS n FROM counts), f AS (SELECT taxon FROM rel GROUP BY taxon ORDER BY sum(rel) DESC, taxon LIMIT 50),
v AS (SELECT taxon, coalesce(sum(rel) FILTER (sample = 'S1'), 0) AS before, coalesce(sum(rel) FILTER (sample = 'S2'), 0) AS after FROM rel SEMI JOIN f USING (taxon) WHERE sample IN ('S1', 'S2') GROUP BY 1),
k AS (SELECT *, CASE WHEN before = 0 THEN 'appeared' WHEN after = 0 THEN 'disappeared' ELSE 'changed' END AS class FROM v WHERE abs(after - before) >= .005),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(after - before) DESC, taxon) AS i FROM k) SELECT class, taxon, round(after - before, 8) AS delta FROM r WHERE i <= 30""")
def diff_samples(spark, sf):  # noqa: ANN001, ANN201
    return abundance.sample_difference(rel(spark, sf), "S1", "S2").select("class", "taxon", F.round("delta", 8).alias("delta"))


@query("SELECT event_type AS site, strftime(ts, '%Y-%m-%d') AS t, round(avg(value), 6) AS x, count(*) AS n FROM events GROUP BY 1, 2")
def stream_watch_available_now(spark, sf):  # noqa: ANN001, ANN201
    import uuid

    at = load(spark, sf, "events").schema
    name = f"daily_{uuid.uuid4().hex}"
    source = spark.readStream.schema(at).parquet(f"{sf}/events.parquet*").select(F.col("event_type").alias("site"), F.col("ts").cast("timestamp").alias("ts"), "value")
    stream_daily_scores(source, "40 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("site", F.date_format("t", "yyyy-MM-dd").alias("t"), F.round("x", 6).alias("x"), "n")


@query(f"""WITH RECURSIVE {FARRINGTON}, rz AS (SELECT site, t, x, row_number() OVER s AS i, count(*) OVER b AS n, avg(x) OVER b AS m, stddev_samp(x) OVER b AS sd FROM h WINDOW s AS (PARTITION BY site ORDER BY t), b AS (PARTITION BY site ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
cb AS (SELECT *, avg(CASE WHEN i <= 8 THEN x END) OVER (PARTITION BY site) AS bm, coalesce(nullif(stddev_samp(CASE WHEN i <= 8 THEN x END) OVER (PARTITION BY site), 0), 1) AS bs FROM rz),
up AS (SELECT *, sum(CASE WHEN i > 8 THEN (x - bm) / bs - .5 ELSE 0 END) OVER (PARTITION BY site ORDER BY i) AS u FROM cb), cs AS (SELECT *, u - least(0, min(u) OVER (PARTITION BY site ORDER BY i)) AS c FROM up)
SELECT cs.site, cs.t, round(CASE WHEN n < 2 THEN 0 ELSE (cs.x - cs.m) / (cs.sd + 1e-10) END, 6) AS z_score, round(c, 5) AS cusum, c > 4 AS cusum_alert, round(coalesce(ex, o.m) / 100, 6) AS expected, round(coalesce(lim, 1.5 * o.m + 1e-6) / 100, 6) AS threshold, round(coalesce(greatest(z, 0) / (greatest(z, 0) + 2), 0), 4) AS exceedance,
  now > coalesce(lim, 1.5 * o.m + 1e-6) AS alarm, CASE WHEN ex IS NULL THEN 'insufficient or flat history' ELSE 'ok' END AS note FROM cs JOIN o ON cs.site = o.site AND cs.t = o.t""")
def stream_signals(spark, sf):  # noqa: ANN001, ANN201
    """Rolling z, CUSUM and Farrington's test of each user's day, from a stream with state; written and read as a table."""
    line = points(spark, sf, "user_id").select("site", F.to_timestamp("t", "yyyy-MM-dd").alias("t"), (F.col("x") * 1.0266940451745).alias("x"))
    path = tables.new_path(spark)
    line.write.parquet(f"{path}/in")
    source = spark.readStream.schema("site string, t timestamp, x double").parquet(f"{path}/in")
    started(streamed_signals(source, "3650 days"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select("site", F.date_format("t", "yyyy-MM-dd").alias("t"), F.round("z_score", 6).alias("z_score"), F.round("cusum", 5).alias("cusum"), "cusum_alert", "expected", "threshold", "exceedance", "alarm", "note")


@query(f"""WITH {kmers_sql("source", 4, "acgt")}, v AS (SELECT array_to_string(list_transform([k // 64, k // 16 % 4, k // 4 % 4, k % 4], lambda i: substr('ACGT', i + 1, 1)), '') AS kmer, CAST(k AS INTEGER) AS index FROM (SELECT unnest(range(0, 256)) AS k))
SELECT v.kmer, index, round(coalesce(sum(freq), 0), 8) AS freq FROM v LEFT JOIN prof ON upper(prof.kmer) = v.kmer GROUP BY 1, 2""")
def kmer_vocabulary(spark, sf):  # noqa: ANN001, ANN201
    """All words of four of the letters, in order, with how much of the documents' words of these letters they are, added up over sources."""
    reads = load(spark, sf, "documents").select(F.col("source").alias("sample"), F.col("doc_id").alias("read_no"), F.lower("text").alias("seq"))
    seen = novelty.kmer_profiles(reads, 4).groupBy("kmer").agg(F.sum("freq").alias("freq"))
    return novelty.kmer_vocabulary(spark, 4).join(seen, "kmer", "left").select("kmer", "index", F.round(F.coalesce("freq", F.lit(0.0)), 8).alias("freq"))


@query(f"""{CODES} SELECT vec_id, round(least(min(d2) / 64, 1), 5) AS novelty, round(min(d2) / 64, 5) > .015 AS is_novel FROM d GROUP BY 1""")
def embedding_novelty(spark, sf):  # noqa: ANN001, ANN201
    """How far vectors lie from their nearest code, the mean square of a component's difference being the loss."""
    losses = novelty.nearest_codes(*_codes(spark, sf)).select("vec_id", F.round(F.col("distance2") / 64, 5).alias("loss"))
    return novelty.embedding_novelty(losses, 0.015, 1.0).select("vec_id", F.round("novelty", 5).alias("novelty"), "is_novel")


@query(f"""WITH {COUNTS}, {BASE}, b AS (SELECT taxon FROM base WHERE median > .005), pr AS (SELECT sample, taxon, ln(rel + 1e-6) AS l, rel FROM rel WHERE rel > 0), u AS (SELECT sample, sum(l) AS s, count(*) AS m, count(*) FILTER (taxon IN (SELECT taxon FROM b)) AS h FROM pr GROUP BY 1)
SELECT sample, taxon, round(l - (s + ((SELECT count(*) FROM b) - h) * ln(1e-6)) / (m + (SELECT count(*) FROM b) - h), 6) AS clr FROM pr JOIN u USING (sample)""")
def clr_sample(spark, sf):  # noqa: ANN001, ANN201
    base = baseline.fit(rel(spark, sf)).where("median > 0.005")
    return baseline.sample_log_ratios(rel(spark, sf), base).select("sample", "taxon", F.round("clr", 6).alias("clr"))


@query(f"""WITH {COUNTS}, g AS (SELECT 'S' || s_suppkey AS sample, s_nationkey % 3 AS label FROM supplier), m AS (SELECT taxon, label, round(avg(rel), 6) AS m FROM fullrel JOIN g USING (sample) GROUP BY 1, 2)
SELECT taxon, array_to_string(list(label || ':' || CAST(CAST(round(m * 1e6) AS BIGINT) AS VARCHAR) ORDER BY label), ',') AS means, round(max(m) / (min(m) + 1e-10), 6) AS fold_change FROM m GROUP BY 1""")
def cluster_profiles(spark, sf):  # noqa: ANN001, ANN201
    groups = load(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample"), (F.col("s_nationkey") % 3).alias("label"))
    out = stats.cluster_profiles(full(spark, sf), groups)
    means = F.array_join(F.transform(F.map_entries("cluster_means"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.round(e["value"] * 1e6).cast("long").cast("string"))), ",")
    return out.select("taxon", means.alias("means"), F.round("fold_change", 6).alias("fold_change"))


@query(f"""WITH {COUNTS}, sp AS (SELECT sample, least(max(abs(clr - m) / (s + 1e-10)) / 7.5, 1) AS spike FROM (SELECT *, avg(clr) OVER (PARTITION BY taxon) AS m, stddev_pop(clr) OVER (PARTITION BY taxon) AS s FROM clr) GROUP BY sample),
mr AS (SELECT sample, rel, sum(rel) OVER (PARTITION BY taxon) / (SELECT count(DISTINCT sample) FROM counts) AS m FROM rel), nv AS (SELECT sample, least(4 * sum(rel), 1) AS share FROM mr WHERE rel > 1.4 * m GROUP BY 1)
SELECT sample, round(greatest(spike, coalesce(share, 0)), 6) AS novelty FROM sp LEFT JOIN nv USING (sample)""")
def novelty_fusion(spark, sf):  # noqa: ANN001, ANN201
    """The larger of a sample's spike over the cohort and its share of reads of taxa far beyond their mean."""
    spikes = baseline.cohort_spikes(abundance.clr(full(spark, sf))).withColumnRenamed("spike", "novelty")
    shares = abundance.novel_taxa(rel(spark, sf), None, 0.001, 1.4).groupBy("sample").agg(F.least(4 * F.sum("rel"), F.lit(1.0)).alias("novelty"))
    return novelty.fused_novelty(spikes, shares).select("sample", F.round("novelty", 6).alias("novelty"))


@query("""WITH g AS (SELECT c_custkey, greatest(c_acctbal, 0) / 500.0 AS e, c_nationkey / 25.0 AS w, CASE WHEN c_custkey % 9 = 0 THEN .85 ELSE 0 END AS t, c_acctbal > 3000 AS label FROM customer), k AS (SELECT unnest([.75, 1, 1.25, 1.5, 2, 2.5, 3]) AS k),
s AS (SELECT k, label, greatest(e / (e + k) * (.5 + .5 * w), t) AS score FROM g, k), c AS (SELECT k, count(*) FILTER (score >= .6 AND label) AS tp, count(*) FILTER (score >= .6 AND NOT label) AS fp, count(*) FILTER (score < .6 AND NOT label) AS tn, count(*) FILTER (score < .6 AND label) AS fn FROM s GROUP BY 1)
SELECT CAST(k AS DOUBLE) AS k, tp, fp, tn, fn, round(tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE) - 1, 6) AS youden FROM c""")
def squash_calibration(spark, sf):  # noqa: ANN001, ANN201
    from tidewatch.synth import calibrate_squash

    own = load(spark, sf, "customer")
    rows = own.select((F.greatest("c_acctbal", F.lit(0)) / 500.0).cast("double").alias("exceedance"), (F.col("c_nationkey") / 25.0).cast("double").alias("risk_weight"), F.when(F.col("c_custkey") % 9 == 0, 0.85).otherwise(0.0).alias("tripwire"), (F.col("c_acctbal") > 3000).alias("label"))
    return calibrate_squash(spark, rows).select("k", "tp", "fp", "tn", "fn", F.round("youden", 6).alias("youden"))


@query(f"""WITH {points_sql()}, s AS (SELECT site || t AS sample, x AS score, CAST(t AS DATE) AS date FROM p), i AS (SELECT *, row_number() OVER (ORDER BY date, sample) AS i, count(*) OVER () AS n FROM s),
b AS (SELECT *, avg(CASE WHEN i <= greatest(2, n // 2) THEN score END) OVER () AS m, stddev_samp(CASE WHEN i <= greatest(2, n // 2) THEN score END) OVER () AS sd FROM i),
u AS (SELECT *, sum((score - m) / sd - .5) OVER (ORDER BY i) AS up FROM b)
SELECT sample, strftime(date, '%Y-%m-%d') AS date, i - 1 AS run_index, round(up - least(0, min(up) OVER (ORDER BY i)), 6) AS cusum FROM u""")
def chronological_cusum(spark, sf):  # noqa: ANN001, ANN201
    own = points(spark, sf).select(F.concat("site", "t").alias("sample"), F.col("x").alias("score"), F.to_date("t").alias("date"))
    out = temporal.chronological(own.select("sample", "score"), own.select("sample", "date"))
    return out.select("sample", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("run_index").cast("long").alias("run_index"), F.round("cusum", 6).alias("cusum"))


def _cohorts(spark: SparkSession, sf: str, scenario: F.Column) -> tuple[DataFrame, DataFrame]:
    """Counts and truth of suppliers as cohorts: a scenario of each nation; an alert is expected of a high balance."""
    own = load(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample"), scenario.alias("scenario"), (F.col("s_acctbal") > 5000).alias("label"))
    rows = counts(spark, sf).join(own, "sample")
    return rows.select("scenario", "sample", "taxon", "reads"), rows.select("scenario", "sample", "label").distinct()


def _first_genus(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension of one genus, the first by name: `dimension` comes to hold all genera as parts grow, and then nothing tells cohorts apart."""
    return load(spark, sf, "part").agg(F.min(C.genus("p_name")).alias("genus")).withColumn("risk_weight", F.lit(0.5))


SWEPT = (0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)
COHORT_SCORES = """dim AS (SELECT min(split_part(p_name, ' ', 1)) AS genus, CAST(.5 AS DOUBLE) AS risk_weight FROM part), kt AS (SELECT scenario, taxon FROM cc JOIN (SELECT scenario, count(DISTINCT sample) AS n FROM cc GROUP BY 1) USING (scenario) GROUP BY scenario, taxon, n HAVING count(*) FILTER (reads > 0) / CAST(n AS DOUBLE) >= .05 AND sum(reads) >= 10),
cr AS (SELECT scenario, sample, label, taxon, reads / sum(reads) OVER (PARTITION BY scenario, sample) AS rel FROM cc SEMI JOIN kt USING (scenario, taxon)),
cd AS (SELECT scenario, sample, taxon, rel, risk_weight, risk_weight * rel AS c, row_number() OVER (PARTITION BY scenario, sample ORDER BY risk_weight * rel DESC, taxon) AS i FROM cr JOIN dim ON genus = split_part(taxon, ' ', 1) WHERE rel > 0),
cg AS (SELECT scenario, sample, least(sum(c), 1) AS ab, count(*) AS n, CASE WHEN count(*) >= 2 THEN sum(c) FILTER (i <= 4) ELSE 0 END AS load, max(risk_weight) FILTER (i = 1) AS w, max(rel) FILTER (i = 1) AS a FROM cd GROUP BY 1, 2),
cs AS (SELECT scenario, sample, label, coalesce(greatest(.5 * ab, CASE WHEN w >= .85 AND a >= .05 THEN .85 WHEN w >= .7 AND a >= .15 THEN .65 WHEN w >= .7 AND a >= .05 THEN .4 WHEN w >= .5 AND a >= .2 THEN .35 ELSE 0 END, CASE WHEN n < 2 THEN 0 WHEN load >= .1 THEN .62 WHEN load >= .04 THEN .38 ELSE 0 END), 0) AS score FROM (SELECT DISTINCT scenario, sample, label FROM cc) LEFT JOIN cg USING (scenario, sample))"""


@query()
def benchmark_comparison(spark, sf):  # noqa: ANN001, ANN201
    """Four methods over the suppliers' cohorts; the thirds of the suppliers are the runs over which the intervals go."""
    from tidewatch import synth

    rows, known = _cohorts(spark, sf, F.concat_ws("_", F.col("s_suppkey") % 3, "s_nationkey"))
    sample = F.concat_ws("/", "scenario", "sample")
    signals = known.join(_signals(spark, sf), "sample").select(sample.alias("sample"), "community", "novelty")
    pathogens = _first_genus(spark, sf)
    scored = synth.cohort_scores(rows, known, pathogens, signals=signals)
    plain = synth.cohort_scores(rows, known, pathogens).select("sample", F.col("score").alias("alone"))
    each = synth.confusion_by_method(scored.withColumn("seed", F.split("scenario", "_")[0]), plain, 0.3, ("seed",))
    return synth.macro_interval(each).select("method", "measure", *[F.round(c, 8).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {COUNTS}, hs AS (SELECT *, split_part(taxon, ' ', 1) = (SELECT min(split_part(p_name, ' ', 1)) FROM part) AS known FROM counts), sm AS (SELECT sample, sum(reads) AS every, sum(CASE WHEN known THEN reads ELSE 0 END) AS hit FROM hs GROUP BY 1),
cc AS (SELECT level || '_' || CAST(substr(sample, 2) AS BIGINT) % 10 AS scenario, level, sample, true AS label, taxon, reads * CASE WHEN known THEN level * every / hit ELSE (1 - level) * every / (every - hit) END AS reads
  FROM hs JOIN sm USING (sample), (SELECT CAST(unnest({list(SWEPT)}) AS DOUBLE) AS level) WHERE hit > 0 AND hit < every), {COHORT_SCORES},
rt AS (SELECT CAST(split_part(scenario, '_', 1) AS DOUBLE) AS level, scenario, avg(CASE WHEN score >= .6 THEN 1 ELSE 0 END) AS rate FROM cs GROUP BY 1, 2)
SELECT level, round(avg(rate), 8) AS mean, round(quantile_cont(rate, .025), 8) AS low, round(quantile_cont(rate, .975), 8) AS high FROM rt GROUP BY 1""")
def abundance_sweep(spark, sf):  # noqa: ANN001, ANN201
    """The share of samples that alert when known genera are brought to each share of their reads, over ten parts of the suppliers."""
    from tidewatch import synth

    pathogens = _first_genus(spark, sf)
    rows = synth.at_levels(counts(spark, sf), pathogens, SWEPT).withColumn("scenario", F.concat_ws("_", F.col("level").cast("string"), F.substring("sample", 2, 20).cast("long") % 10))
    known = rows.select("scenario", "sample", F.lit(True).alias("label")).distinct()
    scored = synth.cohort_scores(rows.select("scenario", "sample", "taxon", "reads"), known, pathogens)
    on = scored.select(F.split("scenario", "_")[0].cast("double").alias("level"), "scenario", F.coalesce(F.col("score") >= 0.6, F.lit(False)).cast("double").alias("on"))
    out = metrics.interval(on.groupBy("level", "scenario").agg(F.avg("on").alias("rate")), ["level"], "rate")
    return out.select("level", *[F.round(c, 8).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {COUNTS}, cc AS (SELECT CAST(s_nationkey AS VARCHAR) AS scenario, s_acctbal > 5000 AS label, c.* FROM counts c JOIN supplier ON sample = 'S' || s_suppkey), {COHORT_SCORES},
cf AS (SELECT scenario, count(*) FILTER (score >= .3 AND label) AS tp, count(*) FILTER (score >= .3 AND NOT label) AS fp, count(*) FILTER (score < .3 AND NOT label) AS tn, count(*) FILTER (score < .3 AND label) AS fn FROM cs GROUP BY 1)
SELECT scenario, tp, fp, tn, fn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 8) AS sensitivity, round(CASE WHEN fp + tn > 0 THEN tn / (fp + tn) END, 8) AS specificity FROM cf""")
def synthetic_benchmark(spark, sf):  # noqa: ANN001, ANN201
    """Confusion of the absolute scorer in each nation's cohort of suppliers."""
    from tidewatch import synth

    rows, known = _cohorts(spark, sf, F.col("s_nationkey").cast("string"))
    out = metrics.confusion(synth.cohort_scores(rows, known, _first_genus(spark, sf)), ["scenario"], 0.3)
    return out.select("scenario", "tp", "fp", "tn", "fn", F.round("sensitivity", 8).alias("sensitivity"), F.round("specificity", 8).alias("specificity"))


MEMBERS = f"""{COUNTS}, {DIM}, mb AS (SELECT DISTINCT p_name AS taxon, length(p_name) % 5 AS label FROM part), fl AS (SELECT label FROM mb LEFT JOIN dim ON genus = split_part(taxon, ' ', 1) GROUP BY 1 HAVING avg(CASE WHEN genus IS NULL THEN 0 ELSE 1 END) >= .75)"""


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(F.col("p_name").alias("taxon"), (F.length("p_name") % 5).alias("label")).distinct()


@query(f"WITH {MEMBERS} SELECT label FROM fl")
def pathogen_communities(spark, sf):  # noqa: ANN001, ANN201
    """Communities (by length of name) in which known genera are enriched."""
    return scoring.pathogen_communities(_members(spark, sf), dimension(spark, sf), 0.75)


@query(f"WITH {MEMBERS} SELECT sample, CASE WHEN avg(CASE WHEN fl.label IS NULL THEN 0 ELSE 1 END) >= .6 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS community FROM rel JOIN mb USING (taxon) LEFT JOIN fl USING (label) WHERE rel > 0 GROUP BY 1")
def community_share(spark, sf):  # noqa: ANN001, ANN201
    """Samples of whose taxa most are in such a community."""
    members = _members(spark, sf)
    return scoring.community_signal(rel(spark, sf), members, scoring.pathogen_communities(members, dimension(spark, sf), 0.75), 0.6)


@query(f"""WITH {COUNTS}, {DIM}, rs AS (SELECT split_part(p_name, ' ', 1) AS genus, CASE WHEN min(p_size) < 2 THEN 'critical' WHEN min(p_partkey) % 2 = 0 THEN 'high' ELSE 'medium' END AS priority, count(DISTINCT p_size) % 7 AS n FROM part GROUP BY 1),
f AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY sample, genus ORDER BY contribution DESC, taxon) = 1)
SELECT sample, genus, taxon, priority, round(.6 * CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN .7 ELSE .4 END + .2 * least(n / 5, 1) + .2 * rel, 4) AS amr_score FROM f JOIN rs USING (genus)""")
def resistance_annotation(spark, sf):  # noqa: ANN001, ANN201
    """The first detection of each genus in a sample, with the genus's resistance."""
    priority = F.when(F.min("p_size") < 2, "critical").when(F.min("p_partkey") % 2 == 0, "high").otherwise("medium")
    known = load(spark, sf, "part").groupBy(C.genus("p_name").alias("genus")).agg(priority.alias("priority"), (F.count_distinct("p_size") % 7).alias("n_resistances"))
    out = scoring.annotate_resistance(scoring.detected(rel(spark, sf), dimension(spark, sf)), known)
    return out.select("sample", "genus", "taxon", "priority", "amr_score")


@query(f"""WITH {COUNTS}, ln AS (SELECT p_name AS species, round(avg(p_size) / 50, 4) AS e FROM part GROUP BY 1 HAVING min(p_size) < 3)
SELECT sample, taxon AS species, round(e * rel, 8) AS weight FROM rel JOIN ln ON species = taxon WHERE rel >= .015""")
def lineage_annotation(spark, sf):  # noqa: ANN001, ANN201
    """Taxa at the threshold that a table of species knows, weighted by abundance."""
    known = load(spark, sf, "part").groupBy(F.col("p_name").alias("species")).agg(F.round(F.avg("p_size") / 50, 4).alias("risk_elevation"), F.min("p_size").alias("least")).where("least < 3").drop("least")
    return scoring.annotate_lineages(rel(spark, sf), known, 0.015).select("sample", "species", F.round("weight", 8).alias("weight"))


PLACES = """pl AS (SELECT lower(p_name) AS name, min(p_size) AS lat, -max(p_size) AS lon FROM part GROUP BY 1 HAVING min(p_partkey) % 3 > 0 UNION ALL SELECT DISTINCT lower(split_part(p_name, ' ', 2)), 1, -1 FROM part),
sm AS (SELECT p_partkey AS sample, 'USA: near ' || upper(p_name) || ' ' || p_type AS place, CASE WHEN p_partkey % 4 = 0 THEN printf('%.2f %s %.2f W', p_size / 2.0, CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'S' END, p_size * 1.5) END AS ll, p_size FROM part)"""


def _places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A gazetteer of parts' names and of their second words, and samples near a part, one in four with its position written."""
    part = load(spark, sf, "part")
    full_names = part.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_size").alias("lat"), (-F.max("p_size")).alias("lon"), F.min("p_partkey").alias("k")).where("k % 3 > 0").drop("k")
    seconds = part.select(F.lower(F.split("p_name", " ")[1]).alias("name"), F.lit(1).alias("lat"), F.lit(-1).alias("lon")).distinct()
    written = F.when(F.col("p_partkey") % 4 == 0, F.format_string("%.2f %s %.2f W", F.col("p_size") / 2, F.when(F.col("p_size") % 2 == 0, "N").otherwise("S"), F.col("p_size") * F.lit(1.5).cast("double")))
    samples = part.select(F.col("p_partkey").alias("sample"), F.concat(F.lit("USA: near "), F.upper("p_name"), F.lit(" "), F.col("p_type")).alias("place"), written.alias("lat_lon"))
    return samples, full_names.unionByName(seconds).select("name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


@query(f"""WITH {PLACES}, ht AS (SELECT sample, arg_max(struct_pack(lat := lat, lon := lon), (length(name), name)) AS th FROM sm JOIN pl ON contains(lower(place), name) GROUP BY 1)
SELECT sample, CAST(CASE WHEN ll IS NOT NULL THEN p_size / 2.0 * CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END ELSE th.lat END AS DOUBLE) AS lat, CAST(CASE WHEN ll IS NOT NULL THEN -p_size * 1.5 ELSE th.lon END AS DOUBLE) AS lon FROM sm LEFT JOIN ht USING (sample)""")
def located_samples(spark, sf):  # noqa: ANN001, ANN201
    """Positions that are written, or those of the longest known name in the place."""
    return characterize.located(*_places(spark, sf)).select("sample", "lat", "lon")


@query("""WITH t AS (SELECT page_id, list_filter(['toxin', 'nav', 'the', 'track', 'ouque'], lambda w: contains(lower(html), w)) AS f, page_id % 100 AS c FROM pages)
SELECT page_id, array_to_string(f, ',') AS flags, CASE WHEN len(f) > 1 AND c > 70 THEN 'HIGH' WHEN len(f) > 1 THEN 'MODERATE' WHEN c > 70 THEN 'MONITOR' ELSE 'LOW' END AS tier FROM (SELECT page_id, list_filter(f, lambda w: w <> 'nav') AS f, c FROM t) WHERE len(f) <> 1
UNION ALL SELECT page_id, f[1], CASE WHEN c > 70 THEN 'HIGH' ELSE 'MODERATE' END FROM (SELECT page_id, list_filter(f, lambda w: w <> 'nav') AS f, c FROM t) WHERE len(f) = 1""")
def risk_tiers(spark, sf):  # noqa: ANN001, ANN201
    """Tiers of pages by flag words and a confidence."""
    titled = load(spark, sf, "pages").select("page_id", F.col("html").alias("title"), (F.col("page_id") % 100).alias("confidence"))
    return characterize.risk_tiers(titled, ["toxin", "the", "track", "ouque"]).select("page_id", F.array_join("flags", ",").alias("flags"), "tier")


@query("""SELECT p_partkey, round(avg(v), 6) AS confidence FROM (SELECT l_partkey AS p_partkey, l_quantity + 10 AS v FROM lineitem) GROUP BY 1""")
def structure_confidence(spark, sf):  # noqa: ANN001, ANN201
    """Mean of a fixed-width field of record lines, which are made of line items."""
    line = F.concat(F.rpad(F.lit("ATOM"), 60, " "), F.lpad(F.format_string("%.2f", (F.col("l_quantity") + 10).cast("double")), 6, " "))
    atoms = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), line.alias("line"))
    return characterize.structure_confidence(atoms).select(F.col("name").alias("p_partkey"), F.round("confidence", 6).alias("confidence"))


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, arg_min(event_type, (-n, event_type)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def majority_type(spark, sf):  # noqa: ANN001, ANN201
    return metrics.majority(load(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_type"), ["user_id"], "event_type")


@query("""SELECT s_suppkey, 'SRR' || (100000 + s_suppkey) AS accession, CASE WHEN s_suppkey % 3 = 0 THEN n_name || ', (2026-01-0' || (1 + s_suppkey % 9) || ')' WHEN s_suppkey % 3 = 1 THEN n_name ELSE '(2026-01-0' || (1 + s_suppkey % 9) || ')' END AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def sample_labels(spark, sf):  # noqa: ANN001, ANN201
    """Accessions in file names and labels of place and date, either of which may be missing."""
    rows = load(spark, sf, "supplier").join(F.broadcast(load(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("run/SRR"), (100000 + F.col("s_suppkey")).cast("string"), F.lit("_1.fastq.gz"))
    geo = F.when(F.col("s_suppkey") % 3 < 2, F.concat(F.lit("USA: "), "n_name"))
    date = F.when(F.col("s_suppkey") % 3 != 1, F.concat(F.lit("2026-01-0"), (1 + F.col("s_suppkey") % 9).cast("string")))
    return rows.select("s_suppkey", C.accession(name).alias("accession"), C.place_label(geo, date, F.lit("none")).alias("label"))
