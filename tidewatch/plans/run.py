"""The whole analysis of a cohort: counts and reads to scores, temporal signals, annotations, report and alerts; and its record."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import abundance, baseline, cluster, graph, novelty, planning, scoring, series, stats, temporal
from tidewatch.operators.history import History
from tidewatch.operators.tables import cut
from tidewatch.sinks import outputs
from tidewatch.sources import dims

# Keys of a settings file by section, where they differ from the field's name.
SECTIONS = {("graph", "spearman_threshold"): "rho_threshold", ("graph", "fdr_alpha"): "alpha", ("sbm", "n_init"): "starts", ("risk", "alert_threshold"): "min_score", ("reporting", "output_dir"): "output_dir"}


@dataclass
class Config:
    rank: str = "G"
    min_prevalence: float = 0.1
    min_total_reads: float = 50
    rank_bump: bool = False
    rho_threshold: float = 0.45
    alpha: float = 0.05
    max_k: int = 12
    starts: int = 10
    scorer: str = "relative"
    space: str = "relative"
    trees: int = 200
    outbreak_distance: float = 0.3
    with_network: bool = True
    temporal_window: int = 8
    cusum_k: float = 0.5
    cusum_h: float = 4.0
    min_score: float = 0.6
    run_date: str | None = None
    output_dir: str = "./reports"
    alert_email: bool = False
    alert_slack: bool = False
    channels: dict = field(default_factory=dict)  # of each channel, what its section of the settings says

    @property
    def alert_channels(self) -> dict:
        """The sections of the channels that are on."""
        return {name: self.channels.get(name, {}) for name, on in (("email", self.alert_email), ("slack", self.alert_slack)) if on}


    @classmethod
    def of(cls, values: dict) -> Config:
        """From nested or flat keys of a configuration file; unknown keys are an error."""
        flat: dict = {}
        for name, v in values.items():
            if name == "alerting":
                flat |= {f"alert_{channel}": bool((v.get(channel) or {}).get("enabled")) for channel in ("email", "slack")} | {"channels": {c: dict(x or {}) for c, x in v.items()}}
            elif isinstance(v, dict):
                flat |= {SECTIONS.get((name, k), k): x for k, x in v.items()}
            else:
                flat[name] = v
        unknown = set(flat) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**flat)

    @classmethod
    def read(cls, path: str) -> Config:
        """From a YAML or JSON file."""
        with open(path) as f:
            text = f.read()
        try:
            import yaml
        except ImportError:
            return cls.of(json.loads(text))
        return cls.of(yaml.safe_load(text) or {})


def analyse(spark: SparkSession, counts: DataFrame, config: Config | None = None, history: History | None = None, controls: DataFrame | None = None, prior: DataFrame | None = None, frozen: DataFrame | None = None, reads: DataFrame | None = None, external: DataFrame | None = None, species: DataFrame | None = None) -> dict[str, DataFrame | str]:
    """Scores, detections, network, communities, clusters and what differs between them, outbreaks, annotations, temporal signals, report
    rows and alerts of counts (sample, taxon, reads). Each is a DataFrame; what several of them need is written once. A sample's name is its site in the history.

    frozen: a saved baseline, which comes before controls, history and the prior. reads: k-mer novelty of samples joins the cohort's by the
    larger. external: an outside signal (site, t as a date, value). species: the same reports at species rank, not filtered, from which lineages
    are told; without it, names among the counts that are species."""
    config = config or Config()
    curves = planning.rarefaction(counts).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("depth", F.round("richness", 4).alias("richness")))).alias("points"))
    kept = cut(abundance.filter_taxa(counts, config.min_prevalence, config.min_total_reads, config.rank_bump))
    rel = cut(abundance.normalized(kept))
    full = cut(abundance.normalized(abundance.dense(kept)))
    ratio = abundance.clr(full)
    pathogens, tripwires = dims.pathogens(spark), dims.tripwires(spark)
    out: dict[str, DataFrame | str] = {"config": str(asdict(config)), "rel": rel, "curves": curves}
    signals = novelty.cohort_novelty(ratio, trees=config.trees)
    if reads is not None:
        signals = novelty.fused_novelty(signals, novelty.kmer_novelty(novelty.kmer_profiles(reads)))
    if config.with_network:
        edges = cut(stats.cooccurrence(ratio, config.rho_threshold, config.alpha))
        members = cut(graph.communities(edges, config.max_k, config.starts))
        flagged = scoring.pathogen_communities(members, pathogens)
        signals = signals.join(scoring.community_signal(rel, members, flagged), "sample", "left")
        out |= {"edges": edges, "communities": members}
    out["signals"] = signals = cut(signals)
    if config.scorer == "relative":
        past = history.abundance_columns(2 * config.temporal_window, rel.select(F.col("sample").alias("site"))) if history else None
        past = cut(past) if past is not None else None
        known = (past if past is not None else rel).select("taxon").distinct().join(F.broadcast(pathogens), abundance.genus("taxon") == F.col("genus")).select("taxon")
        tier, base = ("frozen", frozen) if frozen is not None else baseline.resolve(rel, controls, past, prior, known, space=config.space)
        space = baseline.space_of(base, config.space)  # a saved baseline and a prior have their own
        base = cut(base)
        values = baseline.sample_log_ratios(rel, base) if space == "clr" else rel
        out |= {"baseline_tier": tier, "baseline": base, "space": space, "scores": scoring.score_relative(values, base, pathogens, tripwires, signals, space, "clr" if space == "clr" else "rel")}
    else:
        absolute = scoring.score_absolute(rel, pathogens, signals)
        again = baseline.recalibrated(absolute)
        out["scores"] = again.withColumn("level", scoring.risk_level(F.col("score")))
    scores = cut(out["scores"])
    out["scores"] = scores.orderBy(F.desc("score"), "sample")
    found = cut(scoring.detected(rel, pathogens))
    distances = stats.bray_curtis(full)
    alarming = scores.where(F.col("level").isin("HIGH", "CRITICAL")).select("sample")
    clusters = cut(cluster.ward_clusters(ratio))
    out |= {
        "detected": found,
        "resistance": scoring.annotate_resistance(found, dims.resistance(spark)).orderBy("sample", F.desc("amr_score"), "genus"),
        "lineages": scoring.annotate_lineages(rel if species is None else abundance.normalized(species), dims.lineages(spark)).orderBy("sample", F.desc("weight"), "species"),
        "clusters": clusters,
        "differential": stats.kruskal(full, clusters.select("sample", "label"), alpha=config.alpha).orderBy("p_adj", "taxon"),
        "outbreaks": cluster.outbreak_clusters(distances, alarming, config.outbreak_distance),
    }
    reported = scores.join(signals.drop(*[c for c in signals.columns if c != "sample" and c in scores.columns]), "sample", "left")
    if history:
        now = scores.select(F.col("sample").alias("site"), F.struct(F.to_date(F.lit(config.run_date or dt.date.today().isoformat())).alias("run_date"), F.current_timestamp().alias("run_ts"), F.lit((1 << 63) - 1).cast("long").alias("run_id")).alias("t"), F.col("score").alias("x"))
        line = cut(history.series(last=2 * config.temporal_window).unionByName(now))
        out["temporal"] = cut(temporal.temporal_signals(line, config.temporal_window, config.cusum_k, config.cusum_h).join(now.select("site"), "site", "left_semi"))
        out |= {"rolling": series.latest(series.rolling_baseline(line, config.temporal_window)), "cusum": series.latest(series.cusum(line, config.cusum_k, config.cusum_h)), "trends": series.trends(line)}
        if external is not None:
            out["external"] = series.validate_external(line.select("site", F.col("t.run_date").alias("t"), "x"), external)
    out["report"] = cut(temporal.with_temporal(outputs.report_rows(reported, found, out["resistance"], lineages=out["lineages"]), out.get("temporal"))).orderBy(F.desc("score"), "sample")
    flat = out["report"].select("sample", "level", "score", *([F.col("novelty")] if "novelty" in reported.columns else [F.lit(0.0).alias("novelty")]), F.lit(False).alias("cusum_alert"), F.lit(0.0).alias("z_score"))
    fired = scoring.alerts(flat, min_score=config.min_score)
    out["alerts"] = temporal.merged_alerts(fired, scores, out["temporal"]) if history else fired.select("sample", "level", "score", "reasons")
    return out


def documents(out: dict) -> DataFrame:
    """(kind, site, body) of what a run leaves to be looked up: samples of the report, edges, communities, clusters, outbreaks and rarefaction curves."""
    body = lambda df: F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    parts = [out["report"].select(F.lit("sample").alias("kind"), F.col("sample").alias("site"), body(out["report"]).alias("body"))]
    for kind, name, site in (("edge", "edges", "a"), ("community", "communities", "taxon"), ("cluster", "clusters", "sample"), ("outbreak", "outbreaks", "cluster"), ("curve", "curves", "sample")):
        if name in out:
            df = out[name]
            parts.append(df.select(F.lit(kind).alias("kind"), F.col(site).cast("string").alias("site"), body(df).alias("body")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def record(spark: SparkSession, out: dict, history: History, config: Config, paths: list[str], document: dict, notes: str = "") -> tuple[int, dict]:
    """Writes a run's scores and abundances to the history, and returns its id and manifest: hashes of the inputs, the settings and the report."""
    made = outputs.manifest(spark, paths, asdict(config), document)
    found = out["report"].select("sample", F.try_element_at("detected_pathogens", F.lit(1)).alias("top"))
    scores = out["scores"].join(found, "sample", "left").join(out["signals"].select("sample", *[F.col(c).alias(f"{c}_signal") for c in ("novelty", "community") if c in out["signals"].columns]), "sample", "left")
    rows = scores.select(F.col("sample").alias("site"), F.col("score").alias("risk_score"), F.col("level").alias("risk_level"), F.col("top.taxon").alias("top_pathogen"), F.col("top.abundance").alias("top_pathogen_abund"), *[c for c in ("abundance_score", "novelty_signal", "community_signal") if c in scores.columns])
    run = {"run_date": dt.date.fromisoformat(config.run_date) if config.run_date else dt.date.today(), "run_ts": dt.datetime.now(dt.UTC).replace(tzinfo=None), "input_path": ",".join(paths), "notes": notes, "engine_version": "1", "input_hash": made["input_hash"], "config_hash": made["config_hash"]}
    return history.record(run, rows, out["rel"].select(F.col("sample").alias("site"), "taxon", F.col("rel").alias("rel_abund")), documents(out)), made


def replay(spark: SparkSession, points: list[tuple[str, str, str]], history: History, config: Config | None = None) -> DataFrame:
    """Runs (site, date, path of a report) one after the other as they were dated, each recorded with the history before it; a path that is
    not there is skipped. Returns (site, date, path, run_id), run_id null where it was skipped."""
    from dataclasses import replace

    from tidewatch.sources.reports import reports

    hpath = spark._jvm.org.apache.hadoop.fs.Path
    done = []
    for site, date, path in sorted(points, key=lambda p: (p[1], p[0], p[2])):
        run_id = None
        if hpath(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath(path)):
            own = replace(config or Config(with_network=False), run_date=date, min_prevalence=0.0)
            counts = reports(spark, path, own.rank).withColumn("sample", F.lit(site))
            species = reports(spark, path, "S").withColumn("sample", F.lit(site))
            out = analyse(spark, counts, own, history, species=species)
            run_id, _ = record(spark, out, history, own, [path], {"site": site, "date": date})
        done.append((site, date, path, run_id))
    return spark.createDataFrame(done, "site string, date string, path string, run_id long")
