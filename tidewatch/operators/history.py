"""History of runs in Parquet tables: runs, scores and abundances by organisation and month, documents by run and kind."""

from __future__ import annotations

import secrets
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMAS = {
    "runs": "org_id string, run_id bigint, run_date date, run_ts timestamp, input_path string, notes string, engine_version string, input_hash string, config_hash string",
    "scores": "org_id string, run_id bigint, site string, risk_score double, risk_level string, abundance_score double, community_signal double, novelty_signal double, top_pathogen string, top_pathogen_abund double",
    "abundances": "org_id string, run_id bigint, site string, taxon string, rel_abund double",
}


class History:
    """Tables under a root that Spark can write. Every query is about one organisation. A run's row in `runs` is
    written last and commits it: scores and abundances of runs without one are not seen."""

    def __init__(self, spark: SparkSession, root: str, org_id: str = "_selfhosted") -> None:
        self.spark, self.root, self.org = spark, root.rstrip("/"), org_id

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("org_id") == self.org)

    def table(self, name: str, months: list[str] | None = None) -> DataFrame:
        """Rows of the organisation; columns that older files lack are null. Scores and abundances are partitioned by the month of their run;
        months: only these partitions are read. Rows of histories that were written without months have month null and are read in any case."""
        if name == "runs":
            return self._read("runs", SCHEMAS["runs"])
        rows = self._read(f"{name}_by_month", f"{SCHEMAS[name]}, month string")
        if months is not None:
            rows = rows.where(F.col("month").isin(months))
        if self._there(name):
            rows = rows.unionByName(self._read(name, SCHEMAS[name]), allowMissingColumns=True)
        return rows.join(self.table("runs").select("run_id"), "run_id", "left_semi")

    def record(self, run: dict, scores: DataFrame, abundances: DataFrame, documents: DataFrame | None = None) -> int:
        """Appends a run (a row of `runs` without its id) and returns its id: the time in microseconds and twelve random bits, so that
        two writers at once do not share one and later runs have larger ones. documents (kind, site, body as JSON) are kept as VARIANT."""
        run_id = (time.time_ns() // 1000 << 12) + secrets.randbelow(1 << 12)
        for name, rows in (("scores", scores), ("abundances", abundances.where("rel_abund > 0"))):
            own = {"org_id": F.lit(self.org), "run_id": F.lit(run_id).cast("long"), "month": F.lit(f"{run['run_date']:%Y-%m}")}
            self._append(f"{name}_by_month", rows.withColumns(own), f"{SCHEMAS[name]}, month string", ["org_id", "month"])
        if documents is not None:
            own = documents.select(F.lit(self.org).alias("org_id"), F.lit(run_id).cast("long").alias("run_id"), "kind", "site", F.parse_json("body").alias("body"))
            own.repartitionByRange("kind", "site").sortWithinPartitions("kind", "site").write.mode("append").partitionBy("org_id", "run_id", "kind").parquet(f"{self.root}/documents")
        self._append("runs", self.spark.createDataFrame([run | {"run_id": run_id, "org_id": self.org}], SCHEMAS["runs"]), SCHEMAS["runs"], ["org_id"])
        return run_id

    def _append(self, name: str, rows: DataFrame, schema: str, by: list[str]) -> None:
        shape = self.spark.createDataFrame([], schema).schema
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.root}/{name}")

    def newest(self, n: int) -> list[tuple[int, str]]:
        """(run_id, month) of the n newest runs, newest first: n rows at most."""
        rows = self.table("runs").orderBy(F.desc("run_date"), F.desc("run_ts"), F.desc("run_id")).limit(n).select("run_id", F.date_format("run_date", "yyyy-MM").alias("month"))
        return [(r["run_id"], r["month"]) for r in rows.collect()]

    def documents(self, kind: str, site: str | None = None, run_id: int | None = None) -> DataFrame:
        """(run_id, site, body) of a run's documents of a kind (the newest run, if none is given): one partition, in which files are sorted by site."""
        if run_id is None:
            run_id = next((r for r, _ in self.newest(1)), -1)
        rows = self._read("documents", "site string, body variant, org_id string, run_id bigint, kind string").where((F.col("run_id") == run_id) & (F.col("kind") == kind))
        return (rows if site is None else rows.where(F.col("site") == site)).select("run_id", "site", "body")

    def lookup(self, kind: str, paths: dict[str, tuple[str, str]], site: str | None = None, run_id: int | None = None) -> DataFrame:
        """(site, ...) values of documents at paths {column: (path, type)}, null where a document has none."""
        return self.documents(kind, site, run_id).select("site", *[F.try_variant_get("body", path, kind_).alias(c) for c, (path, kind_) in paths.items()])

    def pathogens(self, site: str, run_id: int | None = None) -> DataFrame:
        """A site's strongest pathogens of a run, a row each, strongest first."""
        found = self.lookup("sample", {"p": ("$.detected_pathogens", "array<struct<taxon:string,abundance:double,risk_weight:double,category:string>>")}, site, run_id)
        return found.select("site", F.posexplode("p").alias("place", "p")).select("site", "place", "p.*")

    def cusum(self, site: str, run_id: int | None = None) -> DataFrame:
        """A site's temporal signals as of a run."""
        fields = {"cusum": "double", "cusum_alert": "boolean", "cusum_signal": "string", "z_score": "double", "trend": "string", "farrington_alarm": "boolean"}
        return self.lookup("sample", {c: (f"$.temporal.{c}", t) for c, t in fields.items()}, site, run_id)

    def resistance(self, site: str, run_id: int | None = None) -> DataFrame:
        """A site's genera with resistances, a row each, and the priority of the first."""
        found = self.lookup("sample", {"g": ("$.amr_genera", "array<string>"), "amr_priority": ("$.amr_priority", "string")}, site, run_id)
        return found.select("site", F.explode("g").alias("genus"), "amr_priority")

    def network(self, run_id: int | None = None) -> DataFrame:
        """The edges of a run's network."""
        return self.lookup("edge", {"a": ("$.a", "string"), "b": ("$.b", "string"), "rho": ("$.rho", "double"), "p_adj": ("$.p_adj", "double")}, None, run_id).drop("site")

    def members(self, kind: str, run_id: int | None = None) -> DataFrame:
        """(site, label): taxa of communities, or samples of clusters."""
        return self.lookup(kind, {"label": ("$.label", "int")}, None, run_id)

    def outbreaks(self, run_id: int | None = None) -> DataFrame:
        """The outbreak clusters of a run, those with an alarm first."""
        fields = {"samples": ("$.samples", "array<string>"), "size": ("$.size", "bigint"), "contains_flagged": ("$.contains_flagged", "boolean"), "max_distance": ("$.max_distance", "double")}
        return self.lookup("outbreak", fields, None, run_id).withColumnRenamed("site", "cluster").orderBy(F.desc("contains_flagged"), F.desc("size"), "cluster")

    def curve(self, site: str, run_id: int | None = None) -> DataFrame:
        """A site's rarefaction curve."""
        return self.lookup("curve", {"points": ("$.points", "array<struct<depth:bigint,richness:double>>")}, site, run_id).select("site", F.inline("points"))

    def series(self, value: str = "risk_score", site: str | None = None, last: int = 52, oldest: bool = False) -> DataFrame:
        """(site, t, x), ordered by date and then time of the run: each site's newest `last` points (or its oldest)."""
        rows = self.table("scores").join(self.table("runs"), "run_id").select("site", F.struct("run_date", "run_ts", "run_id").alias("t"), F.col(value).alias("x"))
        rows = rows if site is None else rows.where(F.col("site") == site)
        place = F.row_number().over(W.partitionBy("site").orderBy("t" if oldest else F.desc("t")))
        return rows.withColumn("place", place).where(F.col("place") <= last).drop("place")

    def taxon_series(self, taxon: str, last: int = 52) -> DataFrame:
        rows = self.table("abundances").where(F.col("taxon") == taxon).join(self.table("runs"), "run_id").select("site", F.struct("run_date", "run_ts", "run_id").alias("t"), F.col("rel_abund").alias("x"))
        return rows.withColumn("place", F.row_number().over(W.partitionBy("site").orderBy(F.desc("t")))).where(F.col("place") <= last).drop("place")

    def abundance_columns(self, last_runs: int = 26, sites: DataFrame | list[str] | None = None) -> DataFrame:
        """(sample, taxon, rel) of the newest runs, a sample for each run and site, of all sites or those given (a list, or a table with `site`). A taxon that a
        sample has no row for has a zero there."""
        newest = self.newest(last_runs)
        rows = self.table("abundances", sorted({m for _, m in newest})).where(F.col("run_id").isin([r for r, _ in newest]))
        if isinstance(sites, list):
            rows = rows.where(F.col("site").isin(sites))
        elif sites is not None:
            rows = rows.join(sites.select("site").distinct(), "site", "left_semi")
        return rows.groupBy(F.concat_ws("::", F.col("run_id").cast("string"), "site").alias("sample"), "taxon").agg(F.avg("rel_abund").alias("rel"))

    def sites(self) -> DataFrame:
        return self.table("scores").select("site").distinct().orderBy("site")

    def run_count(self) -> int:
        return self.table("runs").count()
