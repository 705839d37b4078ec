"""Report documents, exports, manifests, baselines and alert transports."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def report_rows(scores: DataFrame, found: DataFrame, resistance: DataFrame | None = None, top: int = 5, lineages: DataFrame | None = None) -> DataFrame:
    """A nested row for each sample: score, level, its strongest pathogens (top at most), resistance genera and the priority of the first, and
    species with their context."""
    order = F.struct(-F.col("contribution"), "taxon", F.round("rel", 4).alias("abundance"), "risk_weight", "category")
    by = found.groupBy("sample").agg(F.array_sort(F.collect_list(order.alias("p"))).alias("p"))
    by = by.select("sample", F.transform(F.slice("p", 1, top), lambda p: F.struct(p["taxon"].alias("taxon"), p["abundance"].alias("abundance"), p["risk_weight"].alias("risk_weight"), p["category"].alias("category"))).alias("detected_pathogens"))
    out = scores.withColumn("score", F.round("score", 4)).join(by, "sample", "left")
    if resistance is not None:
        best = F.min_by("priority", F.struct(-F.col("amr_score"), "genus")).alias("amr_priority")
        out = out.join(resistance.groupBy("sample").agg(F.array_sort(F.collect_set("genus")).alias("amr_genera"), best), "sample", "left")
    if lineages is not None:
        out = out.join(lineages.groupBy("sample").agg(F.array_sort(F.collect_set("species")).alias("lineages")), "sample", "left")
    return out


def report_document(rows: DataFrame, metadata: dict) -> DataFrame:
    """One row, `json`: metadata, counts of the levels, and the samples, highest score first."""
    sample = F.struct((-F.col("score")).alias("_order"), *rows.columns)
    body = rows.agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("CRITICAL", "HIGH", "MODERATE", "LOW")], F.array_sort(F.collect_list(sample)).alias("samples"))
    body = body.withColumn("samples", F.transform("samples", lambda s: s.dropFields("_order")))
    return body.select(F.to_json(F.struct(F.from_json(F.lit(json.dumps(metadata, default=str)), "map<string,string>").alias("metadata"), F.struct("CRITICAL", "HIGH", "MODERATE", "LOW").alias("summary"), "samples")).alias("json"))


EXPORT = ("name", "level", "score", "top_pathogen", "top_pathogen_abundance", "amr_genera", "amr_who_priority", "novelty_signal", "community_signal", "cusum_alert", "trend", "trend_tau", "baseline_anomaly", "generated_at")


def csv_rows(report: DataFrame, generated_at: str = "") -> DataFrame:
    """The flat rows of a CSV export (EXPORT): the strongest pathogen, resistance genera joined by '; ', temporal signals; null for what a report lacks."""
    first = F.try_element_at("detected_pathogens", F.lit(1))
    have = lambda name, kind: F.col(name) if name in report.columns else F.lit(None).cast(kind)
    signal = lambda name, kind: F.col(f"temporal.{name}") if "temporal" in report.columns else F.lit(None).cast(kind)
    return report.select(
        F.col("sample").alias("name"), "level", "score", F.coalesce(first["taxon"], F.lit("")).alias("top_pathogen"), F.round(first["abundance"], 4).alias("top_pathogen_abundance"),
        (F.concat_ws("; ", "amr_genera") if "amr_genera" in report.columns else F.lit("")).alias("amr_genera"), have("amr_priority", "string").alias("amr_who_priority"), have("novelty", "double").alias("novelty_signal"), have("community", "double").alias("community_signal"),
        signal("cusum_alert", "boolean").alias("cusum_alert"), signal("trend", "string").alias("trend"), signal("trend_tau", "double").alias("trend_tau"), signal("baseline_anomaly", "boolean").alias("baseline_anomaly"), F.lit(generated_at).alias("generated_at"),
    )


def write_html(report: DataFrame, title: str = "Surveillance report") -> str:
    """A page with a row for each sample; a report has as many as a run's sites."""
    rows = report.select("sample", "score", "level").orderBy(F.desc("score"), "sample").collect()
    cells = "".join(f"<tr><td>{html.escape(r['sample'])}</td><td>{r['score']:.3f}</td><td>{r['level']}</td></tr>" for r in rows)
    return f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th>Sample</th><th>Score</th><th>Level</th></tr>{cells}</table></body></html>"


def canonical_hash(value: dict) -> str:
    """SHA-256 of a document's canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def file_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(filename, path, sha256, bytes) of files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest(spark: SparkSession, paths: str | list[str], config: dict, report: dict) -> dict:
    """Hashes of inputs, configuration and report content."""
    files = [r.asDict() for r in file_hashes(spark, paths).orderBy("filename").collect()]
    joined = hashlib.sha256("".join(f"{f['filename']}:{f['sha256']}\n" for f in files).encode()).hexdigest()
    return {"input_files": files, "input_hash": joined, "config": config, "config_hash": canonical_hash(config), "report_hash": canonical_hash(report)}


def verify(spark: SparkSession, made: dict, report: dict, folder: str | None = None) -> dict[str, bool]:
    """Whether each hashed part is as it was; a file that is gone is looked for by its name in folder."""
    out = {"config": canonical_hash(made["config"]) == made["config_hash"], "report": canonical_hash(report) == made["report_hash"]}
    hpath = spark._jvm.org.apache.hadoop.fs.Path
    for f in made["input_files"]:
        at = next((p for p in (f["path"], f"{folder}/{f['filename']}" if folder else None) if p and hpath(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath(p))), None)
        out[f["filename"]] = bool(at) and file_hashes(spark, at).first()["sha256"] == f["sha256"]
    out["all_passed"] = all(out.values())
    return out


def merge_locations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by site: new values where there are any."""
    cols = [c for c in old.columns if c != "site"]
    n = new.select("site", *[F.col(c).alias(f"_{c}") for c in cols])
    return old.join(n, "site", "full_outer").select("site", *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def metadata_tsv(rows: DataFrame, path: str) -> None:
    """Writes (site, attributes map) as tab-separated text: a column for each attribute that any row has, in order."""
    names = [r["k"] for r in rows.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().orderBy("k").collect()]
    rows.select("site", *[F.coalesce(F.try_element_at("attributes", F.lit(n)), F.lit("")).alias(n) for n in names]).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


class Storage:
    """Bytes by key below a root that Hadoop's file systems can reach. Keys that leave the root are an error."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> object:
        parts = key.split("/")
        if key.startswith("/") or ".." in parts or not key or ":" in key:
            raise ValueError(f"key leaves the root: {key}")
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def _system(self, path: object) -> object:
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put_bytes(self, key: str, data: bytes) -> str:
        path = self._path(key)
        out = self._system(path).create(path, True)
        out.write(bytearray(data))
        out.close()
        return path.toString()

    def get_bytes(self, key: str) -> bytes:
        path = self._path(key)
        stream = self._system(path).open(path)
        data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        return data

    def exists(self, key: str) -> bool:
        path = self._path(key)
        return bool(self._system(path).exists(path))

    def point(self, name: str, key: str) -> str:
        """Lets `name` say which key is the latest."""
        return self.put_bytes(name, key.encode())

    def latest(self, name: str) -> bytes | None:
        """What `name` points to."""
        return self.get_bytes(self.get_bytes(name).decode()) if self.exists(name) else None


def mail_message(rows: list[dict], sender: str, to: list[str], run_date: str = "") -> object:
    """A mail about alerts, as text and as a page."""
    from email.message import EmailMessage

    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = f"{len(rows)} site(s) flagged" + (f", run of {run_date}" if run_date else ""), sender, ", ".join(to)
    message.set_content("\n".join(f"{r['sample']}: {r['level']} ({r['score']:.3f}) {'; '.join(r['reasons'])}" for r in rows))
    cells = "".join(f"<tr><td>{html.escape(r['sample'])}</td><td>{r['level']}</td><td>{r['score']:.3f}</td><td>{html.escape('; '.join(r['reasons']))}</td></tr>" for r in rows)
    message.add_alternative(f"<table>{cells}</table>", subtype="html")
    return message


def mail_channel(host: str, port: int, user: str, password: str, sender: str, to: list[str], run_date: str = "") -> Callable[[list[dict]], bool]:
    """Sends a mail through a server; without recipients nothing is sent."""

    def send(rows: list[dict]) -> bool:
        import smtplib

        if not to:
            return False
        with smtplib.SMTP(host, port) as server:
            server.starttls()
            if user:
                server.login(user, password)
            server.send_message(mail_message(rows, sender, to, run_date))
        return True

    return send


def hook_body(rows: list[dict], run_date: str = "") -> dict:
    """Blocks of a chat message about alerts."""
    head = f"{len(rows)} site(s) flagged" + (f", run of {run_date}" if run_date else "")
    return {"blocks": [{"type": "header", "text": {"type": "plain_text", "text": head}}, {"type": "divider"}, *({"type": "section", "text": {"type": "mrkdwn", "text": f"*{r['sample']}* {r['level']} {r['score']:.3f}: {'; '.join(r['reasons'])}"}} for r in rows)]}


def hook_channel(url: str, run_date: str = "") -> Callable[[list[dict]], bool]:
    """Posts the blocks to a web hook; without one nothing is sent."""

    def send(rows: list[dict]) -> bool:
        import urllib.request

        if not url:
            return False
        request = urllib.request.Request(url, json.dumps(hook_body(rows, run_date)).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=10) as answer:
            return answer.status == 200

    return send


def channels_of(sections: dict[str, dict], run_date: str = "") -> dict[str, Callable[[list[dict]], bool]]:
    """The channels of a settings file's sections: `email` (smtp_host, smtp_port, user, sender, recipients) and `slack` (webhook_url). Secrets may be named by
    the environment variables that hold them (password_env, webhook_env)."""
    import os

    out = {}
    if "email" in sections:
        own = sections["email"]
        to = own.get("recipients") or own.get("to") or []
        password = os.environ.get(own.get("password_env", ""), own.get("password", ""))
        out["email"] = mail_channel(own.get("smtp_host", ""), int(own.get("smtp_port", 587)), own.get("user", ""), password, own.get("sender", own.get("user", "")), [to] if isinstance(to, str) else list(to), run_date)
    if "slack" in sections:
        own = sections["slack"]
        out["slack"] = hook_channel(os.environ.get(own.get("webhook_env", ""), own.get("webhook_url", "")), run_date)
    return out


def dispatch(alerts: DataFrame, channels: dict[str, Callable[[list[dict]], bool]]) -> dict[str, bool]:
    """Sends alerts (one row for each sample that a rule fired for) through each channel; nothing for none. A channel that fails is False and
    does not keep the others from being used."""
    rows = [r.asDict(recursive=True) for r in alerts.collect()]
    out = {}
    for name, send in channels.items() if rows else ():
        try:
            out[name] = bool(send(rows))
        except OSError:
            out[name] = False
    return out
