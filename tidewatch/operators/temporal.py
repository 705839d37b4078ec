"""Temporal signals of current scores against a site's history, their place in the report, and what they add to the alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import series

ABSENT = {"z_score": "double", "pct_above_baseline": "double", "baseline_anomaly": "boolean", "cusum": "double", "cusum_alert": "boolean", "cusum_signal": "string", "farrington_expected": "double", "farrington_threshold": "double", "farrington_exceedance": "double", "farrington_alarm": "boolean", "trend": "string", "trend_tau": "double", "forecast_next": "double", "trend_summary": "string"}


def temporal_signals(line: DataFrame, window: int = 8, k: float = 0.5, h: float = 4.0, z_threshold: float = 2.0, alpha: float = 0.05, scale: float = 100.0, min_history: int = 4) -> DataFrame:
    """A row for each site of line (site, t, x), about its last point: its place in the rolling baseline, CUSUM, Farrington aberration and
    trend, and `flags`, the signals that are on: baseline, cusum, farrington, trend (a significant rise).

    The baseline has `window` points before the last, the other signals twice as many."""
    short = series.last_points(line, 2 * window + 1)
    base = series.latest(series.rolling_baseline(short, window, z_threshold)).select("site", F.round("z_score", 3).alias("z_score"), "pct_above_baseline", F.col("is_anomaly").alias("baseline_anomaly"))
    sums = series.latest(series.cusum(short, k, h)).select("site", F.round("cusum_upper", 3).alias("cusum"), F.col("alert").alias("cusum_alert"), F.col("strength").alias("cusum_signal"))
    odd = series.latest(series.aberrations(short, 2 * window, scale, alpha, min_history)).select("site", *[F.col(c).alias(f"farrington_{c}") for c in ("expected", "threshold", "exceedance")], F.col("alarm").alias("farrington_alarm"))
    trend = series.trends(short).select("site", "trend", F.round("tau", 3).alias("trend_tau"), "forecast_next", F.col("summary").alias("trend_summary"), "is_significant")
    out = base.join(sums, "site").join(odd, "site").join(trend, "site")
    on = {"baseline": F.col("baseline_anomaly"), "cusum": F.col("cusum_alert"), "farrington": F.col("farrington_alarm"), "trend": (F.col("trend") == "increasing") & F.col("is_significant")}
    flags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in on.items()]))
    return out.withColumn("flags", flags).drop("is_significant")


def with_temporal(report: DataFrame, signals: DataFrame | None) -> DataFrame:
    """report rows (sample, ...) with a struct `temporal`; its fields are null where a sample has no signals, or there are none at all."""
    fields = list(ABSENT)
    if signals is None:
        return report.withColumn("temporal", F.struct(*[F.lit(None).cast(t).alias(c) for c, t in ABSENT.items()]))
    own = signals.select(F.col("site").alias("sample"), F.struct(*fields).alias("_temporal"))
    out = report.join(own, "sample", "left")
    return out.withColumn("temporal", F.struct(*[F.col(f"_temporal.{c}").alias(c) for c in fields])).drop("_temporal")


def merged_alerts(alerts: DataFrame, scores: DataFrame, signals: DataFrame) -> DataFrame:
    """alerts (sample, level, score, reasons) and, once each, the samples that only a temporal flag speaks for."""
    flagged = signals.where(F.size("flags") > 0).select(F.col("site").alias("sample"), F.transform("flags", lambda f: F.concat(F.lit("temporal "), f)).alias("reasons"))
    more = scores.select("sample", "level", "score").join(flagged, "sample").join(alerts.select("sample"), "sample", "left_anti")
    return alerts.select("sample", "level", "score", "reasons").unionByName(more)


def chronological(scores: DataFrame, dates: DataFrame, site: str = "site", k: float = 0.5, h: float = 4.0) -> DataFrame:
    """scores (sample, score, level, ...) in order of their samples' dates (sample, date), recalibrated scores of one site: run_index from 0, date and
    each one's CUSUM over the series with its alert."""
    dated = scores.join(dates.select("sample", "date"), "sample").withColumn("t", F.struct("date", "sample"))
    line = series.cusum(dated.select(F.lit(site).alias("site"), "t", F.col("score").alias("x")), k, h)
    place = F.row_number().over(series.W.partitionBy("site").orderBy("t")) - 1
    return dated.join(line.select("t", "site", place.alias("run_index"), F.col("cusum_upper").alias("cusum"), F.col("alert").alias("cusum_alert")), "t").drop("t")
