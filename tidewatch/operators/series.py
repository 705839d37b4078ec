"""Series of a site: rolling baseline, CUSUM, trend, forecast, aberration; all sites at once, windowed by site.

A series is (site, t, x): t orders a site's points and is unique in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.special import normal_pvalue, normal_quantile
from tidewatch.operators.kendall import trend_statistics


def last_points(series: DataFrame, n: int = 52, oldest: bool = False) -> DataFrame:
    """The newest n points of each site (or its oldest n)."""
    order = W.partitionBy("site").orderBy("t" if oldest else F.desc("t"))
    return series.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def rolling_baseline(series: DataFrame, window: int = 8, z_threshold: float = 2.0) -> DataFrame:
    """series with baseline_mean, baseline_std, z_score, pct_above_baseline, n_history, is_anomaly from the points before.

    Fewer than two points before: the point is its own baseline, z is 0.
    """
    before = W.partitionBy("site").orderBy("t").rowsBetween(-window, -1)
    out = series.withColumns({"n_history": F.count("x").over(before), "m": F.avg("x").over(before), "s": F.stddev_samp("x").over(before)})
    few = F.col("n_history") < 2
    z = F.when(few, 0.0).otherwise((F.col("x") - F.col("m")) / (F.col("s") + 1e-10))
    mean = F.when(few, F.col("x")).otherwise(F.col("m"))
    pct = F.when(few, 0.0).otherwise((F.col("x") - F.col("m")) / (F.col("m") + 1e-10) * 100)
    return out.select("site", "t", "x", "n_history", mean.alias("baseline_mean"), F.when(few, 0.0).otherwise(F.col("s")).alias("baseline_std"), z.alias("z_score"), pct.alias("pct_above_baseline"), (z >= z_threshold).alias("is_anomaly"))


def cusum(series: DataFrame, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """series with cusum_upper, cusum_lower, alert, alert_decrease, streak (points in a row above 0) and strength.

    The first half of a site's points (two at least) is its baseline. The recursion max(0, C + z - k) is the running sum of
    z - k less its running minimum, so two windows compute it. Sites with fewer than three points stay at 0.
    """
    site = W.partitionBy("site")
    order = site.orderBy("t")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = series.withColumns({"n": F.count("x").over(site), "i": F.row_number().over(order)})
    base = F.when(F.col("i") <= F.greatest(F.lit(2), F.floor(F.col("n") / 2)), F.col("x"))
    rows = rows.withColumns({"m": F.avg(base).over(site), "s": F.stddev_samp(base).over(site)})
    z = (F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    rows = rows.withColumn("z", F.when(F.col("n") < 3, 0.0).otherwise(z))
    rows = rows.withColumns({"up": F.sum(F.col("z") - k).over(so_far), "down": F.sum(-F.col("z") - k).over(so_far)})
    level = lambda c: F.when(F.col("n") < 3, 0.0).otherwise(F.col(c) - F.least(F.lit(0.0), F.min(c).over(so_far)))
    rows = rows.withColumns({"cusum_upper": level("up"), "cusum_lower": level("down")})
    streak = F.col("i") - F.coalesce(F.max(F.when(F.col("cusum_upper") <= 0, F.col("i"))).over(so_far), F.lit(0))
    strength = F.when(F.col("cusum_upper") < 0.5 * h, "none").when(F.col("cusum_upper") < h, "weak").when(F.col("cusum_upper") < 2 * h, "moderate").otherwise("strong")
    return rows.select("site", "t", "x", "cusum_upper", "cusum_lower", (F.col("cusum_upper") > h).alias("alert"), (F.col("cusum_lower") > h).alias("alert_decrease"), streak.cast("int").alias("streak"), strength.alias("strength"))


def latest(points: DataFrame) -> DataFrame:
    """The last row of each site."""
    return points.withColumn("place", F.row_number().over(W.partitionBy("site").orderBy(F.desc("t")))).where("place = 1").drop("place")


def mann_kendall(series: DataFrame) -> DataFrame:
    """(site, n, s, tau, slope, p_value): Kendall's trend without tie correction, and the median of pairwise slopes.

    Slopes are per step. Points without x are left out; with fewer than four points all but n is 0 (p_value 1)."""
    few = F.col("n") < 4
    var = F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18
    z = F.when(F.col("s") > 0, F.col("s") - 1).when(F.col("s") < 0, F.col("s") + 1).otherwise(0.0) / F.sqrt(var)
    out = trend_statistics(series).withColumn("z", F.when(few, 0.0).otherwise(z))
    return out.select("site", "n", F.when(few, 0.0).otherwise(F.col("s")).alias("s"), F.when(few, 0.0).otherwise(F.col("s") / (F.col("n") * (F.col("n") - 1) / 2)).alias("tau"), F.when(few, 0.0).otherwise(F.col("slope")).alias("slope"), normal_pvalue("z").alias("p_value"))


def holt_forecast(series: DataFrame, alpha: float = 0.3, beta: float = 0.1, steps: int = 1) -> DataFrame:
    """(site, n, forecast_next, ci_low, ci_high): double exponential smoothing, folded over a site's ordered points."""
    rows = series.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda p: p["x"]).alias("xs"))
    start = F.struct(F.element_at("xs", 1).alias("level"), (F.try_element_at("xs", F.lit(2)) - F.element_at("xs", 1)).alias("trend"), F.array().cast("array<double>").alias("res"))

    def step(acc, x):  # noqa: ANN001, ANN202
        level = alpha * x + (1 - alpha) * (acc["level"] + acc["trend"])
        trend = beta * (level - acc["level"]) + (1 - beta) * acc["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"), F.array_append(acc["res"], x - (acc["level"] + trend)).alias("res"))

    n = F.size("xs")
    out = rows.select("site", n.alias("n"), F.element_at("xs", -1).alias("last"), F.when(n >= 2, F.aggregate(F.slice("xs", F.lit(2), F.greatest(n - 1, F.lit(1))), start, step)).alias("a"))
    clipped = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("f", clipped(F.coalesce(F.col("a.level") + steps * F.col("a.trend"), F.col("last"))))
    mean = F.aggregate("a.res", F.lit(0.0), lambda s, x: s + x) / F.size("a.res")
    std = F.sqrt(F.aggregate("a.res", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size("a.res"))
    half = F.when(F.col("a").isNull(), 0.1).otherwise(1.281551565545 * std * float(np.sqrt(steps)))
    return out.select("site", F.col("n").cast("long").alias("n"), F.col("f").alias("forecast_next"), clipped(F.col("f") - half).alias("ci_low"), clipped(F.col("f") + half).alias("ci_high"))


def trends(series: DataFrame, alpha: float = 0.05, tau_threshold: float = 0.3, goal: float = 0.6) -> DataFrame:
    """Trend, forecast and a sentence for each site; with fewer than three points `insufficient`."""
    out = mann_kendall(series).join(holt_forecast(series).drop("n"), "site").join(latest(series).select("site", F.col("x").alias("current")), "site")
    clear = F.col("p_value") < alpha
    kind = F.when(F.col("n") < 3, "insufficient").when(clear & (F.col("tau") >= tau_threshold), "increasing").when(clear & (F.col("tau") <= -tau_threshold), "decreasing").otherwise("stable")
    weeks = F.when(F.col("slope") > 0, ((goal - F.col("current")) / F.col("slope")).cast("int"))
    out = out.withColumns({"trend": kind, "weeks": F.when((weeks > 0) & (weeks < 12), weeks)})
    text = F.when(F.col("trend") == "insufficient", "too few points").otherwise(F.concat("trend", F.format_string(" (tau %.2f, p %.3f)", "tau", "p_value"), F.coalesce(F.format_string(", high in about %d weeks", "weeks"), F.lit(""))))
    wide = F.col("n") < 3
    return out.select("site", "n", "trend", F.round("tau", 4).alias("tau"), F.round("p_value", 4).alias("p_value"), F.round("slope", 5).alias("sens_slope"), (kind != "insufficient").alias("enough"), (clear & (F.abs("tau") >= tau_threshold) & ~wide).alias("is_significant"), F.round("forecast_next", 4).alias("forecast_next"), F.round(F.when(wide, 0.0).otherwise(F.col("ci_low")), 4).alias("ci_low"), F.round(F.when(wide, 1.0).otherwise(F.col("ci_high")), 4).alias("ci_high"), text.alias("summary"))


RESULTS = ("expected", "threshold", "dispersion", "trend_slope", "z", "exceedance", "alarm", "note")


def _trend_fits(y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-linear Poisson trends of the rows of y with weights w, by reweighted least squares: level and slope, their variance at
    the next step, fitted means, and which rows settled. The normal equations are 2 x 2, so all rows are solved at once."""
    n = y.shape[1]
    t = np.arange(n, dtype=float)
    mu = np.where((y == 0).any(1, keepdims=True), np.maximum(y, 0.5), y)
    eta = np.log(mu)
    level, slope, open_ = np.zeros(len(y)), np.zeros(len(y)), np.ones(len(y), bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            v = w * mu
            target = v * (eta + (y - mu) / mu)
            s0, s1, s2, r0, r1 = v.sum(1), v @ t, v @ (t * t), target.sum(1), target @ t
            det = s0 * s2 - s1 * s1
            level, slope = np.where(open_, (s2 * r0 - s1 * r1) / det, level), np.where(open_, (s0 * r1 - s1 * r0) / det, slope)
            new = level[:, None] + slope[:, None] * t
            moved = np.abs(new - eta).max(1)
            eta, mu = new, np.exp(new)
            open_ &= ~(moved < 1e-10) & np.isfinite(moved)
            if not open_.any():
                break
        v = w * mu
        s0, s1, s2 = v.sum(1), v @ t, v @ (t * t)
        spread = (s2 - 2 * n * s1 + n * n * s0) / (s0 * s2 - s1 * s1)
    return np.stack([level, slope], axis=1), spread, mu, np.isfinite(level + slope + spread) & (spread >= 0)


def aberrations_of(histories: np.ndarray, current: np.ndarray, alpha: float = 0.05, scale: float = 1.0, min_history: int = 4) -> dict[str, np.ndarray]:
    """Farrington's test of current values against a quasi-Poisson trend through their histories (rows of equal length), once reweighted so
    that past outbreaks count less. Short or flat histories: alarm beyond half again the mean."""
    y, now = np.asarray(histories, float) * scale, np.asarray(current, float) * scale
    m, n = y.shape
    mean = y.mean(1) if n else np.zeros(m)
    limit = 1.5 * mean + 1e-6
    out: dict[str, np.ndarray] = {"expected": mean / scale, "threshold": limit / scale, "dispersion": np.full(m, np.nan), "trend_slope": np.full(m, np.nan), "z": np.zeros(m), "exceedance": np.zeros(m), "alarm": now > limit, "note": np.full(m, "insufficient or flat history", object)}
    able = np.flatnonzero((y != y[:, :1]).any(1)) if n >= min_history else np.empty(0, int)
    if not len(able):
        return out
    y, now = y[able], now[able]
    with np.errstate(all="ignore"):
        weights = np.ones_like(y)
        for turn in range(2):
            (level, slope), spread, mu, sound = (lambda c, *rest: (c.T, *rest))(*_trend_fits(y, weights))
            phi = np.maximum(1.0, (weights * (y - mu) ** 2 / mu).sum(1) / max(n - 2, 1))
            if turn == 0:
                safe = np.maximum(mu, 1e-6)
                residual = np.abs(1.5 * (y ** (2 / 3) - safe ** (2 / 3)) / safe ** (1 / 6) / np.sqrt(phi)[:, None])
                weights = np.where(residual > 2.58, (2.58 / np.maximum(residual, 1e-12)) ** 2, 1.0)
                weights = np.where(np.isfinite(weights), weights, 1.0)
        expected = np.exp(level + slope * n)
        sound &= np.isfinite(expected)
        t = np.arange(n) - (n - 1) / 2
        logs = np.log(y + 0.5)
        plain = logs @ t / (t @ t)
        slope = np.where(sound, slope, plain)
        expected = np.where(sound, expected, np.exp(logs.mean(1) + plain * (n - (n - 1) / 2)))
        spread = np.where(sound, spread, 0.0)
        phi = np.where(sound, phi, np.maximum(1.0, y.var(1) / (y.mean(1) + 1e-9)))
        sd = 2 / 3 * expected ** (-1 / 3) * np.sqrt(np.maximum(phi * expected + expected * expected * spread, 1e-12))
        limit = (expected ** (2 / 3) + normal_quantile(1 - alpha) * sd) ** 1.5
        z = (now ** (2 / 3) - expected ** (2 / 3)) / (sd + 1e-12)
    up = np.maximum(z, 0.0)
    made = {"expected": expected / scale, "threshold": limit / scale, "dispersion": phi, "trend_slope": slope, "z": z, "exceedance": up / (up + 2), "alarm": now > limit, "note": np.where(sound, "ok", "log-linear fallback").astype(object)}
    for k, v in made.items():
        out[k][able] = v
    return out


def aberration(history: list[float], current: float, alpha: float = 0.05, scale: float = 1.0, min_history: int = 4) -> dict:
    """aberrations_of one history; None where there is no trend."""
    out = aberrations_of(np.array([history], float), np.array([current]), alpha, scale, min_history)
    return {k: v[0] if k == "note" else bool(v[0]) if k == "alarm" else None if np.isnan(v[0]) else float(v[0]) for k, v in out.items()}


DIGITS = {"expected": 6, "threshold": 6, "dispersion": 4, "trend_slope": 5, "z": 4, "exceedance": 4}


def aberrations_each(flat: np.ndarray, size: np.ndarray, x: np.ndarray, alpha: float = 0.05, scale: float = 1.0, min_history: int = 4, warmup: bool = False) -> dict[str, np.ndarray]:
    """aberrations_of values whose histories, of any lengths, lie one after another in flat; rounded. All of one length are solved together."""
    begin = np.cumsum(size) - size
    out = {k: np.full(len(x), np.nan) for k in RESULTS[:-2]} | {"alarm": np.zeros(len(x), bool), "note": np.full(len(x), "warmup", object)}
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if warmup and n < min_history:
            out["z"][at] = out["exceedance"][at] = 0.0
            continue
        for k, v in aberrations_of(flat[begin[at][:, None] + np.arange(n)], x[at], alpha, scale, min_history).items():
            out[k][at] = np.round(v, DIGITS[k]) if k in DIGITS else v
    return out


MOST_HISTORY = 1040  # twenty years of weeks


def aberrations(series: DataFrame, window: int | None = 16, scale: float = 100.0, alpha: float = 0.05, min_history: int = 4, warmup: bool = False) -> DataFrame:
    """Every point tested against the `window` points before it (None: all before it, the newest MOST_HISTORY). warmup: points with fewer than min_history before them get
    no expectation, no alarm and the note `warmup`.

    A window gathers each point's history; Arrow batches of points then solve all of one length together, so sites of any size share tasks."""
    kind = series.schema["t"].dataType.simpleString()
    before = W.partitionBy("site").orderBy("t").rowsBetween(-(window or MOST_HISTORY), -1)
    rows = series.select("site", "t", F.col("x").cast("double").alias("x"), F.collect_list(F.col("x").cast("double")).over(before).alias("past"))
    schema = f"site string, t {kind}, x double, expected double, threshold double, dispersion double, trend_slope double, z double, exceedance double, alarm boolean, note string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            past, x = b.column("past"), b.column("x").to_numpy(zero_copy_only=False)
            out = aberrations_each(past.flatten().to_numpy(zero_copy_only=False), past.value_lengths().to_numpy(zero_copy_only=False), x, alpha, scale, min_history, warmup)
            yield pa.RecordBatch.from_arrays([b.column("site"), b.column("t"), b.column("x"), *[pa.array(out[k], from_pandas=True) for k in RESULTS]], names=["site", "t", "x", *RESULTS])

    return rows.mapInArrow(run, schema)


def validate_external(series: DataFrame, external: DataFrame) -> DataFrame:
    """(site, n_matched, r, concordant, summary) of a site's series and an outside signal (site, t, value) on equal dates."""
    both = series.join(external.select("site", "t", "value"), ["site", "t"]).groupBy("site").agg(F.count(F.lit(1)).alias("n_matched"), F.corr("x", "value").alias("r"))
    r = F.when(F.col("n_matched") >= 3, F.col("r"))
    out = external.select("site").distinct().join(both, "site", "left").withColumns({"n_matched": F.coalesce("n_matched", F.lit(0).cast("long")), "r": r})
    return out.select("site", "n_matched", "r", (F.col("r") >= 0.5).alias("concordant"), F.when(F.col("r").isNull(), "Insufficient overlapping dates").otherwise(F.format_string("r = %.3f over %d dates", "r", "n_matched")).alias("summary"))
