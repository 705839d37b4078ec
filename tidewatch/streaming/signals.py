"""Signals of sites as a stream: rolling z, CUSUM and Farrington's test of each new score, from a state of a few numbers a site."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.operators.series import aberrations_each

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGNALS = "site string, t timestamp, x double, z_score double, cusum double, cusum_alert boolean, expected double, threshold double, exceedance double, alarm boolean, note string, late boolean"


class SiteSignals(StatefulProcessor):
    """The state of a site: its last `history` points in order, the sums of its first `baseline` points, and its CUSUM since.

    Points come in any order within a batch. One that is not after the site's last point is late: it is given back with late = true and
    without signals, and changes no state. A site without points for `expiry` of event time is forgotten; should it come back, it begins anew."""

    def __init__(self, window: int = 8, history: int = 16, baseline: int = 8, k: float = 0.5, h: float = 4.0, scale: float = 100.0, alpha: float = 0.05, min_history: int = 4, expiry_days: int = 365) -> None:
        self.window, self.history, self.baseline, self.k, self.h = window, history, baseline, k, h
        self.scale, self.alpha, self.min_history, self.expiry = scale, alpha, min_history, expiry_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "x double")
        self.sums = handle.getValueState("sums", "last timestamp, n int, total double, square double, level double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["t", "x"], kind="stable")
        last, n, total, square, level = self.sums.get() if self.sums.exists() else (None, 0, 0.0, 0.0, 0.0)
        past = [r[0] for r in self.past.get()] if self.past.exists() else []
        out: dict[str, list] = {c: [] for c in ("z_score", "cusum", "late")}
        flat, size = [], []
        last = None if last is None else pd.Timestamp(last)
        for t, x in zip(new["t"], new["x"], strict=True):
            late = last is not None and t <= last
            out["late"].append(late)
            size.append(0 if late else len(past))
            if late:
                out["z_score"].append(np.nan)
                out["cusum"].append(np.nan)
                continue
            near = past[-self.window :]
            out["z_score"].append(0.0 if len(near) < 2 else (x - np.mean(near)) / (np.std(near, ddof=1) + 1e-10))
            if n < self.baseline:
                n, total, square = n + 1, total + x, square + x * x
            else:
                mean = total / n
                sd = max((square - n * mean * mean) / max(n - 1, 1), 0.0) ** 0.5 or 1.0
                level = max(0.0, level + (x - mean) / sd - self.k)
            out["cusum"].append(level)
            flat += past
            past = [*past, x][-self.history :]
            last = t
        found = aberrations_each(np.array(flat, float), np.array(size, int), new["x"].to_numpy(float), self.alpha, self.scale, self.min_history)
        late = np.array(out["late"], bool)
        if last is not None:
            self.sums.update((last.to_pydatetime(), n, total, square, level))
            self.past.put([(x,) for x in past])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.expiry)
        number = lambda v: pd.Series(np.where(late, np.nan, v), dtype=float)
        mark = lambda v: pd.Series([None if x else bool(y) for x, y in zip(late, v, strict=True)], dtype=object)
        yield pd.DataFrame({
            "site": key[0], "t": new["t"].to_numpy(), "x": new["x"].to_numpy(), "z_score": out["z_score"], "cusum": out["cusum"], "cusum_alert": mark(np.array(out["cusum"]) > self.h),
            "expected": number(found["expected"]), "threshold": number(found["threshold"]), "exceedance": number(found["exceedance"]), "alarm": mark(found["alarm"]),
            "note": np.where(late, "late", found["note"]), "late": late,
        })

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.sums.clear()
        self.past.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def streamed_signals(scores: DataFrame, lateness: str = "14 days", **settings: float) -> DataFrame:
    """SIGNALS of a stream of scores (site, t as a timestamp, x), a row for each score as soon as it comes. Rows older than the watermark, which is
    `lateness` behind the newest score of any site, are dropped by Spark; rows without t or x are left out. Needs the RocksDB state store (`started`)."""
    rows = scores.where("t is not null and x is not null").select(F.col("site").cast("string").alias("site"), "t", F.col("x").cast("double").alias("x"))
    return rows.withWatermark("t", lateness).groupBy("site").transformWithStateInPandas(statefulProcessor=SiteSignals(**settings), outputStructType=SIGNALS, outputMode="Append", timeMode="EventTime")


@contextmanager
def _provider(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def started(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """The stream written as Parquet below path. The state store is set for this query only; a query started again with its checkpoint goes on where it
    was. interval: a processing-time trigger; without it what is there is processed."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    with _provider(stream.sparkSession):
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
