"""A directory of inputs as a stream: each new file becomes a run, once; a failed one is tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


LOG = "path string, ok boolean, error string"


def watch(spark: SparkSession, directory: str, state: str, process: Callable[[str, DataFrame], None], pattern: str = "*", interval: str | None = None, run_on_start: bool = True) -> StreamingQuery:
    """Calls process(path, lines) for each new text file below directory, lines being its (line_no, line).

    state holds the stream's checkpoint and `processed`, a table of what has succeeded: an input is marked only then, so
    one that fails does not stop others, is kept with its error, and is tried again with the next batch. interval: a processing-time trigger;
    without it all that is there is processed and the query ends. run_on_start=False marks what is there as processed.
    """
    source = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = source.load(directory).select(F.col("_metadata.file_path").alias("path"), "value")
    marks = f"{state}/processed"
    hpath = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda p: hpath(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath(p))
    first_start = not exists(marks)
    if first_start:
        spark.createDataFrame([], LOG).write.parquet(marks)
    if first_start and not run_on_start:
        now = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory).select("path")
        now.select("path", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")).write.mode("append").parquet(marks)

    def batch(rows: DataFrame, _: int) -> None:
        log = spark.read.schema(LOG).parquet(marks)
        settled = log.where("ok").select("path")
        again = [r["path"] for r in log.where("not ok").join(settled, "path", "left_anti").select("path").distinct().collect()]
        new = [r["path"] for r in rows.select("path").join(settled, "path", "left_anti").distinct().orderBy("path").collect()]
        results = []
        for path in dict.fromkeys(again + new):
            text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
            try:
                process(path, text)
                results.append((path, True, None))
            except Exception as error:  # noqa: BLE001  what an input raises must not stop the stream
                results.append((path, False, f"{type(error).__name__}: {error}"[:1000]))
        if results:
            spark.createDataFrame(results, LOG).write.mode("append").parquet(marks)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stream_daily_scores(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(site, t, x, n): mean value of each site and day of a stream of events (site, ts, value), with a watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "site").agg(F.avg("value").alias("x"), F.count(F.lit(1)).alias("n")).select("site", F.col("window.start").alias("t"), "x", "n")


def first_runs(runs: DataFrame, lateness: str = "2 days") -> DataFrame:
    """A stream of runs (site, run_date, ts, ...) with each site's first run of a date only; later ones within the lateness are dropped."""
    return runs.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["site", "run_date"])


def running_cusum(scores: DataFrame, k: float = 0.5, h: float = 4.0, baseline: int = 8) -> DataFrame:
    """(site, t, x, cusum_upper, alert) of a stream of scores (site, t, x): the state of a site is the sums of its baseline,
    its first points, and the CUSUM since."""
    import pandas as pd

    def step(key, frames, state):  # noqa: ANN001, ANN202
        n, total, square, level = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        for f in frames:
            f = f.sort_values("t")
            out = []
            for x in f["x"]:
                if n < baseline:
                    n, total, square = n + 1, total + x, square + x * x
                else:
                    mean = total / n
                    sd = max((square - n * mean * mean) / max(n - 1, 1), 0.0) ** 0.5 or 1.0
                    level = max(0.0, level + (x - mean) / sd - k)
                out.append(level)
            yield pd.DataFrame({"site": key[0], "t": f["t"], "x": f["x"], "cusum_upper": out, "alert": [v > h for v in out]})
        state.update((n, total, square, level))

    from pyspark.sql.streaming.state import GroupStateTimeout

    return scores.groupBy("site").applyInPandasWithState(step, "site string, t timestamp, x double, cusum_upper double, alert boolean", "n int, total double, square double, level double", "append", GroupStateTimeout.NoTimeout)
