"""Evaluation of scores against truth: confusion, macro and micro means, ROC, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import running


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def confusion(scored: DataFrame, by: list[str], threshold: float = 0.6) -> DataFrame:
    """tp, fp, tn, fn and what follows of them for each group of (score, label); rows without label do not count, a missing
    score is 0, a ratio with nothing below it is null."""
    called = F.coalesce("score", F.lit(0.0)) >= threshold
    known = scored.where(F.col("label").isNotNull())
    counts = known.groupBy(*by).agg(F.count_if(called & F.col("label")).alias("tp"), F.count_if(called & ~F.col("label")).alias("fp"), F.count_if(~called & ~F.col("label")).alias("tn"), F.count_if(~called & F.col("label")).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"sensitivity": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "precision": _ratio(tp, tp + fp), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "false_alarm_rate": _ratio(fp, fp + tn)})


def overall(metrics: DataFrame) -> DataFrame:
    """Macro means over groups that have a sensitivity (null ratios as 0), micro ratios from all counts."""
    have = F.col("sensitivity").isNotNull()
    macro = [F.avg(F.when(have, F.coalesce(c, F.lit(0.0)))).alias(f"macro_{c}") for c in ("sensitivity", "specificity", "precision", "f1")]
    tp, fp, tn, fn = (F.sum(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return metrics.agg(*macro, _ratio(tp, tp + fn).alias("micro_sensitivity"), _ratio(tn, tn + fp).alias("micro_specificity"), _ratio(tp, tp + fp).alias("micro_precision"), _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def roc_points(scored: DataFrame) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr, precision) at each score, and the rates above it. Equal scores are one point; the running sums
    go over one row for each different score, by ranges of it."""
    known = scored.where(F.col("label").isNotNull())
    steps = known.groupBy(F.col("score").alias("threshold")).agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("q"))
    total = steps.agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    out = running(steps, "threshold", {"tp": F.col("p"), "fp": F.col("q")}).join(F.broadcast(total))
    return out.select("threshold", "tp", "fp", _ratio(F.col("tp").cast("double"), F.col("pos")).alias("tpr"), _ratio(F.col("fp").cast("double"), F.col("neg")).alias("fpr"), _ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"), _ratio((F.col("tp") - F.col("p")).cast("double"), F.col("pos")).alias("tpr_before"), _ratio((F.col("fp") - F.col("q")).cast("double"), F.col("neg")).alias("fpr_before"))


def roc_summary(scored: DataFrame, sensitivity: float = 0.95, specificity: float = 0.95) -> DataFrame:
    """auroc, auprc, and the thresholds of Youden's index, of a target sensitivity and of a target specificity. Nulls
    where only one label is there."""
    points = roc_points(scored).withColumns({"prev_t": F.col("tpr_before"), "prev_f": F.col("fpr_before")})
    return points.agg(
        F.sum((F.col("fpr") - F.col("prev_f")) * (F.col("tpr") + F.col("prev_t")) / 2).alias("auroc"),
        F.sum((F.col("tpr") - F.col("prev_t")) * F.col("precision")).alias("auprc"),
        F.max_by("threshold", F.struct(F.col("tpr") - F.col("fpr"), "threshold")).alias("theta_youden"),
        F.max(F.when(F.col("tpr") >= sensitivity, F.col("threshold"))).alias("theta_sensitivity"),
        F.min(F.when(1 - F.col("fpr") >= specificity, F.col("threshold"))).alias("theta_specificity"),
    )


def interval(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and the 2.5 and 97.5 percentiles (interpolated) of each group."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q")).select(*by, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def majority(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))
