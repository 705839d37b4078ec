"""Connected components of a graph given by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (a, b), root the smallest node of its component.

    Smallest labels pass along links, and each label then jumps to its label's label, until nothing changes; each round
    is a written table. Joins and grouped minima only, so hub nodes are pre-aggregated or split. Links with a null end
    are ignored; loops and repeated links do no harm.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    written = state = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = state.join(near, "node").select("node", F.least("root", "low").alias("next"), "root")
        jump = state.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = saved(step.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved")))
        discard(written)
        written, state = new, new.select("node", "root")
        if new.where("moved").isEmpty():
            discard(both)
            return state
