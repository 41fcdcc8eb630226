"""Connected components by smallest label, for link tables too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import spread_join, stash


def components(links: DataFrame) -> DataFrame:
    """(v, label) for the ends of `links` (a, b): label is the smallest id that links reach from v.

    Each round every vertex takes the smallest label among its own and its neighbours', then that label's own label, which halves
    the way. The minimum is combined before the shuffle; the links of a hub, and the vertices that share a label, are dealt to several tasks where either is
    a large share of all. It ends when nothing changes.
    """
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    # n: the links of a vertex, which never change
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("n"))
    labels = stash(labels, "labels")
    while True:
        near = spread_join(both, labels.withColumnRenamed("v", "b"), ["b"], "a").groupBy("a").agg(F.min("label").alias("near"))
        taken = stash(labels.join(near, labels["v"] == near["a"]).select("v", "label", "n", F.least("label", "near").alias("new")), "taken")
        shared = taken.groupBy("new").agg(F.count(F.lit(1)).alias("m"))
        roots = labels.select(F.col("v").alias("new"), F.col("label").alias("of_root")).join(shared, "new").withColumnRenamed("m", "n")
        jumped = spread_join(taken.withColumnRenamed("n", "links"), stash(roots, "roots"), ["new"], "v").select("v", F.least("new", "of_root").alias("new"), "label", F.col("links").alias("n"))
        step = stash(jumped, "labels")
        moved = step.where("new < label").limit(1).count()
        labels = step.select("v", F.col("new").alias("label"), "n")
        if not moved:
            return labels.drop("n")
