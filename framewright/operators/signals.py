"""Advisory signals over measurements; none of them is a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.sequence import static_spans


def short_episodes(episodes: DataFrame, fps: DataFrame, length: str, seconds: float) -> DataFrame:
    """Episodes shorter than `seconds`, if `fps` (fps) has exactly one distinct value; else none."""
    one = fps.agg(F.countDistinct("fps").alias("_n"), F.max("fps").alias("_fps")).where("_n = 1 AND _fps > 0").select("_fps")
    return episodes.join(F.broadcast(one), how="cross").withColumn("seconds", F.col(length) / F.col("_fps")).where(F.col("seconds") < seconds).drop("_fps")


def imbalance(df: DataFrame, group: str) -> DataFrame:
    """One row if there are at least two groups and their sizes differ: n_groups, smallest, largest."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("smallest"), F.max("n").alias("largest")).where("n_groups >= 2 AND smallest <> largest")


def idle_spans(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, least: int) -> DataFrame:
    """Static spans of at least `least` rows."""
    return static_spans(df, group, order, value, least=least)


def trim_plan(spans: DataFrame, related: DataFrame, key: str) -> DataFrame:
    """Spans with the sorted artifacts of their episode: evidence for a trim that is never executed."""
    paths = related.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("artifacts"))
    return spans.join(paths, key, "left")
