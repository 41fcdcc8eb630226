"""Repair of metadata totals: derived values, steps where they differ, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The only places a repair may write to.
POINTERS = ("/total_episodes", "/total_frames", "/total_tasks", "/total_videos")


def derived_totals(episodes: DataFrame, footers: DataFrame | None, tasks: DataFrame, videos: DataFrame | None) -> DataFrame:
    """(pointer, derived, reason): what metadata and footers prove; a null derived value comes with the reason why it is ambiguous.

    episodes (episode_index, length), footers (path, num_rows), tasks (task_index, task), videos (path).
    """
    e = episodes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("episode_index").alias("d"), F.count_if(F.col("length").isNull()).alias("open"), F.sum("length").alias("length"))
    t = tasks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task_index").alias("i"), F.countDistinct("task").alias("names"))
    clean = F.col("n") == F.col("d")
    row = lambda df, pointer, value, reason: df.select(F.lit(pointer).alias("pointer"), value.cast("long").alias("derived"), reason.alias("reason"))
    parts = [row(e, POINTERS[0], F.when(clean, F.col("n")), F.when(~clean, "duplicate or missing episode index"))]
    if footers is not None:
        f = footers.agg(F.count_if(F.col("num_rows").isNull()).alias("open"), F.sum("num_rows").alias("rows"))
        parts.append(row(f, POINTERS[1], F.when(F.col("open") == 0, F.coalesce("rows", F.lit(0))), F.when(F.col("open") > 0, "unreadable shard")))
    else:
        parts.append(row(e, POINTERS[1], F.when((F.col("open") == 0) & clean, F.coalesce("length", F.lit(0))), F.when((F.col("open") > 0) | ~clean, "unknown length")))
    mapped = (F.col("n") == F.col("i")) & (F.col("n") == F.col("names"))
    parts.append(row(t, POINTERS[2], F.when(mapped, F.col("n")), F.when(~mapped, "task mapping is not one to one")))
    if videos is not None:
        parts.append(row(videos.agg(F.countDistinct("path").alias("n")), POINTERS[3], F.col("n"), F.lit(None).cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def steps(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """(pointer, before, after) where a derived total is known, allowed and differs from the declared integer."""
    both = derived.where(F.col("derived").isNotNull() & F.col("pointer").isin(*POINTERS)).join(declared, "pointer", "left")
    return both.where("NOT declared <=> derived").select("pointer", F.col("declared").alias("before"), F.col("derived").alias("after"))


def receipt(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """failed if any expected value is not there, unverified without expectations, else verified."""
    both = expected.join(actual.select("pointer", F.col("declared").alias("now")), "pointer", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("after").eqNullSafe(F.col("now"))).alias("wrong")).select(F.when(F.col("n") == 0, "unverified").when(F.col("wrong") > 0, "failed").otherwise("verified").alias("status"), "n", "wrong")


def refused(plan: DataFrame) -> DataFrame:
    """Steps of a plan (pointer, before, after) that may not be applied: a place outside POINTERS, a repeated place, a negative or missing value."""
    n = plan.groupBy("pointer").agg(F.count(F.lit(1)).alias("_n"))
    reason = F.when(~F.col("pointer").isin(*POINTERS), "pointer").when(F.col("_n") > 1, "repeated").when(F.coalesce(F.col("after"), F.lit(-1)) < 0, "value")
    return plan.join(n, "pointer").withColumn("reason", reason).where("reason IS NOT NULL").drop("_n")


# Words in a code that make leaving it unresolved risky for training.
RISKY = ("RANGE", "INDEX", "TIMESTAMP", "NON_FINITE", "SHAPE", "UNREADABLE", "MISSING")


def unresolved(after: DataFrame) -> DataFrame:
    """Findings that a repair leaves, with their risk: high for errors whose code has a word of RISKY, medium for other errors, else low."""
    hit = F.lit(False)
    for w in RISKY:
        hit = hit | F.col("code").contains(w)
    return after.withColumn("risk", F.when((F.col("severity") == "error") & hit, "high").when(F.col("severity") == "error", "medium").otherwise("low"))


def stale(plan: DataFrame, now: DataFrame) -> DataFrame:
    """Steps whose place no longer holds the value that the plan saw; such a plan must be made anew."""
    return plan.join(now.select("pointer", F.col("declared").alias("now")), "pointer", "left").where("NOT before <=> now")
