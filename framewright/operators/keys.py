"""Keys, references and totals: duplicates, gaps, orphans, declared against counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str], occurrence: Column | None = None) -> DataFrame:
    """Keys that stand more than once, with their count and, if asked for, the sorted list of occurrences.

    The count is combined before the shuffle. A list holds one key's occurrences only and belongs in reports on small key groups.
    """
    aggregates = [F.count(F.lit(1)).alias("n")]
    if occurrence is not None:
        aggregates.append(F.array_sort(F.collect_list(occurrence)).alias("occurrences"))
    return df.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0).groupBy(*keys).agg(*aggregates).where("n > 1")


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def orphans(df: DataFrame, reference: DataFrame, key: str, to: str | None = None, nulls: bool = True) -> DataFrame:
    """Rows whose key is unknown to `reference`; a null key counts as unknown unless `nulls` is off."""
    to = to or key
    known = reference.select(F.col(to).alias("_known")).distinct()
    lost = df.join(known, df[key] == known["_known"], "left_anti")
    return lost if nulls else lost.where(F.col(key).isNotNull())


def absent(reference: DataFrame, df: DataFrame, key: str, to: str | None = None) -> DataFrame:
    """Rows of `reference` that no row of `df` refers to."""
    return orphans(reference, df, key, to, nulls=False)


def gaps(df: DataFrame, group: Sequence[str], index: str, start: int = 0) -> DataFrame:
    """Missing stretches of an index that should run from `start` without holes: first_missing, last_missing, n_missing for each.

    One row for each hole, however long, instead of the set of missing values.
    """
    distinct = df.where(F.col(index) >= start).select(*group, F.col(index).cast("long").alias(index)).distinct()
    before = F.coalesce(F.lag(index).over(Window.partitionBy(*group).orderBy(index)), F.lit(start - 1))
    holes = distinct.withColumn("first_missing", before + 1).where(F.col(index) > F.col("first_missing"))
    return holes.select(*group, "first_missing", (F.col(index) - 1).alias("last_missing"), (F.col(index) - F.col("first_missing")).alias("n_missing"))


def contiguity(df: DataFrame, group: Sequence[str], index: str, expected: DataFrame | None = None) -> DataFrame:
    """For each group: n_rows, n_distinct, first, last, expected length (declared where `expected` has `length`, else the distinct count), missing and unexpected counts."""
    found = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(index).alias("n_distinct"), F.min(index).cast("long").alias("first"), F.max(index).cast("long").alias("last")
    )
    if expected is not None:
        found = found.join(expected, list(group), "left")
    length = F.coalesce(F.col("length"), F.col("n_distinct")) if expected is not None else F.col("n_distinct")
    found = found.withColumn("expected", length)
    inside = df.select(*group, index).distinct().join(found.select(*group, "expected"), list(group)).where(F.col(index).between(0, F.col("expected") - 1)).groupBy(*group).agg(F.count(F.lit(1)).alias("inside"))
    found = found.join(inside, list(group), "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    return found.select(*group, "n_rows", "n_distinct", "first", "last", "expected", (F.col("expected") - F.col("inside")).alias("n_missing"), (F.col("n_distinct") - F.col("inside")).alias("n_unexpected"))


def row_count_mismatch(frames: DataFrame, episodes: DataFrame, key: str, length: str) -> DataFrame:
    """Episodes whose declared length differs from their frames: expected, observed; no frames count as 0, null lengths are left out."""
    observed = frames.groupBy(key).agg(F.count(F.lit(1)).alias("observed"))
    joined = episodes.where(F.col(length).isNotNull()).select(key, F.col(length).cast("long").alias("expected")).join(observed, key, "left")
    return joined.select(key, "expected", F.coalesce("observed", F.lit(0)).cast("long").alias("observed")).where("expected <> observed")


def coverage_missing(left: DataFrame, right: DataFrame, relation: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs of the small dimensions `left` x `right` that `relation` lacks; `right` must be a short list (cameras, features)."""
    names = [r[0] for r in right.select(right_key).distinct().orderBy(right_key).collect()]
    wanted = left.select(left_key).distinct().withColumn(right_key, F.explode(F.array(*[F.lit(x) for x in names])))
    return wanted.join(relation.select(left_key, right_key).distinct(), [left_key, right_key], "left_anti")


def declared_against(declared: DataFrame, counted: DataFrame) -> DataFrame:
    """(name, declared) against (name, counted): rows that differ; what nobody declared is no mismatch."""
    return declared.join(counted, "name", "left").where("declared IS NOT NULL AND NOT declared <=> counted").select("name", "declared", "counted")


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: side is missing (left only) or unexpected (right only)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def unique_or_null(df: DataFrame, key: str) -> DataFrame:
    """The rows of `df` if its key is present and unique throughout, else no rows."""
    verdict = df.agg((F.count(F.lit(1)) == F.countDistinct(key)).alias("_unique"))
    return df.join(F.broadcast(verdict), F.col("_unique")).drop("_unique")


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that carry several values: the number of distinct values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")
