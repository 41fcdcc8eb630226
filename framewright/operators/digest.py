"""Content digests: canonical rows, ordered episode digests, duplicates and shared payloads.

A canonical row is the text of its values joined by U+001F, null as U+0000; it is stable inside this engine
and does not depend on partitions or input order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(*columns: str) -> Column:
    """The text of a row's values."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical row."""
    return F.sha2(canonical(*columns), 256)


def identity(*columns: str) -> Column:
    """SHA-256 of values joined by U+0000, as findings are identified by code, path and location."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def episode_digests(df: DataFrame, group: Sequence[str], order: Sequence[str], row: Column) -> DataFrame:
    """SHA-256 over an episode's rows in order, each followed by a newline, and their count; an episode is held by one task."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], row.alias("_row"))))
    text = F.concat(F.array_join(F.transform(ordered, lambda x: x["_row"]), "\n"), F.lit("\n"))
    return df.groupBy(*group).agg(F.sha2(text, 256).alias("digest"), F.count(F.lit(1)).alias("n_rows"))


def duplicate_content(df: DataFrame, digest: Column, member: str) -> DataFrame:
    """Digests that several members share: n_members and the smallest member."""
    return df.where(digest.isNotNull()).groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n_members"), F.min(member).alias("first_member")).where("n_members > 1")


def shared_payloads(inputs: DataFrame, digest: str = "digest", source: str = "source") -> DataFrame:
    """Digests that stand in several inputs, with the number of inputs; counted per digest, never as pairs."""
    return inputs.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.countDistinct(source).alias("n_sources"), F.count(F.lit(1)).alias("n_members")).where("n_sources > 1")


#: Hexadecimal digits of a row's digest that name its leaf, and of a leaf that name its branch.
LEAF, BRANCH = 5, 2


def component_fingerprints(components: DataFrame, component: str, key: str, row: Column) -> DataFrame:
    """One digest per component over its rows' digests: of a tree whose leaves take rows by the first digits of their digest, in key order.

    So a task holds the digests of one leaf, one row in a million of a component, or of one branch's leaves.
    """
    joined = lambda at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*at))), lambda x: x["_h"]), ""), 256).alias("_h")
    hashed = components.select(component, F.col(key).alias("_k"), F.sha2(row, 256).alias("_h")).withColumn("_leaf", F.substring("_h", 1, LEAF))
    leaves = hashed.groupBy(component, "_leaf").agg(joined(["_k", "_h"])).withColumn("_branch", F.substring("_leaf", 1, BRANCH))
    branches = leaves.groupBy(component, "_branch").agg(joined(["_leaf", "_h"]))
    return branches.groupBy(component).agg(joined(["_branch", "_h"])).withColumnRenamed("_h", "fingerprint")
