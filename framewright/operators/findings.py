"""Findings as a relation: enrichment from the registry, order, de-duplication, gating by coverage, triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}


def enrich(found: DataFrame, registry: DataFrame, unknown: str = "fallback") -> DataFrame:
    """Findings with the registry's layer and repair; the registry's layer wins.

    A severity other than the registry's is a contradiction and fails the query; an unknown code fails it too, unless
    `unknown` is "fallback", where it keeps what it came with. The registry is a fixed table of 89 rows and is broadcast.
    """
    r = F.broadcast(registry.select("code", F.col("severity").alias("r_severity"), F.col("layer").alias("r_layer"), "repair"))
    both = found.join(r, "code", "left")
    conflict = F.col("r_severity").isNotNull() & (F.col("severity") != F.col("r_severity"))
    severity = F.when(conflict, F.raise_error(F.concat(F.lit("severity contradicts the registry: "), F.col("code"))).cast("string")).otherwise(F.col("severity"))
    if unknown != "fallback":
        severity = F.when(F.col("r_severity").isNull(), F.raise_error(F.concat(F.lit("unknown code: "), F.col("code"))).cast("string")).otherwise(severity)
    return both.withColumn("severity", severity).withColumn("layer", F.coalesce("r_layer", "layer")).drop("r_severity", "r_layer")


def rank(column: str, order: Sequence[str]) -> Column:
    """Place of a value in `order`, others behind."""
    out = F.lit(len(order))
    for k, v in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == v, k).otherwise(out)
    return out


def deduplicated(found: DataFrame, keys: Sequence[str] = ("code", "path", "location", "evidence"), order: Sequence[Column | str] = ("layer", "code", "path", "message")) -> DataFrame:
    """The first finding by `order` of those that agree in `keys`, nulls being equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ordered(found: DataFrame) -> DataFrame:
    """Severity, layer, code, path, location, evidence, message."""
    from framewright.model import LAYERS, SEVERITIES

    return found.orderBy(rank("severity", SEVERITIES), rank("layer", LAYERS), "code", "path", "location", "evidence", "message")


def severity_summary(found: DataFrame) -> DataFrame:
    """Findings of each severity."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def per_episode(found: DataFrame) -> DataFrame:
    """Errors, warnings and infos of each episode."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.where("episode_index IS NOT NULL").groupBy("episode_index").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))


def coverage_status(checked: Column, total: Column) -> Column:
    """complete, partial, unavailable or not_applicable from what was checked of a total; a null total is unknown."""
    return F.when(total == 0, "not_applicable").when(F.coalesce(checked, F.lit(0)) == 0, "unavailable").when(total.isNotNull() & (checked >= total), "complete").otherwise("partial")


INTEGRITY = ("metadata", "sample", "full")


def gate(requirements: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rules (rule, capability, minimum, need) against coverage (capability, status, integrity): each rule with state run or skip and its missing capabilities.

    need `available` is met by complete or partial coverage, `complete` by complete coverage only; the integrity must reach the minimum.
    """
    both = requirements.join(F.broadcast(coverage), "capability", "left")
    reached = rank("integrity", INTEGRITY) >= rank("minimum", INTEGRITY)
    known = F.col("integrity").isin(*INTEGRITY)
    enough = F.when(F.col("need") == "complete", F.col("status") == "complete").otherwise(F.col("status").isin("complete", "partial"))
    met = F.coalesce(enough & known & reached, F.lit(False))
    lost = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("_met"), F.col("capability")))), ",")
    return both.withColumn("_met", met).groupBy("rule").agg(F.when(F.bool_and("_met"), "run").otherwise("skip").alias("state"), lost.alias("missing"))


KINDS = ("episode", "feature", "camera", "shard", "dataset")


def triage(found: DataFrame) -> DataFrame:
    """Findings grouped by what they are about: the most specific of episode, feature, camera, shard (path), else the data set; errors, warnings and advisories of each group."""
    kind = F.when(F.col("episode_index").isNotNull(), "episode").when(F.col("feature_key").isNotNull(), "feature").when(F.col("camera").isNotNull(), "camera").when(F.col("path").isNotNull(), "shard").otherwise("dataset")
    name = F.coalesce(F.col("episode_index").cast("string"), "feature_key", "camera", "path", F.lit("dataset"))
    n = lambda c: F.count_if(c).alias
    grouped = found.withColumn("kind", kind).withColumn("name", name).groupBy("kind", "name")
    return grouped.agg(n(F.col("severity") == "error")("errors"), n(F.col("severity") == "warning")("warnings"), n(~F.col("severity").isin("error", "warning"))("advisories"))


def resolved(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("code", "path", "location")) -> DataFrame:
    """Findings of before that after no longer has."""
    from framewright.operators.digest import identity

    return before.withColumn("identity", identity(*keys)).join(after.select(identity(*keys).alias("identity")).distinct(), "identity", "left_anti")
