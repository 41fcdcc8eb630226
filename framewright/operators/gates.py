"""Readiness: requirements as rows against features, coverage and format, each gate one CASE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import glob_regex
from framewright.operators.findings import INTEGRITY, rank

FEATURE_REQUIREMENT = "feature string, dtype string, shape array<long>, min_rank int, max_last_dim long, action_dim long, normalization string, deltas array<double>"


def feature_gates(requirements: DataFrame, features: DataFrame) -> DataFrame:
    """Failed gates of required features; a missing feature fails only as missing. Requirements are short and features are a dimension."""
    f = features.select(F.col("feature").alias("_f"), F.col("dtype").alias("f_dtype"), F.col("shape").alias("f_shape"), F.col("normalization").alias("f_norm"), F.col("deltas").alias("f_deltas"))
    both = requirements.join(f, F.col("feature") == F.col("_f"), "left")
    here = F.col("_f").isNotNull()
    last = F.element_at("f_shape", -1)
    shape = (
        (F.col("shape").isNotNull() & ~F.col("shape").eqNullSafe(F.col("f_shape")))
        | (F.col("min_rank").isNotNull() & (F.coalesce(F.size("f_shape"), F.lit(0)) < F.col("min_rank")))
        | (F.col("max_last_dim").isNotNull() & (F.coalesce(last, F.lit(1 << 62)) > F.col("max_last_dim")))
    )
    codes = F.array_compact(
        F.array(
            F.when(~here, F.lit("READINESS_FEATURE_MISSING")),
            F.when(here & F.col("dtype").isNotNull() & ~F.col("dtype").eqNullSafe(F.col("f_dtype")), F.lit("READINESS_FEATURE_DTYPE_MISMATCH")),
            F.when(here & shape, F.lit("READINESS_FEATURE_SHAPE_MISMATCH")),
            F.when(here & F.col("action_dim").isNotNull() & ~last.eqNullSafe(F.col("action_dim")), F.lit("READINESS_ACTION_DIMENSION_MISMATCH")),
            F.when(here & F.col("normalization").isNotNull() & ~F.col("normalization").eqNullSafe(F.col("f_norm")), F.lit("READINESS_NORMALIZATION_MISMATCH")),
            F.when(here & F.col("deltas").isNotNull() & ~F.col("deltas").eqNullSafe(F.col("f_deltas")), F.lit("READINESS_DELTA_HORIZON_MISMATCH")),
        )
    )
    return both.select("feature", F.explode(codes).alias("code"))


def feature_groups(groups: DataFrame, features: DataFrame) -> DataFrame:
    """Groups (name, pattern, minimum) with fewer matching features than the minimum; groups are a short configured list."""
    matches = features.select("feature").distinct()
    out = None
    for g in groups.collect():
        n = matches.where(F.col("feature").rlike(glob_regex(g["pattern"]))).agg(F.count(F.lit(1)).alias("n"))
        row = n.select(F.lit(g["name"]).alias("name"), F.lit(g["pattern"]).alias("pattern"), F.lit(g["minimum"]).cast("long").alias("minimum"), "n")
        out = row if out is None else out.unionByName(row)
    if out is None:
        return groups.select("name", "pattern", F.col("minimum").cast("long").alias("minimum"), F.lit(0).cast("long").alias("n")).limit(0)
    return out.where("n < minimum")


def format_gates(facts: DataFrame, formats: list[str], adapters: list[str], versions: list[str]) -> DataFrame:
    """Failed format gates of facts (input_format, adapter, version); an empty list of versions admits all."""
    codes = F.array_compact(
        F.array(
            F.when(~F.col("input_format").isin(formats), F.lit("READINESS_FORMAT_INCOMPATIBLE")),
            F.when(~F.col("adapter").isin(adapters), F.lit("READINESS_ADAPTER_INCOMPATIBLE")),
            F.when(F.lit(bool(versions)) & ~F.coalesce(F.col("version").isin(versions), F.lit(False)), F.lit("READINESS_DATASET_VERSION_INCOMPATIBLE")),
        )
    )
    return facts.select(F.explode(codes).alias("code"))


def metadata_gates(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required metadata keys (key, severity) that `present` (key, value) lacks or leaves empty."""
    given = present.where("value IS NOT NULL AND trim(value) <> ''").select("key").distinct()
    return required.join(given, "key", "left_anti").select(F.lit("READINESS_METADATA_MISSING").alias("code"), "key", "severity")


def revision_gate(sources: DataFrame) -> DataFrame:
    """Remote sources that are not pinned to a 40-digit commit."""
    return sources.where("kind = 'hub' AND NOT coalesce(resolved_revision RLIKE '^[0-9a-f]{40}$', false)").withColumn("code", F.lit("READINESS_HUB_REVISION_UNPINNED"))


def coverage_gaps(required: DataFrame, coverage: DataFrame) -> DataFrame:
    """Required capabilities (capability, minimum) that are not complete or not checked deeply enough."""
    both = required.join(F.broadcast(coverage), "capability", "left")
    enough = (F.col("status") == "complete") & (rank("integrity", INTEGRITY) >= rank("minimum", INTEGRITY)) & F.col("integrity").isin(*INTEGRITY)
    return both.where(~F.coalesce(enough, F.lit(False))).select("capability", "minimum", "status", "integrity")


def status(blockers: DataFrame, missing: DataFrame) -> DataFrame:
    """BLOCKED with any blocker, else PARTIAL with any gap, else READY."""
    b, m = blockers.agg(F.count(F.lit(1)).alias("blockers")), missing.agg(F.count(F.lit(1)).alias("gaps"))
    return b.join(F.broadcast(m)).select("blockers", "gaps", F.when(F.col("blockers") > 0, "BLOCKED").when(F.col("gaps") > 0, "PARTIAL").otherwise("READY").alias("status"))
