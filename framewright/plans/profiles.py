"""Readiness profiles: strict JSON, compiled to requirement frames and evaluated against a bundle."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import findings, gates
from framewright.sources import lerobot

FIELDS = {"name": str, "formats": list, "adapters": list, "versions": list, "features": dict, "groups": list, "metadata": dict, "capabilities": dict}
FEATURE_FIELDS = {"dtype": str, "shape": list, "min_rank": int, "max_last_dim": int, "action_dim": int, "normalization": str, "deltas": list}


def load(text: str) -> dict:
    """A profile from JSON; unknown fields, wrong types and non-standard numbers are errors."""

    def refuse(x):
        raise ValueError(f"not a JSON number: {x}")

    profile = json.loads(text, parse_constant=refuse)
    if not isinstance(profile, dict):
        raise ValueError("a profile is an object")
    _check(profile, FIELDS, "profile")
    for name, f in profile.get("features", {}).items():
        _check(f, FEATURE_FIELDS, f"feature {name}")
    for g in profile.get("groups", []):
        _check(g, {"name": str, "pattern": str, "minimum": int}, "group")
    return profile


def _check(value, fields: dict, where: str) -> None:
    if not isinstance(value, dict):
        raise ValueError(f"{where} is an object")
    for k, v in value.items():
        if k not in fields:
            raise ValueError(f"unknown field {k} in {where}")
        if not isinstance(v, fields[k]) or isinstance(v, bool):
            raise ValueError(f"{k} in {where} should be {fields[k].__name__}")


def evaluate(spark: SparkSession, profile: dict, b: lerobot.Bundle, found: DataFrame, coverage: DataFrame, card: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, blockers, gaps): errors of an audit and failed gates block, capabilities that are not covered leave gaps."""
    rows = [(name, f.get("dtype"), f.get("shape"), f.get("min_rank"), f.get("max_last_dim"), f.get("action_dim"), f.get("normalization"), f.get("deltas")) for name, f in profile.get("features", {}).items()]
    features = b.features.select("feature", "dtype", "shape", "normalization", F.lit(None).cast("array<double>").alias("deltas"))
    none = lambda df, about: df.select("code", about.alias("about"))
    blockers = none(gates.feature_gates(spark.createDataFrame(rows, gates.FEATURE_REQUIREMENT), features), F.col("feature"))
    version = b.info.select(F.lit("lerobot").alias("input_format"), F.lit(f"lerobot_v{b.version}").alias("adapter"), F.regexp_replace("codebase_version", "^v", "").alias("version"))
    if "formats" in profile or "adapters" in profile or "versions" in profile:
        failed = gates.format_gates(version, profile.get("formats", ["lerobot"]), profile.get("adapters", [f"lerobot_v{b.version}"]), profile.get("versions", []))
        blockers = blockers.unionByName(none(failed, F.lit(None).cast("string")))
    groups = [(g["name"], g["pattern"], g["minimum"]) for g in profile.get("groups", [])]
    short = gates.feature_groups(spark.createDataFrame(groups, "name string, pattern string, minimum int"), features)
    blockers = blockers.unionByName(short.select(F.lit("READINESS_FEATURE_GROUP_MISSING").alias("code"), F.col("name").alias("about")))
    need = spark.createDataFrame(list(profile.get("metadata", {}).items()), "key string, severity string")
    lacking = gates.metadata_gates(need, card if card is not None else spark.createDataFrame([], "key string, value string"))
    blockers = blockers.unionByName(lacking.where("severity = 'error'").select("code", F.col("key").alias("about")))
    blockers = blockers.unionByName(found.where("severity = 'error'").select("code", F.col("path").alias("about")))
    gaps = gates.coverage_gaps(spark.createDataFrame(list(profile.get("capabilities", {}).items()), "capability string, minimum string"), coverage)
    return gates.status(blockers, gaps), blockers, gaps


def summary(found: DataFrame) -> DataFrame:
    """Findings of each severity, for a report's head."""
    return findings.severity_summary(found)
