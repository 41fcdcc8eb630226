"""Rules that others add: a rule is a function from named frames to findings, and runs when its capabilities are covered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import model
from framewright.operators import findings

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    code: str
    evaluate: Callable[[Frames], DataFrame]
    needs: tuple[tuple[str, str, str], ...] = ()  # (capability, least integrity, complete or available)
    applies_to: tuple[str, ...] = ("*",)


@dataclass
class Rules:
    """A pack of rules; a code may be registered once."""

    known: dict[str, Rule] = field(default_factory=dict)

    def add(self, rule: Rule) -> Rule:
        if rule.code in self.known:
            raise ValueError(f"{rule.code} is registered already")
        self.known[rule.code] = rule
        return rule

    def requirements(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = [(r.code, *n) for r in self.known.values() if "*" in r.applies_to or kind in r.applies_to for n in r.needs]
        return spark.createDataFrame(rows, "rule string, capability string, minimum string, need string")

    def run(self, spark: SparkSession, frames: Frames, coverage: DataFrame, kind: str = "lerobot", seed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(findings, skipped): the rules that apply and whose needs are met, with seed findings; skipped has rule and missing capabilities.

        Which rules run is decided on the driver from as many rows as there are rules.
        """
        gated = {r["rule"]: r for r in findings.gate(self.requirements(spark, kind), coverage).collect()}
        found = seed if seed is not None else spark.createDataFrame([], model.FINDING)
        skipped = []
        for rule in self.known.values():
            if "*" not in rule.applies_to and kind not in rule.applies_to:
                continue
            state = gated.get(rule.code)
            if state is not None and state["state"] == "skip":
                skipped.append((rule.code, state["missing"]))
            else:
                found = found.unionByName(rule.evaluate(frames))
        enriched = findings.enrich(found, model.registry(spark))
        return findings.ordered(findings.deduplicated(enriched, ["code", "path", "episode_index", "frame_index", "feature_key", "location", "evidence"], ["layer", "code"])), spark.createDataFrame(skipped, "rule string, missing string")


def inferred_coverage(validated: DataFrame, adapter: DataFrame, base: DataFrame) -> DataFrame:
    """One status per capability, from validation where it has one, else from the reader, else from the prepared records.

    A status failed counts as unavailable; checked never exceeds total.
    """
    part = lambda df, k: df.select("capability", "status", "integrity", F.col("checked").cast("long").alias("checked"), F.col("total").cast("long").alias("total"), F.lit(k).alias("_k"))
    rows = part(validated, 0).unionByName(part(adapter, 1)).unionByName(part(base, 2))
    best = rows.groupBy("capability").agg(F.min_by(F.struct("status", "integrity", "checked", "total"), "_k").alias("b"))
    status = F.when(F.col("b.status") == "failed", "unavailable").otherwise(F.col("b.status"))
    return best.select("capability", status.alias("status"), "b.integrity", F.least("b.checked", "b.total").alias("checked"), "b.total")
