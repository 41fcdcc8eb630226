"""Receipts of a merge: the checks after it as one relation, their verdict, and a fingerprinted record."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.canonical import plain_json
from framewright.operators import merge

CHECK = "check string, status string, detail string"

#: What callers hand in: each takes the merged folder and gives a frame or a value; None leaves its check unverified.
Runner = Callable[[str], object]


def _row(df: DataFrame, name: str, status, detail) -> DataFrame:
    return df.select(F.lit(name).alias("check"), status.alias("status"), detail.cast("string").alias("detail"))


def _bad_rows(name: str, bad: DataFrame) -> DataFrame:
    """passed without rows in `bad`, else failed with their number."""
    n = bad.agg(F.count(F.lit(1)).alias("n"))
    return _row(n, name, F.when(F.col("n") == 0, "passed").otherwise("failed"), F.col("n"))


def post_merge_checks(decision: DataFrame, audit: DataFrame | None, loader: DataFrame | None, lineage: DataFrame, reconciled: DataFrame, regressions: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """The seven checks after a merge as CHECK.

    decision as `merge.decision`; audit findings and loader (name, status) or None where nothing ran; lineage (identity, status); reconciled and regressions rows that
    differ; fingerprint (name, wanted, found) of the snapshot made after the merge.
    """
    spark = decision.sparkSession
    pre = F.when(F.col("decision") == "direct", "passed").when(F.col("decision") == "unknown", "unverified").otherwise("failed")
    out = _row(decision, "premerge_compatibility", pre, F.col("decision"))
    out = out.unionByName(_bad_rows("post_snapshot", fingerprint.where("NOT wanted <=> found")))
    skipped = lambda name: spark.createDataFrame([(name, "unverified", None)], CHECK)
    out = out.unionByName(skipped("full_audit") if audit is None else _bad_rows("full_audit", audit.where("severity = 'error'")))
    if loader is None:
        out = out.unionByName(skipped("loader_smoke"))
    else:
        worst = loader.agg(F.count_if(F.col("status") == "failed").alias("bad"), F.count_if(F.col("status") == "passed").alias("good"))
        out = out.unionByName(_row(worst, "loader_smoke", F.when(F.col("bad") > 0, "failed").when(F.col("good") > 0, "passed").otherwise("unverified"), F.col("bad")))
    known = lineage.agg(F.count_if(F.col("status") == "incompatible").alias("bad"), F.count_if(F.col("status") == "unknown").alias("open"))
    out = out.unionByName(_row(known, "lineage", F.when(F.col("bad") > 0, "failed").when(F.col("open") > 0, "unverified").otherwise("passed"), F.col("bad") + F.col("open")))
    return out.unionByName(_bad_rows("semantic_reconciliation", reconciled)).unionByName(_bad_rows("semantic_diffs", regressions))


def run(spark: SparkSession, merged: str, name: str, runner: Runner | None) -> DataFrame | None:
    """What a caller's runner says about the merged folder as (name, status): a frame as it is, a boolean as passed or failed, an exception as failed, no runner as None."""
    if runner is None:
        return None
    try:
        found = runner(merged)
    except Exception as e:  # noqa: BLE001 a loader may raise anything; its failure is the result
        return spark.createDataFrame([(f"{name}: {type(e).__name__}", "failed")], "name string, status string")
    if isinstance(found, DataFrame):
        return found
    return spark.createDataFrame([(name, "passed" if found is True else "unverified" if found is None else "failed")], "name string, status string")


def receipt(checks: DataFrame, inputs: list[str], merged: str) -> dict:
    """The record of a verification: verified only if every check passed; its fingerprint covers everything else in it."""
    rows = [r.asDict() for r in checks.orderBy("check").collect()]  # one row per check
    verdict = merge.verification(checks).first()["status"]
    body = {"inputs": sorted(inputs), "merged": merged, "status": "verified" if verdict == "passed" else "unverified", "summary": {s: sum(r["status"] == s for r in rows) for s in ("passed", "failed", "unverified")}, "checks": rows}
    return body | {"fingerprint": hashlib.sha256(plain_json(body).encode()).hexdigest()}
