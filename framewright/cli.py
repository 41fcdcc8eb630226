"""python -m framewright.cli COMMAND ROOT... --output FILE: exit 0 accepted, 2 a negative verdict, 1 a failure.

scan, inspect, catalog, catalog-evidence and snapshot describe; audit, diff, readiness, merge-check, verify and verify-merge judge; repair-plan and repair-apply
repair; schema NAME and version need no data set.
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import framewright
from framewright.functions.canonical import typed_digest
from framewright.operators import diff, merge, repair, snapshot
from framewright.plans import apply, audit, profiles, receipts, render, schemas
from framewright.session import build_session
from framewright.sources import files, lerobot, metadata

Result = tuple[object, int]


def _rows(df: DataFrame) -> list[dict]:
    return render.report_rows(df)


def _footers(spark: SparkSession, b: lerobot.Bundle) -> DataFrame:
    return files.footers(spark, b.inventory.where("kind = 'data' AND path LIKE '%.parquet'"))


def _totals(spark: SparkSession, b: lerobot.Bundle) -> dict[str, float]:
    fps = (b.info.select("fps").first() or [None])[0]
    return {r["name"]: r["value"] for r in snapshot.totals(b.episodes, _footers(spark, b), b.tasks, b.inventory, metadata.declared_totals(b.info), fps).collect()}


def scan(spark: SparkSession, given) -> Result:
    """Files and bytes of each kind and stream."""
    listed = files.inventory(spark, given.roots[0])
    return {"format": files.detect_format(listed), "files": _rows(listed.groupBy("kind", "stream").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")).orderBy("kind", "stream"))}, 0


def inspect(spark: SparkSession, given) -> Result:
    """What a data set declares, what it holds, and its findings of metadata."""
    b = lerobot.read(spark, given.roots[0])
    return {"version": b.version, "info": _rows(b.info.drop("features")), "features": _rows(b.features.orderBy("feature")), "tasks": _rows(b.tasks.orderBy("task_index")), "totals": _totals(spark, b), "findings": _rows(b.findings)}, 0


def audited(spark: SparkSession, given) -> Result:
    result = render.audit_json(audit.audit(spark, given.roots[0], given.integrity))
    return result, 0 if result["accepted"] else 2


def catalog(spark: SparkSession, given) -> Result:
    """One row of totals for each data set; as CSV where the output's name ends so."""
    rows = []
    for root in given.roots:
        b = lerobot.read(spark, root)
        rows.append({"root": root, "version": b.version, **_totals(spark, b)})
    if not given.output.endswith(".csv"):
        return rows, 0
    text = io.StringIO()
    table = csv.DictWriter(text, sorted({k for r in rows for k in r}))
    table.writeheader()
    table.writerows(rows)
    return text.getvalue(), 0


def catalog_evidence(spark: SparkSession, given) -> Result:
    """Facts of a data set with how well each is proven, and what no reader can settle; no score."""
    b = lerobot.read(spark, given.roots[0])
    level = {"metadata": "metadata_verified", "sample": "sample_verified", "full": "sample_verified"}[given.integrity]
    totals = _totals(spark, b)
    facts = [{"name": k, "value": v, "evidence": "official_claim" if v is None else level} for k, v in sorted(totals.items())]
    body = {"root": given.roots[0], "facts": facts, "unresolved": ["governance", "pipeline", "integrity", "profile", "license", "consent"]}
    return body | {"digest": typed_digest(facts)}, 0


def _components(b: lerobot.Bundle) -> DataFrame:
    out = None
    keys = {"features": "feature", "tasks": "task_index", "episodes": "episode_index", "video_streams": "stream", "inventory": "path"}
    for name, rows in audit.snapshot_components(b).items():
        rows = rows.drop("uri", "source_path")  # the same data set elsewhere is the same
        part = rows.select(F.lit(name).alias("component"), F.col(keys[name]).cast("string").alias("key"), F.to_json(F.struct("*")).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def _snapshot(spark: SparkSession, root: str) -> dict:
    b = lerobot.read(spark, root)
    return {"source": {"kind": "local", "locator": root}, "format": {"adapter": f"lerobot_v{b.version}"}, "totals": _totals(spark, b), "fingerprints": {r["component"]: r["fingerprint"] for r in snapshot.fingerprints(_components(b)).collect()}}


def snapshotted(spark: SparkSession, given) -> Result:
    return _snapshot(spark, given.roots[0]), 0


def compared(spark: SparkSession, given) -> Result:
    changes = audit.changes(*(lerobot.read(spark, r) for r in given.roots))
    top = diff.overall(changes).first().asDict()
    return {"overall": top, "changes": _rows(changes)}, 2 if top["class"] == "breaking" else 0


def readiness(spark: SparkSession, given) -> Result:
    with open(given.profile, encoding="utf-8") as f:
        profile = profiles.load(f.read())
    root = given.roots[0]
    rows = {"metadata": "unavailable", "sample": "partial", "full": "complete"}[given.integrity]
    coverage = spark.createDataFrame([("meta.info", "complete", given.integrity), ("data.rows", rows, given.integrity)], "capability string, status string, integrity string")
    status, blockers, gaps = profiles.evaluate(spark, profile, lerobot.read(spark, root), audit.audit(spark, root, given.integrity), coverage)
    verdict, blocking, open_gaps = status.first()["status"], _rows(blockers), _rows(gaps)
    render.write_text(f"{given.output}.md", render.readiness_markdown(verdict, [{"code": b["code"], "key": b["about"]} for b in blocking], open_gaps))
    return {"status": verdict, "blockers": blocking, "gaps": open_gaps}, 0 if verdict == "READY" else 2


def _steps(spark: SparkSession, root: str) -> list[dict]:
    b = lerobot.read(spark, root)
    videos = b.relations.where("kind = 'video' AND path_exists").select("path")
    derived = repair.derived_totals(b.episodes, _footers(spark, b).select("path", "num_rows"), b.tasks, videos)
    now = apply.read_totals(root)
    declared = spark.createDataFrame([(p, now.get(p)) for p in repair.POINTERS if isinstance(now.get(p), int) and not isinstance(now.get(p), bool)], "pointer string, declared long")
    # a total that nobody declares is not added
    return [s for s in _rows(repair.steps(declared, derived).orderBy("pointer")) if s["before"] is not None]


def repair_plan(spark: SparkSession, given) -> Result:
    steps = _steps(spark, given.roots[0])
    return (apply.plan(given.roots[0], steps) if steps else {"steps": []}), 0


def repair_apply(spark: SparkSession, given) -> Result:
    with open(given.plan, encoding="utf-8") as f:
        made = json.load(f)
    result = apply.apply(given.roots[0], made, given.to)
    return result, 0 if result["status"] == "verified" else 2


def verify(spark: SparkSession, given) -> Result:
    """A repaired data set (second root) against its source: no total left to repair, and no difference but in the metadata file."""
    left = _steps(spark, given.roots[1])
    changes = _rows(audit.changes(*(lerobot.read(spark, r) for r in given.roots)).where("path <> '/inventory_metadata/meta~1info.json'"))
    return {"status": "failed" if left or changes else "verified", "steps": left, "changes": changes}, 2 if left or changes else 0


def _merge_checks(spark: SparkSession, bundles: dict[str, lerobot.Bundle]) -> DataFrame:
    """(check, about, status) over all inputs."""
    of = lambda get: _union([get(b).withColumn("source", F.lit(name)) for name, b in bundles.items()])
    facts = spark.createDataFrame([(n, int(b.version) or None) for n, b in bundles.items()], "source string, major long")
    features = of(lambda b: b.features.select("feature", "dtype", "shape"))
    contract = of(lambda b: b.features.select("feature", F.lit("normalization").alias("key"), F.col("normalization").alias("value")))
    fps = of(lambda b: b.info.select(F.lit("fps").alias("key"), F.col("fps").cast("string").alias("value")))
    tasks = of(lambda b: b.tasks.select("task_index", "task"))
    references = of(lambda b: b.episodes.select(F.explode_outer("tasks").alias("task")).where("task IS NOT NULL"))
    lineage = spark.createDataFrame([(r, _tree(r)) for r in bundles], "identity string, revision string")
    parts = [
        merge.format_check(facts).select("check", F.lit("all").alias("about"), "status"),
        merge.feature_check(features).select(F.lit("features").alias("check"), F.col("feature").alias("about"), "status"),
        merge.coordinates_check(contract).where("status = 'incompatible'").select(F.lit("coordinates").alias("check"), F.col("feature").alias("about"), "status"),
        merge.agreement(fps, "key", "value").select(F.lit("timing").alias("check"), F.col("key").alias("about"), "status"),
        merge.task_check(tasks, references).select(F.lit("tasks").alias("check"), F.col("task").alias("about"), F.lit("incompatible").alias("status")),
        lineage.groupBy("revision").agg(F.min("identity").alias("about"), F.count(F.lit(1)).alias("n")).select(F.lit("duplicates").alias("check"), "about", F.when(F.col("n") > 1, "incompatible").otherwise("direct").alias("status")),
    ]
    return _union(parts)


def _tree(root: str) -> str:
    from framewright.functions.canonical import tree_digest

    return tree_digest(root)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_check(spark: SparkSession, given) -> Result:
    checks = _merge_checks(spark, {r: lerobot.read(spark, r) for r in given.roots})
    decision = merge.decision(checks).first()["decision"]
    return {"decision": decision, "checks": _rows(checks.orderBy("check", "about"))}, 0 if decision == "direct" else 2


def verify_merge(spark: SparkSession, given) -> Result:
    """The first root is the merged data set, the others its inputs in order; episodes are compared by their place in that order."""
    merged, inputs = given.roots[0], given.roots[1:]
    bundles = {r: lerobot.read(spark, r) for r in inputs}
    after = lerobot.read(spark, merged)
    place = lambda b, offset: b.episodes.select((F.col("episode_index") + offset).alias("position"), "length", F.to_json(F.array_sort("tasks")).alias("tasks"))
    expected, offset = [], 0
    for b in bundles.values():
        expected.append(place(b, offset))
        offset += b.episodes.count()
    wanted = _union(expected)
    reconciled = merge.reconcile(wanted, place(after, 0), "position", ["length", "tasks"])
    regressions = _union([diff.regressions(audit.changes(b, after)) for b in bundles.values()])
    lineage = spark.createDataFrame([(r, "direct") for r in inputs], "identity string, status string")
    # without an episode of their own, counts stand in for the fingerprint that a writer would have recorded
    fingerprint = spark.createDataFrame([("episodes", str(offset), str(after.episodes.count()))], "name string, wanted string, found string")
    checks = receipts.post_merge_checks(merge.decision(_merge_checks(spark, bundles)), audit.audit(spark, merged, given.integrity), None, lineage, reconciled, regressions, fingerprint)
    r = receipts.receipt(checks, inputs, merged)
    return r, 0 if r["status"] == "verified" else 2


def schema(spark: SparkSession | None, given) -> Result:
    return schemas.schema(given.roots[0]), 0


def version(spark: SparkSession | None, given) -> Result:
    return {"framewright": framewright.__version__}, 0


#: Each with how many roots it takes: exactly, or at least (negative).
COMMANDS: dict[str, tuple[Callable, int]] = {
    "scan": (scan, 1),
    "inspect": (inspect, 1),
    "audit": (audited, 1),
    "catalog": (catalog, -1),
    "catalog-evidence": (catalog_evidence, 1),
    "snapshot": (snapshotted, 1),
    "diff": (compared, 2),
    "readiness": (readiness, 1),
    "repair-plan": (repair_plan, 1),
    "repair-apply": (repair_apply, 1),
    "verify": (verify, 2),
    "merge-check": (merge_check, -2),
    "verify-merge": (verify_merge, -2),
    "schema": (schema, 1),
    "version": (version, 0),
}
WITHOUT_DATA = ("schema", "version")
NEEDED = {"readiness": ("profile",), "repair-apply": ("plan", "to")}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framewright")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("roots", nargs="*")
    parser.add_argument("--output", required=True)
    parser.add_argument("--integrity", choices=("metadata", "sample", "full"), default="metadata")
    for option in ("profile", "plan", "to"):
        parser.add_argument(f"--{option}")
    given = parser.parse_args(args)
    run, n = COMMANDS[given.command]
    if len(given.roots) != n if n >= 0 else len(given.roots) < -n:
        parser.error(f"{given.command} takes {n if n >= 0 else f'at least {-n}'}")
    for option in NEEDED.get(given.command, ()):
        if getattr(given, option) is None:
            parser.error(f"{given.command} takes --{option}")
    result, code = run(None if given.command in WITHOUT_DATA else build_session(), given)
    if isinstance(result, str):
        render.write_text(given.output, result)
    else:
        render.write_json(given.output, result)
    return code


if __name__ == "__main__":
    try:
        sys.exit(main())
    except (OSError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        sys.exit(1)
