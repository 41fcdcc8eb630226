"""Artifacts at the edge: JSON, CSV and Markdown of result frames, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.canonical import _plain
from framewright.session import materialised
from framewright.sources import staged

#: Rows that an artifact takes; a report is read by people, tables are written with Spark.
REPORT_ROWS = 100_000


def write_text(path: str, content: str) -> None:
    """Writes beside `path` and renames, so readers see the old or the new file."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".writing-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(content)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(_plain(value), indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def report_rows(df: DataFrame) -> list[dict]:
    """The rows of a report; more than REPORT_ROWS are an error, not a silent cut."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows: write the frame as a table instead")
    return [r.asDict(recursive=True) for r in rows]


def audit_summary(found: DataFrame) -> dict:
    """Findings of each severity, counted by Spark, and whether none is an error."""
    counts = {r["severity"]: r["n"] for r in found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    summary = {s: counts.get(s, 0) for s in ("error", "warning", "info")}
    return {"summary": summary, "accepted": summary["error"] == 0}


def audit_json(found: DataFrame) -> dict:
    """The report of an audit in memory; for more than REPORT_ROWS findings there is `write_audit`."""
    rows = report_rows(found)
    return audit_summary(found) | {"findings": [{k: v for k, v in r.items() if v is not None} for r in rows]}


def write_audit(found: DataFrame, target: str) -> dict:
    """The same report, of however many findings, as one JSON file on any file system that Spark writes; gives the summary. Tasks write the findings, in their order."""
    spark = found.sparkSession
    kept = materialised(found.withColumn("_id", F.monotonically_increasing_id()), "report")
    head = audit_summary(kept)
    first = kept.agg(F.min("_id")).first()[0]
    rows = kept.orderBy("_id").select(F.concat(F.when(F.col("_id") == first, "").otherwise(","), F.to_json(F.struct(*[F.col(f"`{c}`") for c in found.columns]))).alias("value"))
    line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    staged.as_text(line(json.dumps(head)[:-1] + ', "findings": [').union(rows).union(line("]}")), target)
    return head


def readiness_markdown(status: str, blockers: list[dict], gaps: list[dict]) -> str:
    lines = [f"# Readiness: {status}", "", f"{len(blockers)} blockers, {len(gaps)} gaps in coverage.", ""]
    lines += ["| Code | About |", "| --- | --- |", *(f"| {b['code']} | {b.get('feature') or b.get('key') or ''} |" for b in blockers)] if blockers else []
    return "\n".join(lines) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
