"""Rules of others, readiness profiles, merge and repair checks."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from framewright import model
from framewright.operators import diff, media, merge, repair
from framewright.plans import profiles, rules
from framewright.sources import lerobot
from tests.test_sources import FEATURES, put, v30  # noqa: F401

COVERAGE = "capability string, status string, integrity string"


def test_rules_run_when_covered(spark):
    pack = rules.Rules()
    pack.add(rules.Rule("LEROBOT_TASK_COUNT_MISMATCH", lambda f: model.findings(f["t"], "LEROBOT_TASK_COUNT_MISMATCH"), (("meta", "metadata", "available"),)))
    pack.add(rules.Rule("LEROBOT_NUMERIC_NON_FINITE", lambda f: model.findings(f["t"], "LEROBOT_NUMERIC_NON_FINITE"), (("rows", "full", "complete"),)))
    pack.add(rules.Rule("VIDEO_INVALID_FPS", lambda f: model.findings(f["t"], "VIDEO_INVALID_FPS"), applies_to=("video",)))
    with pytest.raises(ValueError):
        pack.add(rules.Rule("VIDEO_INVALID_FPS", lambda f: f["t"]))
    coverage = spark.createDataFrame([("meta", "complete", "metadata"), ("rows", "partial", "sample")], COVERAGE)
    found, skipped = pack.run(spark, {"t": spark.range(1)}, coverage)
    assert [(r["code"], r["layer"]) for r in found.collect()] == [("LEROBOT_TASK_COUNT_MISMATCH", "alignment")]
    assert [tuple(r) for r in skipped.collect()] == [("LEROBOT_NUMERIC_NON_FINITE", "rows")]
    found, _ = pack.run(spark, {"t": spark.range(2)}, coverage, "video")
    assert sorted(r["code"] for r in found.collect()) == ["LEROBOT_TASK_COUNT_MISMATCH", "VIDEO_INVALID_FPS"]


def test_coverage_takes_the_most_direct_source(spark):
    schema = "capability string, status string, integrity string, checked int, total int"
    a = spark.createDataFrame([("rows", "failed", "full", 9, 4)], schema)
    b = spark.createDataFrame([("rows", "complete", "full", 4, 4), ("meta", "complete", "metadata", 1, 1)], schema)
    got = {r["capability"]: (r["status"], r["checked"]) for r in rules.inferred_coverage(a, b, b.limit(0)).collect()}
    assert got == {"rows": ("unavailable", 4), "meta": ("complete", 1)}


def test_profiles_are_strict(spark):
    for bad in ("[]", '{"unknown": 1}', '{"formats": "x"}', '{"features": {"a": {"min_rank": true}}}', '{"features": {"a": {"deltas": [NaN]}}}', '{"groups": [{"name": 1}]}'):
        with pytest.raises(ValueError):
            profiles.load(bad)


def test_readiness_of_a_bundle(spark, v30):  # noqa: F811
    b = lerobot.read(spark, v30)
    profile = profiles.load(json.dumps({"name": "p", "features": {"action": {"dtype": "float32", "shape": [2]}, "cam": {"min_rank": 3}}, "groups": [{"name": "cams", "pattern": "ca*", "minimum": 1}], "versions": ["3.0"], "capabilities": {"data.rows": "full"}}))
    clean = spark.createDataFrame([], model.FINDING)
    coverage = spark.createDataFrame([("data.rows", "complete", "full")], COVERAGE)
    status, _, _ = profiles.evaluate(spark, profile, b, clean, coverage)
    assert status.first()["status"] == "READY"
    assert profiles.evaluate(spark, profile, b, clean, coverage.limit(0))[0].first()["status"] == "PARTIAL"
    hard = profile | {"features": {"state": {}, "action": {"dtype": "float64"}}, "metadata": {"license": "error"}, "versions": ["2.1"]}
    status, blockers, _ = profiles.evaluate(spark, hard, b, clean, coverage)
    assert status.first()["status"] == "BLOCKED"
    assert sorted(r["code"] for r in blockers.collect()) == ["READINESS_DATASET_VERSION_INCOMPATIBLE", "READINESS_FEATURE_DTYPE_MISMATCH", "READINESS_FEATURE_MISSING", "READINESS_METADATA_MISSING"]


def test_merge_checks(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    one = lambda d: d.first()["status"]
    assert [one(merge.format_check(df([(k,) for k in v], "major int"))) for v in ([3, 3], [2, 3], [3, None], [4, 3])] == ["direct", "transform_required", "unknown", "incompatible"]
    streams = df([("a", "top", 30.0, "4x4", "h"), ("b", "top", 30.0, "8x8", "h"), ("a", "side", 30.0, "4x4", "h"), ("b", "fps", 10.0, "4x4", "h"), ("a", "fps", 20.0, "4x4", "h")], "source string, camera string, fps double, resolution string, codec string")
    assert {r["camera"]: r["status"] for r in merge.timing_check(streams).collect()} == {"top": "transform_required", "side": "incompatible", "fps": "incompatible"}
    control = df([("a", "action", "frame", "base"), ("b", "action", "frame", "tool"), ("a", "action", "norm", "m"), ("b", "action", "norm", None)], "source string, feature string, key string, value string")
    assert {r["key"]: r["status"] for r in merge.coordinates_check(control).collect()} == {"frame": "incompatible", "norm": "unknown"}
    assert sorted(r["status"] for r in merge.lineage_check(df([("x", "a" * 40), ("x", "a" * 40), ("y", None), ("z", "b" * 40)], "identity string, revision string")).collect()) == ["direct", "incompatible", "unknown"]
    tasks = df([("a", 0, "pick"), ("a", 1, "pick"), ("b", 0, "place")], "source string, task_index long, task string")
    bad = merge.task_check(tasks, df([("a", "pick"), ("b", "sing")], "source string, task string"))
    assert sorted((r["source"], r["reason"]) for r in bad.collect()) == [("a", "duplicate_text"), ("b", "undeclared")]
    assert sorted({(r["task"], r["merged_index"]) for r in merge.task_remap(tasks).collect()}) == [("pick", 0), ("place", 1)]
    assert [one(merge.verification(df(r, "check string, status string"))) for r in ([], [("a", "passed")], [("a", "passed"), ("b", "failed")])] == ["unverified", "passed", "failed"]


def test_repair_refuses_and_grades(spark):
    plan = spark.createDataFrame([("/total_frames", 1, 2), ("/fps", 1, 2), ("/total_tasks", 1, -1), ("/total_videos", 1, 3), ("/total_videos", 1, 4)], "pointer string, before long, after long")
    assert sorted((r["pointer"], r["reason"]) for r in repair.refused(plan).collect()) == [("/fps", "pointer"), ("/total_tasks", "value"), ("/total_videos", "repeated"), ("/total_videos", "repeated")]
    now = spark.createDataFrame([("/total_frames", 7)], "pointer string, declared long")
    assert repair.stale(plan.limit(1), now).count() == 1
    left = spark.createDataFrame([("LEROBOT_EPISODE_RANGE_GAP", "error"), ("X", "error"), ("LEROBOT_STATS_MISSING", "warning")], "code string, severity string")
    assert [r["risk"] for r in repair.unresolved(left).orderBy("code").collect()] == ["high", "low", "medium"]


def test_fact_changes_and_regressions(spark):
    facts = lambda rows: spark.createDataFrame(rows, "component string, name string, value string")
    changes = diff.facts(facts([("format", "adapter", "a"), ("source", "revision", "1"), ("coverage", "rows", "complete")]), facts([("format", "adapter", "b"), ("source", "revision", "2"), ("coverage", "rows", "partial")]))
    assert sorted((r["component"], r["kind"], r["class"]) for r in changes.collect()) == [("coverage", "changed", "non_breaking"), ("format", "adapter_changed", "breaking"), ("source", "revision_changed", "material")]
    assert diff.regressions(changes).count() == 1


def test_media_helpers(spark):
    rows = spark.createDataFrame([("a", 4, 4, 10.0, 20, 2.0, 5, True), ("b", 0, 4, 10.0, 20, 2.0, 5, None), ("c", 4, 4, 10.0, 20, 2.0, 5, False)], "path string, width int, height int, fps double, frame_count int, duration double, size_bytes long, decode_valid boolean")
    assert tuple(media.scan_summary(rows).first()) == (3, 1, 20, 2.0, 5, 1)
    files = spark.createDataFrame([("videos/cam/episode_000003.mp4",), ("videos/other/episode_000003.mp4",), ("videos/cam/episode_000004.mp4",)], "path string")
    got = media.match_episode_files(spark.createDataFrame([(3,)], "episode_index long"), files, spark.createDataFrame([("cam",)], "feature_key string"))
    assert [tuple(r) for r in got.collect()] == [(3, "cam", "videos/cam/episode_000003.mp4")]
    probed = media.probe(files.withColumn("uri", F.lit("file:/nowhere.mp4")))
    assert {r["error"] for r in probed.collect()} <= {"no decoder", "cannot open"}


def test_command_line(spark, v30, tmp_path):  # noqa: F811
    from framewright import cli

    out, profile = str(tmp_path / "out.json"), str(tmp_path / "profile.json")
    assert cli.main(["audit", v30, "--output", out]) == 2
    with open(out) as f:
        assert {x["code"] for x in json.load(f)["findings"]} == {"LEROBOT_FEATURE_COLUMN_MISSING", "LEROBOT_VIDEO_RELATION_MISSING"}
    assert cli.main(["diff", v30, v30, "--output", out]) == 0
    with open(profile, "w") as f:
        json.dump({"features": {"action": {}}, "capabilities": {"data.rows": "full"}}, f)
    assert cli.main(["readiness", v30, "--profile", profile, "--output", out]) == 2
    with open(out) as f:
        assert json.load(f)["status"] == "BLOCKED"
    with pytest.raises(SystemExit):
        cli.main(["diff", v30, "--output", out])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["frame_audit", "episode_findings"])
def test_audits_take_more_tasks_for_more_input(spark, monkeypatch, name):
    from framewright.plans import catalog

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = lambda: catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions()
        monkeypatch.setattr("framewright.session.PIECE", 16 << 10, raising=False)
        small = tasks()
        monkeypatch.setattr("framewright.session.PIECE", 8 << 10, raising=False)
        assert tasks() > 1.8 * small > 1.8 * 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
