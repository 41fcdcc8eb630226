"""Budgets, snapshots, canonical encodings and artifacts."""

from __future__ import annotations

import hashlib
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from framewright.functions import canonical
from framewright.operators import remote, snapshot
from framewright.operators.sequence import at_even_places, even_places
from framewright.plans import render


def plan_inputs(spark):
    relations = spark.createDataFrame([("data", k, f"data/{k // 2}.parquet", None) for k in range(8)] + [("video", k, f"videos/{c}/{k // 4}.mp4", c) for k in range(8) for c in ("a", "b")], "kind string, episode_index long, path string, feature_key string")
    inventory = spark.createDataFrame([(f"data/{k}.parquet", 10) for k in range(4)] + [(f"videos/{c}/{k}.mp4", 100) for c in ("a", "b") for k in range(2)], "path string, size_bytes long")
    return relations, inventory, spark.createDataFrame([(k,) for k in range(8)], "episode_index long")


def test_plan_stays_within_each_budget(spark):
    r, i, e = plan_inputs(spark)
    full = remote.payload_plan(r, i, e)
    assert {(x["kind"], x["status"]) for x in remote.coverage(full).collect()} == {("data", "complete"), ("video", "complete")}
    tight = remote.payload_plan(r, i, e, remote.Budget(bytes=250, shards=3, media=4))
    got = {x["path"]: x["state"] for x in tight.collect()}
    assert sum(s == "selected" for p, s in got.items() if p.startswith("data")) == 3
    assert sum(s == "selected" for p, s in got.items() if p.startswith("videos")) == 2
    assert {x["path"] for x in remote.fetched(tight, i.limit(0)).where("NOT there").collect()} == {p for p, s in got.items() if s == "selected"}
    unknown = i.withColumn("size_bytes", F.when(F.col("path") != "data/1.parquet", F.col("size_bytes")))
    assert remote.payload_plan(r, unknown, e).where("state = 'selected'").count() == 1
    assert remote.sampled_episodes(e, remote.Budget(episodes=3)).count() == 3


def test_large_samples_put_no_places_into_the_plan(spark):
    for n, k in ((10, 3), (11, 5), (9, 4), (1000, 999), (1001, 501), (7, 1), (50, 2), (50, 50), (5, 0)):
        got = spark.range(n).where(at_even_places(F.col("id"), n, k)).collect()
        assert sorted(r["id"] for r in got) == even_places(n, k), (n, k)
    e = spark.range(5000).select(F.col("id").alias("episode_index"))
    chosen = remote.sampled_episodes(e, remote.Budget(episodes=2500))
    assert len(chosen._jdf.queryExecution().analyzed().toString()) < 10_000
    assert sorted(r[0] for r in chosen.collect()) == even_places(5000, 2500)


def test_sources_and_patterns(spark):
    df = spark.createDataFrame([("hf://datasets/o/n@" + "a" * 40,), ("hf://datasets/o/n",), ("https://x/y",), ("hf://datasets/o/n?token=1",)], "source string")
    assert [(r["owner"], r["revision"] is not None, r["pinned"]) for r in remote.parse_sources(df).collect()] == [("o", True, True), ("o", False, False), (None, False, False), (None, False, False)]
    inv = spark.createDataFrame([("meta/info.json", 1), ("data/x.parquet", 2), ("data/x.parquet", 3)], "path string, size_bytes long")
    assert remote.allowed(inv, ["meta/*"]).count() == 1 and remote.conflicting_sizes(inv).first()["path"] == "data/x.parquet"
    card = spark.createDataFrame([("license", "mit"), ("tags", "")], "key string, value string")
    assert {r["key"] for r in remote.missing_publication(card).collect()} == {"pretty_name", "tags", "task_categories"}


def test_suppression_of_what_was_not_fetched(spark):
    found = spark.createDataFrame([("LEROBOT_DATA_MISSING", "data/1"), ("LEROBOT_DATA_MISSING", "data/9"), ("LEROBOT_VIDEO_COUNT_MISMATCH", None), ("OTHER", "data/1")], "code string, path string")
    plan = spark.createDataFrame([("data/1", "budget"), ("data/2", "selected")], "path string, state string")
    assert sorted((r["code"], r["path"]) for r in remote.suppressed(found, plan).collect()) == [("LEROBOT_DATA_MISSING", "data/9"), ("OTHER", "data/1")]
    assert remote.suppressed(found, plan.where("state = 'selected'")).count() == 4


def test_total_cascades(spark):
    eps = spark.createDataFrame([(0, 3), (1, None)], "episode_index long, length long")
    tasks = spark.createDataFrame([(0,)], "task_index long")
    inv = spark.createDataFrame([("metadata", 5), ("data", None)], "kind string, size_bytes long")
    declared = spark.createDataFrame([("frames", 9)], "name string, declared long")
    feet = spark.createDataFrame([(4,), (5,)], "num_rows long")
    of = lambda *a, **k: {r["name"]: r["value"] for r in snapshot.totals(*a, **k).collect()}
    a = of(eps, feet, tasks, inv, declared, 3.0)
    assert (a["frames"], a["duration_seconds"], a["size_bytes"], a["data_shards"]) == (9, 3, None, 1)
    assert of(eps, None, tasks, inv, declared, None)["frames"] == 9 and of(eps.where("length > 0"), None, tasks, inv, declared, None)["frames"] == 3
    assert of(eps, None, tasks, inv, declared.limit(0), None)["frames"] == 0


def test_fingerprints_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([("tasks", str(k), f"r{k}") for k in range(30)] + [("features", "a", "x")], "component string, key string, row string")
    a = {tuple(r) for r in snapshot.fingerprints(rows).collect()}
    assert a == {tuple(r) for r in snapshot.fingerprints(rows.repartition(5).orderBy(F.desc("key"))).collect()} and len(a) == 3
    assert a != {tuple(r) for r in snapshot.fingerprints(rows.where("key <> '3'")).collect()}


def test_small_facts(spark):
    videos = spark.createDataFrame([(30.0,), (30.0,)], "fps double")
    assert snapshot.single_fps(None, videos).first()["fps"] == 30 and snapshot.single_fps(10, videos).first()["fps"] == 10
    cov = spark.createDataFrame([("complete", "full"), ("partial", "metadata"), ("unavailable", "full")], "status string, integrity string")
    assert [r[0] for r in cov.select(snapshot.evidence_level()).collect()] == ["sample_verified", "metadata_verified", "official_claim"]


def test_typed_form(spark):
    value = {"b": [None, True, False, 3, 3.0, -0.5, "é"], "a": {"z": [], "é": {}, "y": 1e15}}
    want = '["object",[["a",["object",[["y",["number","integer","1000000000000000"]],["z",["array",[]]],["é",["object",[]]]]]],["b",["array",[["null"],["bool","true"],["bool","false"],["number","integer","3"],["number","integer","3"],["number","float64","bfe0000000000000"],["string","é"]]]]]]'
    assert canonical.typed_text(value) == want and json.loads(want)[0] == "object"
    assert canonical.typed_digest(value) == hashlib.sha256(want.encode()).hexdigest()
    assert canonical.typed_digest(1) == canonical.typed_digest(1.0) != canonical.typed_digest(True)
    for bad in (math.nan, 1 << 60, 1e300, {1: 2}, "\ud800", {1}, {"a": -math.inf}):
        with pytest.raises(ValueError):
            canonical.typed_text(bad)
    deep = []
    for _ in range(50_000):
        deep = [deep]
    assert canonical.typed_text(deep).count("array") == 50_001
    texts = spark.createDataFrame([('{"a": 1.0}',), ('{"a": 1}',), ("nope",), ("NaN",), (None,)], "t string")
    got = [r[0] for r in texts.select(canonical.typed_digests(F.col("t"))).collect()]
    assert got == [canonical.typed_digest({"a": 1})] * 2 + [None] * 3
    assert canonical.same_json({"a": 1, "b": [True]}, {"b": [True], "a": 1}) and not canonical.same_json(1, True) and not canonical.same_json(1, 1.0)
    assert canonical.plain_json({"b": math.inf, "a": [math.nan]}) == '{"a":["NaN"],"b":"Infinity"}'


def test_tree_digest(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_text("1")
    one = canonical.tree_digest(str(tmp_path))
    (tmp_path / "a/x").write_text("2")
    assert canonical.tree_digest(str(tmp_path)) != one
    (tmp_path / "a/x").write_text("1")
    assert canonical.tree_digest(str(tmp_path)) == one
    os.symlink("x", tmp_path / "a/l")
    assert canonical.tree_digest(str(tmp_path)) != one


def test_large_reports_are_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(render, "REPORT_ROWS", 10)
    rows = [{"code": f"C{n:02}", "severity": "error" if n % 3 else "info"} | ({} if n % 2 else {"path": "p"}) for n in range(25)]
    found = spark.createDataFrame([(r["code"], r["severity"], r.get("path")) for r in rows], "code string, severity string, path string").repartition(3).orderBy("code")
    path, head = str(tmp_path / "report/audit.json"), {"summary": {"error": 16, "warning": 0, "info": 9}, "accepted": False}
    assert render.write_audit(found, path) == head
    with open(path) as f:
        assert json.load(f) == head | {"findings": rows}
    assert render.write_audit(found.limit(0), str(tmp_path / "report/none.json"))["accepted"]
    with open(tmp_path / "report/none.json") as f:
        assert json.load(f)["findings"] == []
    few = found.limit(10)
    render.write_audit(few, str(tmp_path / "report/few.json"))
    with open(tmp_path / "report/few.json") as f:
        assert json.load(f) == render.audit_json(few)


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "deep/out.json")
    found = spark.createDataFrame([("C", "error", None), ("D", "info", "p")], "code string, severity string, path string")
    render.write_json(path, render.audit_json(found))
    with open(path) as f:
        assert json.load(f) == {"accepted": False, "summary": {"error": 1, "warning": 0, "info": 1}, "findings": [{"code": "C", "severity": "error"}, {"code": "D", "severity": "info", "path": "p"}]}
    assert os.listdir(tmp_path / "deep") == ["out.json"]
    assert "BLOCKED" in render.readiness_markdown("BLOCKED", [{"code": "X", "feature": "f"}], [])
