"""Readers over generated data sets: clean ones, and one defect at a time."""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framewright.sources import files, lerobot, metadata, staged

FEATURES = {"action": {"dtype": "float32", "shape": [2]}, "timestamp": {"dtype": "float32", "shape": [1]}, "cam": {"dtype": "video", "shape": [4, 4, 3]}}


def put(root, path, text):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def put_table(root, path, columns):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    pq.write_table(pa.table(columns), f"{root}/{path}")


@pytest.fixture
def v21(tmp_path):
    root = str(tmp_path / uuid.uuid4().hex)
    put(root, "meta/info.json", json.dumps({"codebase_version": "v2.1", "fps": 10, "total_episodes": 2, "total_frames": 7, "features": FEATURES}))
    put(root, "meta/tasks.jsonl", '{"task_index": 0, "task": "pick"}\n\n{"task_index": -1, "task": "x"}\nnot json\n')
    put(root, "meta/episodes.jsonl", '{"episode_index": 0, "length": 4, "tasks": ["pick"]}\n[1]\n{"episode_index": 1, "length": 3, "task": "pick"}\n')
    put_table(root, "data/chunk-000/episode_000000.parquet", {"episode_index": pa.array([0] * 4)})
    put(root, "videos/chunk-000/cam/episode_000000.mp4", b"v")
    return root


@pytest.fixture
def v30(tmp_path):
    root = str(tmp_path / uuid.uuid4().hex)
    put(root, "meta/info.json", json.dumps({"codebase_version": "v3.0", "fps": 10, "features": FEATURES}))
    put_table(root, "meta/tasks.parquet", {"task_index": pa.array([0, 1]), "__index_level_0__": ["pick", "place"]})
    episodes = {"episode_index": pa.array([0, 1]), "length": pa.array([2, 2]), "tasks": pa.array([["pick"], ["place"]]), "data/chunk_index": pa.array([0, 0]), "data/file_index": pa.array([0, 0]), "dataset_from_index": pa.array([0, 2]), "dataset_to_index": pa.array([2, 4])}
    episodes |= {"videos/cam/chunk_index": pa.array([0, None]), "videos/cam/file_index": pa.array([0, None]), "videos/cam/from_timestamp": pa.array([0.0, 0.2]), "videos/cam/to_timestamp": pa.array([0.2, 0.4])}
    put_table(root, "meta/episodes/chunk-000/file-000.parquet", episodes)
    action = pa.FixedSizeListArray.from_arrays(pa.array([0.0] * 8, pa.float32()), 2)
    put_table(root, "data/chunk-000/file-000.parquet", {"index": pa.array([0, 1, 2, 3]), "action": action})
    put(root, "videos/cam/chunk-000/file-000.mp4", b"v")
    return root


def codes(bundle):
    return sorted(r["code"] for r in bundle.findings.collect())


def test_v21(spark, v21):
    b = lerobot.read(spark, v21)
    assert b.version == "2"
    assert sorted((r["episode_index"], r["length"], r["tasks"], r["source_row"]) for r in b.episodes.collect()) == [(0, 4, ["pick"], 1), (1, 3, ["pick"], 3)]
    assert [r["task"] for r in b.tasks.collect()] == ["pick"]
    assert codes(b) == sorted(["LEROBOT_V21_MIGRATION_RECOMMENDED", "LEROBOT_TASK_INVALID", "LEROBOT_TASK_INVALID", "LEROBOT_EPISODE_INVALID", "LEROBOT_DATA_MISSING", "LEROBOT_VIDEO_MISSING"])
    assert {r["path"] for r in b.relations.where("kind = 'video'").collect()} == {"videos/chunk-000/cam/episode_000000.mp4", "videos/chunk-000/cam/episode_000001.mp4"}


def test_v30(spark, v30):
    b = lerobot.read(spark, v30)
    assert b.version == "3"
    assert sorted(r["task"] for r in b.tasks.collect()) == ["pick", "place"]
    data = sorted((r["episode_index"], r["dataset_from_index"], r["dataset_to_index"], r["path_exists"]) for r in b.relations.where("kind = 'data'").collect())
    assert data == [(0, 0, 2, True), (1, 2, 4, True)]
    assert codes(b) == ["LEROBOT_VIDEO_RELATION_MISSING"]
    assert {(r["feature"], r["dtype"], tuple(r["shape"])) for r in b.features.collect()} == {("action", "float32", (2,)), ("timestamp", "float32", (1,)), ("cam", "video", (4, 4, 3))}


def test_nothing_there(spark, tmp_path):
    root = str(tmp_path / "bare")
    put(root, "meta/other.txt", "x")
    assert codes(lerobot.read(spark, root)) == ["LEROBOT_EPISODES_MISSING", "LEROBOT_INFO_MISSING", "LEROBOT_TASKS_MISSING"]


@pytest.mark.parametrize(("version", "code"), [("v9.0", "LEROBOT_CODEBASE_VERSION_UNSUPPORTED"), ("v3.7", "LEROBOT_CODEBASE_VERSION_UNTESTED"), ("three", "LEROBOT_CODEBASE_VERSION_INVALID"), (None, "LEROBOT_CODEBASE_VERSION_MISSING")])
def test_versions(spark, v30, version, code):
    put(v30, "meta/info.json", json.dumps({"codebase_version": version, "features": FEATURES}))
    assert code in codes(lerobot.read(spark, v30))


def test_template_defect(spark, v30):
    put(v30, "meta/info.json", json.dumps({"codebase_version": "v3.0", "data_path": "data/{nothing}.parquet", "features": FEATURES}))
    assert "LEROBOT_DATA_PATH_TEMPLATE_INVALID" in codes(lerobot.read(spark, v30))


def test_footers_and_broken_shards(spark, v30):
    put(v30, "data/chunk-000/file-001.parquet", b"PAR1 cut off")
    put(v30, "data/chunk-000/file-002.parquet", b"PAR1 garbage PAR1")
    listed = files.inventory(spark, v30)
    found = files.footers(spark, listed.where("kind = 'data'"))
    rows = {r["path"]: r for r in found.collect()}
    good = rows["data/chunk-000/file-000.parquet"]
    assert good["num_rows"] == 4 and good["error"] is None
    assert {(c["name"], c["type"], tuple(c["shape"])) for c in good["columns"]} == {("index", "int64", ()), ("action", "float", (2,))}
    assert sorted((r["code"], r["path"]) for r in files.footer_findings(found).collect()) == [("LEROBOT_PARQUET_SCHEMA_UNREADABLE", "data/chunk-000/file-002.parquet"), ("LEROBOT_PARQUET_UNFINALIZED", "data/chunk-000/file-001.parquet")]
    assert {r["path"]: r["stream"] for r in listed.where("kind = 'media'").collect()} == {"videos/cam/chunk-000/file-000.mp4": "cam"}
    assert files.checksums(spark, listed.where("kind = 'media'")).first()["sha256"] == "4c94485e0c21ae6c41ce1dfe7b6bfaceea5ab68e40a2476f50208e526f506080"


def test_format_detection(spark, v30, tmp_path):
    assert files.detect_format(files.inventory(spark, v30)) == "lerobot"
    put(str(tmp_path / "plain"), "a/x.mp4", b"v")
    assert files.detect_format(files.inventory(spark, str(tmp_path / "plain"))) == "video"
    with pytest.raises(ValueError):
        files.detect_format(files.inventory(spark, v30), "other")


def test_symlinks(tmp_path):
    root = tmp_path / "links"
    put(str(root), "a.txt", "x")
    os.symlink(root / "a.txt", root / "in")
    os.symlink(tmp_path / "nowhere", root / "broken")
    put(str(tmp_path), "outside.txt", "x")
    os.symlink(tmp_path / "outside.txt", root / "out")
    assert files.path_policy(str(root)) == [("broken", "DATASET_SYMLINK_BROKEN"), ("in", "DATASET_SYMLINK_SKIPPED"), ("out", "DATASET_PATH_OUTSIDE_ROOT")]
    assert ("in", "DATASET_SYMLINK_SKIPPED") not in files.path_policy(str(root), follow=True)


def test_stats(spark, tmp_path):
    root = str(tmp_path / "stats")
    put(root, "stats.json", json.dumps({"stats": {"action": {"min": [0.0, 1], "max": [2, 3], "mean": [1e-5, 2], "std": [1, 1], "count": [4]}, "x": {"mean": 2.5, "count": 7}}}))
    rows = {(r["feature"], r["field"], r["dim"]): r["value"] for r in metadata.stats(spark, f"{root}/stats.json").collect()}
    assert rows["action", "mean", 0] == 1e-5 and rows["x", "mean", 0] == 2.5 and rows["x", "count", 0] == 7 and len(rows) == 11


def audited(spark, root):
    from framewright.plans.audit import audit

    return sorted((r["code"], r["episode_index"]) for r in audit(spark, root).collect())


def test_audit_of_ranges_schemas_and_totals(spark, v30):
    assert audited(spark, v30) == [("LEROBOT_FEATURE_COLUMN_MISSING", None), ("LEROBOT_VIDEO_RELATION_MISSING", 1)]
    episodes = {"episode_index": pa.array([0, 2, 2]), "length": pa.array([2, 2, 5]), "tasks": pa.array([["pick"], ["place"], ["sing"]]), "data/chunk_index": pa.array([0, 0, 0]), "data/file_index": pa.array([0, 0, 0]), "dataset_from_index": pa.array([0, 1, 9]), "dataset_to_index": pa.array([2, 3, 9])}
    put_table(v30, "meta/episodes/chunk-000/file-000.parquet", episodes)
    put(v30, "meta/info.json", json.dumps({"codebase_version": "v3.0", "fps": 10, "total_episodes": 9, "features": {"action": {"dtype": "float64", "shape": [3]}, "index": {"dtype": "int64", "shape": [1]}}}))
    found = {c for c, _ in audited(spark, v30)}
    assert found == {
        "LEROBOT_EPISODE_COUNT_MISMATCH", "LEROBOT_EPISODE_INDEX_DUPLICATE", "LEROBOT_EPISODE_INDEX_NON_CONTIGUOUS", "LEROBOT_EPISODE_RANGE_INVALID", "LEROBOT_EPISODE_RANGE_LENGTH_MISMATCH", "LEROBOT_EPISODE_RANGE_OVERLAP",
        "LEROBOT_EPISODE_RANGE_GAP", "LEROBOT_FEATURE_DTYPE_MISMATCH", "LEROBOT_FEATURE_SHAPE_MISMATCH", "LEROBOT_TASK_REFERENCE_INVALID",
    }


def test_changes_between_versions(spark, v30, v21):
    from framewright.operators import diff
    from framewright.plans.audit import changes

    a, b = lerobot.read(spark, v30), lerobot.read(spark, v21)
    assert changes(a, a).count() == 0
    found = {(r["component"], r["kind"]) for r in changes(a, b).collect()}
    assert {("tasks", "removed"), ("episodes", "content_changed"), ("inventory_data", "removed"), ("inventory_data", "added")} <= found
    assert diff.overall(changes(a, b)).first()["class"] == "material"


@pytest.fixture
def clean(v30):
    """Two episodes of two frames with statistics that hold."""
    action = pa.FixedSizeListArray.from_arrays(pa.array([0, 1, 0, 3, 2, 5, 2, 7], pa.float32()), 2)
    frames = {"index": pa.array([0, 1, 2, 3]), "episode_index": pa.array([0, 0, 1, 1]), "frame_index": pa.array([0, 1, 0, 1]), "timestamp": pa.array([0.0, 0.1, 0.0, 0.1], pa.float32()), "task_index": pa.array([0, 0, 1, 1]), "action": action}
    put_table(v30, "data/chunk-000/file-000.parquet", frames)
    put(v30, "meta/info.json", json.dumps({"codebase_version": "v3.0", "fps": 10, "total_episodes": 2, "total_frames": 4, "total_tasks": 2, "features": {k: v for k, v in FEATURES.items() if k != "cam"}}))
    put(v30, "meta/stats.json", json.dumps({"action": {"min": [0, 1], "max": [2, 7], "mean": [1, 4], "std": [1, 5**0.5], "count": [4]}}))
    return v30, frames


def full(spark, root):
    from framewright.plans.audit import audit

    return sorted({r["code"] for r in audit(spark, root, "full").collect()})


def test_full_audit_of_a_clean_set(spark, clean):
    assert full(spark, clean[0]) == []


def test_full_audit_finds_row_defects(spark, clean):
    root, frames = clean
    action = pa.FixedSizeListArray.from_arrays(pa.array([0, 1, 0, float("nan"), 2, 5, 2, 7], pa.float32()), 2)
    put_table(root, "data/chunk-000/file-000.parquet", frames | {"index": pa.array([0, 1, 1, 4]), "frame_index": pa.array([0, 0, 0, 2]), "timestamp": pa.array([0.0, 0.0, 0.5, 0.2], pa.float32()), "task_index": pa.array([0, None, 1, 9]), "action": action})
    assert full(spark, root) == sorted([
        "LEROBOT_FRAME_INDEX_DUPLICATE", "LEROBOT_GLOBAL_INDEX_DUPLICATE", "LEROBOT_GLOBAL_INDEX_NON_CONTIGUOUS", "LEROBOT_FRAME_INDEX_NON_CONTIGUOUS", "LEROBOT_TASK_REFERENCE_INVALID",
        "LEROBOT_TIMESTAMP_NON_MONOTONIC", "LEROBOT_TIMESTAMP_OFF_GRID", "LEROBOT_NUMERIC_NON_FINITE", "LEROBOT_STATS_VALUE_MISMATCH",
    ])


def test_full_audit_of_statistics(spark, clean):
    root, _ = clean
    put(root, "meta/stats.json", json.dumps({"action": {"min": [0, 1], "max": [2, 7.5], "mean": [1, 4], "count": [5]}}))
    assert full(spark, root) == ["LEROBOT_STATS_COUNT_MISMATCH", "LEROBOT_STATS_FIELD_MISSING", "LEROBOT_STATS_VALUE_MISMATCH"]
    os.remove(f"{root}/meta/stats.json")
    assert full(spark, root) == ["LEROBOT_STATS_MISSING"]


def test_samples_read_three_shards(spark):
    from framewright.sources import frames

    feet = spark.createDataFrame([(f"data/{k:02d}", 1, [], None, False) for k in range(9)], "path string, num_rows long, columns array<struct<name string, type string>>, error string, unfinalized boolean")
    assert sorted(r["path"] for r in frames.selected(feet, "sample").collect()) == ["data/00", "data/04", "data/08"]
    assert frames.selected(feet, "metadata").count() == 0 and frames.selected(feet, "full").count() == 9


def test_footers_and_digests_by_range_and_whole_agree(spark, tmp_path, monkeypatch):
    import hashlib

    import pyarrow as pa
    import pyarrow.parquet as pq

    from framewright.sources import files

    (tmp_path / "data").mkdir()
    pq.write_table(pa.table({"x": pa.array([[1.0, 2.0]] * 5, pa.list_(pa.float32(), 2)), "n": pa.array(range(5), pa.uint8())}), tmp_path / "data/a b.parquet")
    (tmp_path / "data/cut.parquet").write_bytes((tmp_path / "data/a b.parquet").read_bytes()[:-6])
    (tmp_path / "data/none.parquet").write_bytes(b"PAR")
    listed = files.inventory(spark, str(tmp_path))
    get = lambda: (sorted(map(str, files.footers(spark, listed).collect())), sorted(map(tuple, files.checksums(spark, listed).collect())))
    ranged = get()
    good = next(r for r in files.footers(spark, listed).collect() if r["path"].endswith("a b.parquet"))
    assert (good["num_rows"], good["unfinalized"], [(c["name"], c["type"], c["shape"]) for c in good["columns"]]) == (5, False, [("x", "float", [2]), ("n", "uint8", [])])
    assert dict(ranged[1])["data/none.parquet"] == hashlib.sha256(b"PAR").hexdigest()
    monkeypatch.setattr(files, "RANGED", {})
    assert get() == ranged


@pytest.fixture
def small_splits(spark):
    """Files are dealt to many tasks even when they are small."""
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_json_lines_are_read_by_ranges(spark, tmp_path, small_splits):
    text = [f'{{"k": {n}}}' if n % 7 else ("" if n % 2 else "no json") for n in range(1, 5001)]
    put(str(tmp_path), "unix.jsonl", "\n".join(text))
    put(str(tmp_path), "dos.jsonl", "\r\n".join(text) + "\r\n")
    for name in ("unix", "dos"):
        rows = metadata.json_lines(spark, str(tmp_path / f"{name}.jsonl"))
        assert rows.rdd.getNumPartitions() > 1
        got = sorted((r["line"], r["text"], r["k"]) for r in rows.select("line", "text", metadata.get("body", "$.k", "long").alias("k")).collect())
        assert got == [(n, t, n if n % 7 else None) for n, t in enumerate(text, 1) if t]


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    tasks = lambda: {r[0] for r in seen.collect()}
    df = spark.range(0, 3000, 1, 6).select("id", F.array(F.col("id").cast("double")).alias("v"), F.spark_partition_id().alias("task"))
    path = staged.as_parquet(df, str(tmp_path / "p/one.parquet"))
    assert os.path.isfile(path) and pq.read_metadata(path).num_rows == 3000
    seen = spark.read.parquet(path).select("task").distinct()
    assert tasks() == set(range(6))
    assert [r["id"] for r in spark.read.parquet(path).where("v[0] >= 2990").orderBy("id").collect()] == list(range(2990, 3000))
    path = staged.as_text(spark.range(0, 3000, 1, 6).orderBy(F.desc("id")).select(F.concat_ws(" ", "id").alias("value")), str(tmp_path / "t/one.txt"))
    with open(path) as f:
        assert f.read().split() == [str(n) for n in range(2999, -1, -1)]
    path = staged.as_text(spark.range(0, 60, 1, 6).select(F.concat_ws(" ", "id", F.spark_partition_id()).alias("value")), str(tmp_path / "t/two.txt"))
    with open(path) as f:
        assert [x.split()[1] for x in f] == [str(n // 10) for n in range(60)]
    with pytest.raises(FileExistsError):
        staged.as_text(spark.range(1).select(F.lit("x").alias("value")), path)
    staged.as_parquet(spark.range(0), str(tmp_path / "p/none.parquet"))
    assert pq.read_metadata(str(tmp_path / "p/none.parquet")).num_rows == 0
