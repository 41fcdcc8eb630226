"""Readers of the two published repository layouts of episodic robot data, v2.1 (one file per episode) and v3.0 (shared shards).

Each gives the same bundle: info, features, tasks, episodes, relations (episode to shard or video, with index and time
ranges), inventory and findings. Nothing stops at the first defect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import model
from framewright.functions.text import template_path, version_state
from framewright.sources import files, metadata

# Supported versions, default paths and the default number of episodes in a chunk.
SUPPORTED = {2: 1, 3: 0}
V21_DATA = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
V21_VIDEO = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
V30_DATA = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
V30_VIDEO = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"
CHUNK = 1000

EPISODE = "episode_index long, length long, tasks array<string>, source_path string, source_row long"
RELATION = "kind string, episode_index long, path string, feature_key string, chunk_index long, file_index long, dataset_from_index long, dataset_to_index long, from_timestamp double, to_timestamp double, path_exists boolean"


@dataclass
class Bundle:
    version: str
    info: DataFrame
    features: DataFrame
    tasks: DataFrame
    episodes: DataFrame
    relations: DataFrame
    inventory: DataFrame
    findings: DataFrame


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str) -> Bundle:
    """The bundle of the data set at `root`; the version in info.json decides, else the layout where only one is there."""
    root = root.rstrip("/")
    listed = files.inventory(spark, root)
    paths = {r["path"] for r in listed.where("kind = 'metadata'").select("path").collect()}
    problems = _empty(spark, model.FINDING)
    one = spark.range(1)

    def problem(code: str, path: str | None = None, message: str | None = None) -> DataFrame:
        return model.findings(one, code, path=F.lit(path), message=F.lit(message))

    if "meta/info.json" in paths:
        info = metadata.info(spark, f"{root}/meta/info.json")
    else:
        info = _empty(spark, "path string, valid boolean, " + ", ".join(f"{k} {t}" for k, t in metadata.INFO.items()) + ", features string")
        problems = problems.unionByName(problem("LEROBOT_INFO_MISSING", "meta/info.json"))
    row = info.select("valid", "codebase_version", "chunks_size", "data_path", "video_path", version_state(F.col("codebase_version"), SUPPORTED).alias("state")).first()
    v30, v21 = any(p.startswith("meta/episodes/") for p in paths), "meta/episodes.jsonl" in paths
    if row is not None:
        if not row["valid"]:
            problems = problems.unionByName(problem("LEROBOT_METADATA_INVALID", "meta/info.json"))
        code = {"missing": "LEROBOT_CODEBASE_VERSION_MISSING", "invalid": "LEROBOT_CODEBASE_VERSION_INVALID", "unknown_minor": "LEROBOT_CODEBASE_VERSION_UNTESTED", "unsupported_major": "LEROBOT_CODEBASE_VERSION_UNSUPPORTED"}.get(row["state"])
        if code:
            problems = problems.unionByName(problem(code, "meta/info.json", row["codebase_version"]))
    stated = (row["codebase_version"] or "").strip().lstrip("v") if row is not None else ""
    major = 2 if stated.startswith("2.") else 3 if stated.startswith("3.") else 3 if v30 and not v21 else 2 if v21 and not v30 else 0
    if major == 3 and v21 or major == 2 and v30:
        problems = problems.unionByName(problem("LEROBOT_LAYOUT_VERSION_MISMATCH", "meta"))
    # a declaration is small; as local rows it cannot go stale the way a cached plan over rewritten files does
    declared = metadata.features(info)
    features = spark.createDataFrame(declared.collect(), declared.schema)
    cameras = [r["feature"] for r in features.where("dtype = 'video'").orderBy("feature").collect()]
    size = int(row["chunks_size"]) if row is not None and row["chunks_size"] else CHUNK
    data, video = (row["data_path"], row["video_path"]) if row is not None else (None, None)
    if major == 2:
        problems = problems.unionByName(problem("LEROBOT_V21_MIGRATION_RECOMMENDED"))
        tasks, episodes, relations, more = _v21(spark, root, paths, cameras, size, data or V21_DATA, video or V21_VIDEO)
    else:
        tasks, episodes, relations, more = _v30(spark, root, listed, paths, cameras, data or V30_DATA, video or V30_VIDEO)
    known = listed.select("path", F.lit(True).alias("_there"))
    relations = relations.drop("path_exists").join(known, "path", "left").withColumn("path_exists", F.coalesce("_there", F.lit(False))).drop("_there").select(*[x.split()[0] for x in RELATION.split(", ")])
    missing = relations.where("NOT path_exists AND path IS NOT NULL")
    problems = problems.unionByName(more)
    for kind, code in (("data", "LEROBOT_DATA_MISSING"), ("video", "LEROBOT_VIDEO_MISSING")):
        problems = problems.unionByName(model.findings(missing.where(F.col("kind") == kind).select("path", "episode_index", "feature_key").distinct(), code, path=F.col("path"), episode_index=F.col("episode_index"), feature_key=F.col("feature_key")))
    return Bundle(str(major), info, features, tasks, episodes, relations, listed, problems)


def _v21(spark, root, paths, cameras, size, data, video):
    problems = _empty(spark, model.FINDING)
    bad = lambda df, code: model.findings(df, code, path=F.regexp_extract("path", "(meta/[^/]+)$", 1), location=F.col("line").cast("string"))
    tasks, episodes = _empty(spark, "task_index long, task string"), _empty(spark, EPISODE)
    if "meta/tasks.jsonl" in paths:
        rows = metadata.json_lines(spark, f"{root}/meta/tasks.jsonl")
        parsed = rows.select("path", "line", "body", metadata.get("body", "$.task_index", "long").alias("task_index"), metadata.get("body", "$.task", "string").alias("task"))
        fine = F.col("body").isNotNull() & (F.col("task_index") >= 0) & (F.trim("task") != "")
        problems = problems.unionByName(bad(parsed.where(~F.coalesce(fine, F.lit(False))), "LEROBOT_TASK_INVALID"))
        tasks = parsed.where(fine).select("task_index", "task")
    else:
        problems = problems.unionByName(model.findings(spark.range(1), "LEROBOT_TASKS_MISSING", path=F.lit("meta/tasks.jsonl")))
    if "meta/episodes.jsonl" in paths:
        rows = metadata.json_lines(spark, f"{root}/meta/episodes.jsonl")
        index = F.coalesce(metadata.get("body", "$.episode_index", "long"), metadata.get("body", "$.index", "long"))
        names = F.coalesce(metadata.get("body", "$.tasks", "array<string>"), F.array_compact(F.array(metadata.get("body", "$.task", "string"))))
        parsed = rows.select("path", "line", "body", index.alias("episode_index"), metadata.get("body", "$.length", "long").alias("length"), names.alias("tasks"))
        problems = problems.unionByName(bad(parsed.where("body IS NULL"), "LEROBOT_EPISODE_INVALID"))
        problems = problems.unionByName(bad(parsed.where("body IS NOT NULL AND NOT coalesce(episode_index >= 0, false)"), "LEROBOT_EPISODE_INDEX_INVALID"))
        problems = problems.unionByName(bad(parsed.where("body IS NOT NULL AND length < 0"), "LEROBOT_EPISODE_LENGTH_INVALID"))
        episodes = parsed.where("body IS NOT NULL AND episode_index >= 0").select("episode_index", F.when(F.col("length") >= 0, F.col("length")).alias("length"), "tasks", F.lit("meta/episodes.jsonl").alias("source_path"), F.col("line").alias("source_row"))
    else:
        problems = problems.unionByName(model.findings(spark.range(1), "LEROBOT_EPISODES_MISSING", path=F.lit("meta/episodes.jsonl")))
    index, chunk = F.col("episode_index"), F.floor(F.col("episode_index") / size)
    none = lambda t: F.lit(None).cast(t)
    common = [none("long").alias(c) for c in ("chunk_index", "file_index", "dataset_from_index", "dataset_to_index")] + [none("double").alias("from_timestamp"), none("double").alias("to_timestamp"), none("boolean").alias("path_exists")]
    relations = _empty(spark, RELATION)
    try:
        path = template_path(data, episode_chunk=chunk, episode_index=index)
        relations = relations.unionByName(episodes.select(F.lit("data").alias("kind"), "episode_index", path.alias("path"), none("string").alias("feature_key"), *common))
    except ValueError as e:
        problems = problems.unionByName(model.findings(spark.range(1), "LEROBOT_DATA_PATH_TEMPLATE_INVALID", message=F.lit(str(e))))
    for camera in cameras:
        try:
            path = template_path(video, episode_chunk=chunk, episode_index=index, video_key=F.lit(camera))
            relations = relations.unionByName(episodes.select(F.lit("video").alias("kind"), "episode_index", path.alias("path"), F.lit(camera).alias("feature_key"), *common))
        except ValueError as e:
            problems = problems.unionByName(model.findings(spark.range(1), "LEROBOT_VIDEO_PATH_TEMPLATE_INVALID", feature_key=F.lit(camera), message=F.lit(str(e))))
    return tasks, episodes, relations, problems


def _tables(spark, listed, prefix: str):
    """The readable Parquet files below `prefix` as one frame, and findings for the others."""
    found = files.footers(spark, listed.where(F.col("path").startswith(prefix) & F.col("path").endswith(".parquet")))
    good = {r["path"] for r in found.where("error IS NULL").select("path").collect()}
    uris = [r["uri"] for r in listed.select("path", "uri").where(F.col("path").startswith(prefix)).collect() if r["path"] in good]
    return (spark.read.option("mergeSchema", "true").parquet(*uris) if uris else None), found


def _v30(spark, root, listed, paths, cameras, data, video):
    problems = _empty(spark, model.FINDING)
    tasks, episodes, relations = _empty(spark, "task_index long, task string"), _empty(spark, EPISODE), _empty(spark, RELATION)
    rows, broken = _tables(spark, listed, "meta/tasks")
    problems = problems.unionByName(model.findings(broken.where("error IS NOT NULL"), "LEROBOT_TASKS_UNREADABLE", path=F.col("path")))
    if rows is not None and "task_index" in rows.columns:
        # a writer may have kept the text as an unnamed index
        text = next((c for c in ("task", "__index_level_0__") if c in rows.columns), None)
        tasks = rows.select(F.col("task_index").cast("long").alias("task_index"), (F.col(text) if text else F.lit(None)).cast("string").alias("task"))
        fine = (F.col("task_index") >= 0) & (F.trim("task") != "")
        problems = problems.unionByName(model.findings(tasks.where(~F.coalesce(fine, F.lit(False))), "LEROBOT_TASK_INVALID", path=F.lit("meta/tasks.parquet"), location=F.col("task_index").cast("string")))
        tasks = tasks.where(fine)
    elif rows is None and not broken.limit(1).count():
        problems = problems.unionByName(model.findings(spark.range(1), "LEROBOT_TASKS_MISSING", path=F.lit("meta/tasks.parquet")))
    rows, broken = _tables(spark, listed, "meta/episodes/")
    problems = problems.unionByName(model.findings(broken.where("error IS NOT NULL"), "LEROBOT_EPISODES_UNREADABLE", path=F.col("path")))
    if rows is None:
        if not broken.limit(1).count():
            problems = problems.unionByName(model.findings(spark.range(1), "LEROBOT_EPISODES_MISSING", path=F.lit("meta/episodes")))
        return tasks, episodes, relations, problems
    has = lambda c: c in rows.columns
    pick = lambda c, t: (F.col(f"`{c}`") if has(c) else F.lit(None)).cast(t)
    source = rows.select("*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_row"))
    named = source.withColumn("episode_index", pick("episode_index", "long"))
    problems = problems.unionByName(model.findings(named.where("NOT coalesce(episode_index >= 0, false)"), "LEROBOT_EPISODE_INDEX_INVALID", path=F.col("_file"), location=F.col("_row").cast("string")))
    valid = named.where("episode_index >= 0")
    length = pick("length", "long")
    problems = problems.unionByName(model.findings(valid.where(length < 0), "LEROBOT_EPISODE_LENGTH_INVALID", path=F.col("_file"), episode_index=F.col("episode_index")))
    episodes = valid.select("episode_index", F.when(length >= 0, length).alias("length"), pick("tasks", "array<string>").alias("tasks"), F.col("_file").alias("source_path"), F.col("_row").alias("source_row"))
    chunk, file = pick("data/chunk_index", "long"), pick("data/file_index", "long")
    low, high = pick("dataset_from_index", "long"), pick("dataset_to_index", "long")
    none = lambda t: F.lit(None).cast(t)
    given = (chunk >= 0) & (file >= 0)
    problems = problems.unionByName(model.findings(valid.where(chunk.isNull() | file.isNull()), "LEROBOT_DATA_RELATION_MISSING", episode_index=F.col("episode_index")))
    problems = problems.unionByName(model.findings(valid.where((chunk < 0) | (file < 0) | (low > high) | (low < 0)), "LEROBOT_DATA_RELATION_INVALID", episode_index=F.col("episode_index")))
    try:
        path = F.when(given, template_path(data, chunk_index=chunk, file_index=file))
        relations = relations.unionByName(valid.select(F.lit("data").alias("kind"), "episode_index", path.alias("path"), none("string").alias("feature_key"), chunk.alias("chunk_index"), file.alias("file_index"), low.alias("dataset_from_index"), high.alias("dataset_to_index"), none("double").alias("from_timestamp"), none("double").alias("to_timestamp"), none("boolean").alias("path_exists")))
    except ValueError as e:
        problems = problems.unionByName(model.findings(spark.range(1), "LEROBOT_DATA_PATH_TEMPLATE_INVALID", message=F.lit(str(e))))
    for camera in cameras:
        chunk, file = pick(f"videos/{camera}/chunk_index", "long"), pick(f"videos/{camera}/file_index", "long")
        start, end = pick(f"videos/{camera}/from_timestamp", "double"), pick(f"videos/{camera}/to_timestamp", "double")
        problems = problems.unionByName(model.findings(valid.where(chunk.isNull() | file.isNull()), "LEROBOT_VIDEO_RELATION_MISSING", episode_index=F.col("episode_index"), feature_key=F.lit(camera)))
        try:
            path = F.when((chunk >= 0) & (file >= 0), template_path(video, video_key=F.lit(camera), chunk_index=chunk, file_index=file))
            relations = relations.unionByName(valid.select(F.lit("video").alias("kind"), "episode_index", path.alias("path"), F.lit(camera).alias("feature_key"), chunk.alias("chunk_index"), file.alias("file_index"), none("long").alias("dataset_from_index"), none("long").alias("dataset_to_index"), start.alias("from_timestamp"), end.alias("to_timestamp"), none("boolean").alias("path_exists")))
        except ValueError as e:
            problems = problems.unionByName(model.findings(spark.range(1), "LEROBOT_VIDEO_PATH_TEMPLATE_INVALID", feature_key=F.lit(camera), message=F.lit(str(e))))
    return tasks, episodes, relations, problems
