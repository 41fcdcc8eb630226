"""More registered queries: files that are written from the driver's tables into the shared folder and read back by the sources."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright import model
from framewright.operators import keys, media
from framewright.plans import audit, profiles, render
from framewright.plans.bindings import read
from framewright.plans.catalog import query
from framewright.session import shared_dir
from framewright.sources import files, frames, lerobot, metadata, staged


def _root(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _line(spark, value) -> DataFrame:
    return spark.createDataFrame([(json.dumps(value),)], "value string")


# ---------------------------------------------------------------- JSON


@query("""
SELECT row_number() OVER (ORDER BY c_custkey) * 2 - 1 AS line, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AS valid, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN c_custkey END AS key, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN c_mktsegment END AS segment FROM customer
""")
def json_lines(spark, d):
    """Customers as JSON lines with a blank line after each; every seventh is cut, every eleventh no object."""
    root, k = _root(spark, "lines"), F.col("c_custkey")
    body = F.when(k % 7 == 0, '{"key": ').when(k % 11 == 0, "[1]").otherwise(F.to_json(F.struct(k.alias("key"), F.col("c_mktsegment").alias("segment"))))
    staged.as_text(read(spark, d, "customer").orderBy("c_custkey").select(F.explode(F.array(body, F.lit(" "))).alias("value")), f"{root}/rows.jsonl")
    rows = metadata.json_lines(spark, f"{root}/rows.jsonl")
    return rows.select("line", F.col("body").isNotNull().alias("valid"), metadata.get("body", "$.key", "long").alias("key"), metadata.get("body", "$.segment", "string").alias("segment"))


@query("SELECT r_regionkey % 2 = 0 AS valid, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS name FROM region")
def json_objects(spark, d):
    root = _root(spark, "objects")
    for r in read(spark, d, "region").collect():  # one file per region
        staged.as_text(_line(spark, {"name": r["r_name"]} if r["r_regionkey"] % 2 == 0 else [r["r_name"]]), f"{root}/{r['r_regionkey']}.json")
    rows = metadata.json_objects(spark, root)
    return rows.select(F.col("body").isNotNull().alias("valid"), metadata.get("body", "$.name", "string").alias("name"))


INFO_SQL = "(SELECT count(*) AS episodes, (SELECT count(*) FROM lineitem) AS frames, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS tasks FROM orders)"


def _info(spark, d, **more) -> dict:
    """Declared totals as they are in the tables, but for one episode too many."""
    n = lambda t, e: read(spark, d, t).agg(F.expr(e)).first()[0]
    totals = {"total_episodes": n("orders", "count(1)") + 1, "total_frames": n("lineitem", "count(1)"), "total_tasks": n("orders", "count(DISTINCT o_orderpriority)")}
    return {"codebase_version": "v3.0", "fps": 10, "robot_type": "arm", **totals, **more}


@query(f"SELECT true AS valid, 'v3.0' AS codebase_version, CAST(10 AS DOUBLE) AS fps, episodes + 1 AS total_episodes, frames AS total_frames, tasks AS total_tasks, CAST(NULL AS BIGINT) AS total_videos, 'arm' AS robot_type FROM {INFO_SQL}")
def info_members(spark, d):
    root = _root(spark, "info")
    staged.as_text(_line(spark, _info(spark, d, total_videos="three")), f"{root}/info.json")
    return metadata.info(spark, f"{root}/info.json").select("valid", "codebase_version", "fps", "total_episodes", "total_frames", "total_tasks", "total_videos", "robot_type")


@query(f"SELECT name, declared, counted FROM (SELECT 'episodes' AS name, episodes + 1 AS declared, episodes AS counted FROM {INFO_SQL})")
def info_totals(spark, d):
    """Totals declared in a file against those of the tables; what nobody declares is no mismatch."""
    root = _root(spark, "info")
    staged.as_text(_line(spark, _info(spark, d)), f"{root}/info.json")
    counted = read(spark, d, "orders").agg(F.count(F.lit(1)).alias("e"), F.countDistinct("o_orderpriority").alias("t")).join(read(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("f")), how="cross")
    counted = counted.select(F.expr("stack(4, 'episodes', e, 'frames', f, 'tasks', t, 'videos', 0L) AS (name, counted)"))
    return keys.declared_against(metadata.declared_totals(metadata.info(spark, f"{root}/info.json")), counted)


@query("""
SELECT feature, field, dim, value FROM (
  SELECT 'action' AS feature, field, dim, value FROM (SELECT unnest(['min', 'min', 'max', 'max', 'mean', 'mean', 'count']) AS field, unnest([0, 1, 0, 1, 0, 1, 0]) AS dim, unnest([min(l_quantity), min(l_linenumber), max(l_quantity), max(l_linenumber), avg(l_quantity), avg(l_linenumber), count(*)]) AS value FROM lineitem)
  UNION ALL SELECT 'time', unnest(['min', 'max', 'count']), 0, unnest([CAST(min(event_id) AS DOUBLE), max(event_id), count(*)]) FROM events)
""")
def stats_values(spark, d):
    """A statistics file with arrays for one feature and plain numbers for another, wrapped as some writers do."""
    root = _root(spark, "stats")
    a = read(spark, d, "lineitem").agg(*[F.expr(e) for e in ("min(l_quantity)", "min(l_linenumber)", "max(l_quantity)", "max(l_linenumber)", "avg(l_quantity)", "avg(l_linenumber)", "count(1)")]).first()
    t = read(spark, d, "events").agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    staged.as_text(_line(spark, {"stats": {"action": {"min": [a[0], a[1]], "max": [a[2], a[3]], "mean": [a[4], a[5]], "count": [a[6]]}, "time": {"min": t[0], "max": t[1], "count": t[2]}}}), f"{root}/stats.json")
    return metadata.stats(spark, f"{root}/stats.json")


# ---------------------------------------------------------------- shards


def _shards(spark, d) -> str:
    """Lines as one shard for each line number, and a file without the closing mark of Parquet."""
    root = _root(spark, "shards")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").cast("long").alias("frame_index"), F.array("l_quantity", "l_discount").alias("action"), F.col("l_partkey").alias("global_index"), F.col("l_linenumber").alias("_n"))
    for r in rows.select("_n").distinct().orderBy("_n").collect():  # seven at most
        part = rows.where(F.col("_n") == r["_n"]).drop("_n")
        staged.as_parquet(part.drop("global_index") if r["_n"] % 2 else part, f"{root}/data/file-00{r['_n']}.parquet")
    staged.as_text(spark.createDataFrame([("broken " * 4,)], "value string"), f"{root}/data/file-900.parquet")
    return root


SHARDS = "(SELECT 'data/file-00' || l_linenumber || '.parquet' AS path, l_linenumber AS n, count(*) AS num_rows FROM lineitem GROUP BY ALL)"


@query(f"SELECT path, num_rows, n % 2 = 0 AS with_index, false AS unfinalized, false AS broken FROM {SHARDS} UNION ALL SELECT 'data/file-900.parquet', NULL, NULL, true, true")
def shard_footers(spark, d):
    found = files.footers(spark, files.inventory(spark, _shards(spark, d)))
    return found.select("path", "num_rows", F.exists("columns", lambda c: c["name"] == "global_index").alias("with_index"), "unfinalized", F.col("error").isNotNull().alias("broken"))


@query("SELECT 'LEROBOT_PARQUET_UNFINALIZED' AS code, 'data/file-900.parquet' AS path FROM region WHERE r_regionkey = 0")
def shard_findings(spark, d):
    return files.footer_findings(files.footers(spark, files.inventory(spark, _shards(spark, d)))).select("code", "path")


@query(f"""
SELECT integrity, path, num_rows FROM (SELECT 'full' AS integrity, path, num_rows FROM {SHARDS}
UNION ALL SELECT 'sample', path, num_rows FROM (SELECT path, num_rows, row_number() OVER (ORDER BY path) - 1 AS k, count(*) OVER () AS n FROM {SHARDS}) WHERE k IN (0, (n - 1) // 2, n - 1))
""")
def shards_selected(spark, d):
    foot = files.footers(spark, files.inventory(spark, _shards(spark, d)))
    of = lambda i: frames.selected(foot, i).select(F.lit(i).alias("integrity"), "path", "num_rows")
    return of("metadata").unionByName(of("sample")).unionByName(of("full"))


@query("""
SELECT 'data/file-00' || l_linenumber || '.parquet' AS path, count(*) AS rows, count(*) * (count(*) + 1) // 2 AS row_sum, CASE WHEN l_linenumber % 2 = 0 THEN CAST(sum(l_partkey) AS BIGINT) END AS index_sum, CAST(sum(l_orderkey) AS BIGINT) AS episode_sum, CAST(sum(l_quantity) AS BIGINT) AS action_sum FROM lineitem GROUP BY l_linenumber
""")
def frames_of_shards(spark, d):
    """Shards of two schemas read as one frame; an index column is taken under its other name where a shard has it."""
    root = _shards(spark, d)
    foot = files.footers(spark, files.inventory(spark, root))
    rows = frames.read(spark, root, frames.selected(foot, "full"), ["action"])
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.sum("row").alias("row_sum"), F.sum("index").alias("index_sum"), F.sum("episode_index").alias("episode_sum"), F.sum(F.col("action")[0]).cast("long").alias("action_sum"))


@query(f"""
SELECT code, feature_key, path FROM (
  SELECT 'LEROBOT_FEATURE_COLUMN_MISSING' AS code, 'ghost' AS feature_key, path FROM {SHARDS} UNION ALL SELECT 'LEROBOT_FEATURE_COLUMN_UNDECLARED', 'global_index', path FROM {SHARDS} WHERE n % 2 = 0
  UNION ALL SELECT 'LEROBOT_FEATURE_DTYPE_MISMATCH', 'frame_index', path FROM {SHARDS} UNION ALL SELECT 'LEROBOT_FEATURE_NULLABILITY_MISMATCH', 'action', path FROM {SHARDS})
""")
def schema_drift(spark, d):
    """Declared features against shards: one missing, one undeclared, one of another type, an alias that fits, a nullability that does not."""
    foot = files.footers(spark, files.inventory(spark, _shards(spark, d)))
    declared = [("ghost", "float32", [2], None), ("episode_index", "int", [1], None), ("frame_index", "int32", [1], None), ("action", "double", None, True)]
    features = spark.createDataFrame(declared, "feature string, dtype string, shape array<long>, nullable boolean")
    return audit.schema_findings(features, foot).select("code", "feature_key", "path")


# ---------------------------------------------------------------- files


@query("""
SELECT path, kind, stream, bytes FROM (SELECT 'meta/' || r_name || '.txt' AS path, 'metadata' AS kind, NULL AS stream, strlen(r_name) + 1 AS bytes FROM region
UNION ALL SELECT 'videos/cam' || r_regionkey || '/chunk-000/file-000.mp4', 'media', 'cam' || r_regionkey, 3 FROM region UNION ALL SELECT 'notes/' || r_regionkey || '.txt', 'other', NULL, 2 FROM region)
""")
def file_inventory(spark, d):
    return files.inventory(spark, _folder(spark, d)).select("path", "kind", "stream", F.col("size_bytes").alias("bytes"))


def _folder(spark, d) -> str:
    root = _root(spark, "folder")
    for r in read(spark, d, "region").collect():  # five regions, three files each
        for path, text in ((f"meta/{r['r_name']}.txt", r["r_name"]), (f"videos/cam{r['r_regionkey']}/chunk-000/file-000.mp4", "ab"), (f"notes/{r['r_regionkey']}.txt", "n")):
            staged.as_text(spark.createDataFrame([(text,)], "value string"), f"{root}/{path}")
    return root


@query("SELECT r_name AS name, sha256(r_name || chr(10)) AS sha256 FROM region")
def file_digests(spark, d):
    listed = files.inventory(spark, _folder(spark, d)).where("kind = 'metadata'")
    return files.checksums(spark, listed).select(F.regexp_extract("path", "([^/]+)[.]txt$", 1).alias("name"), "sha256")


@query("SELECT * FROM (SELECT 'folder' AS name, CASE WHEN count(*) > 0 THEN 'lerobot' END AS format FROM region UNION ALL SELECT 'videos', CASE WHEN count(*) > 0 THEN 'video' END FROM region UNION ALL SELECT 'asked', 'video')")
def format_detected(spark, d):
    paths = read(spark, d, "region").select(F.explode(F.array(F.concat(F.lit("meta/"), "r_name"), F.concat(F.lit("videos/"), "r_name", F.lit(".mp4")))).alias("path"))
    rows = [("folder", files.detect_format(paths)), ("videos", files.detect_format(paths.where("path LIKE 'videos/%'"))), ("asked", files.detect_format(paths, "video"))]
    return spark.createDataFrame(rows, "name string, format string")


@query("SELECT o_orderkey AS episode_index, o_orderstatus AS feature_key, 'a/' || o_orderstatus || '/x/episode_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.mp4' AS path FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P'")
def episode_files(spark, d):
    """Files found by their episode's name and a folder that names the camera; a third are named otherwise, one camera is not declared."""
    o = read(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, "take_").otherwise("episode_")
    paths = o.select(F.concat(F.lit("a/"), "o_orderstatus", F.lit("/x/"), name, F.format_string("%06d", "o_orderkey"), F.lit(".mp4")).alias("path"))
    return media.match_episode_files(o.select(F.col("o_orderkey").alias("episode_index")), paths, spark.createDataFrame([("F",), ("O",)], "feature_key string"))


# ---------------------------------------------------------------- layouts


def _v3(spark, d) -> str:
    """Orders as episodes in four shards of lines and three video files of one camera, which are not there; totals with one episode too many."""
    root, o = _root(spark, "set3"), read(spark, d, "orders")
    features = {"action": {"dtype": "float64", "shape": [2]}, "front": {"dtype": "video", "shape": [1, 1, 3]}, "episode_index": {"dtype": "int64", "shape": [1]}, "frame_index": {"dtype": "int64", "shape": [1]}}
    staged.as_text(_line(spark, _info(spark, d, features=features)), f"{root}/meta/info.json")
    names = [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    staged.as_parquet(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "task_index long, `__index_level_0__` string"), f"{root}/meta/tasks.parquet")
    k = F.col("o_orderkey")
    rows = o.select(
        k.alias("episode_index"), (k % 7 + 1).alias("length"), F.array("o_orderpriority").alias("tasks"), F.lit(0).cast("long").alias("data/chunk_index"), (k % 4).alias("data/file_index"),
        F.lit(0).cast("long").alias("videos/front/chunk_index"), (k % 3).alias("videos/front/file_index"), F.lit(0.0).alias("videos/front/from_timestamp"), (k % 7 - 2).cast("double").alias("videos/front/to_timestamp"),
    )
    staged.as_parquet(rows, f"{root}/meta/episodes/chunk-000/file-000.parquet")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_index"), (F.col("l_linenumber") - 1).cast("long").alias("frame_index"), F.array("l_quantity", "l_discount").alias("action"))
    for n in range(4):
        staged.as_parquet(lines.where(F.col("episode_index") % 4 == n), f"{root}/data/chunk-000/file-00{n}.parquet")
    return root


V3 = """
SELECT 'version 3' AS what, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'tasks', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'episodes', count(*) FROM orders UNION ALL SELECT 'lengths', CAST(sum(o_orderkey % 7 + 1) AS BIGINT) FROM orders
UNION ALL SELECT 'data', count(*) FROM orders UNION ALL SELECT 'video', count(*) FROM orders UNION ALL SELECT 'data there', count(*) FROM orders UNION ALL SELECT 'LEROBOT_VIDEO_MISSING', count(*) FROM orders
"""


@query(V3)
def layout_v3(spark, d):
    b = lerobot.read(spark, _v3(spark, d))
    one = lambda df, what, e="count(1)": df.agg(F.lit(what).alias("what"), F.expr(e).cast("long").alias("n"))
    out = one(spark.range(1), f"version {b.version}").unionByName(one(b.tasks.where("task IS NOT NULL"), "tasks")).unionByName(one(b.episodes, "episodes")).unionByName(one(b.episodes, "lengths", "sum(length)"))
    kinds = b.relations.groupBy(F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(kinds).unionByName(one(b.relations.where("kind = 'data' AND path_exists"), "data there")).unionByName(b.findings.groupBy(F.col("code").alias("what")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT episode_index, reason FROM (SELECT o_orderkey AS episode_index, CASE WHEN o_orderkey % 7 < 2 THEN 'negative' WHEN o_orderkey % 7 = 2 THEN 'empty' END AS reason FROM orders) WHERE reason IS NOT NULL")
def layout_v3_segments(spark, d):
    """Segments of a read data set whose end is not behind their start."""
    b = lerobot.read(spark, _v3(spark, d))
    bad = b.relations.where("kind = 'video' AND NOT to_timestamp > from_timestamp")
    return bad.select("episode_index", F.when(F.col("to_timestamp") < 0, "negative").otherwise("empty").alias("reason"))


def _v21(spark, d, mixed: bool = False) -> str:
    """Orders as JSON lines of the older layout, every 50th cut; no data files."""
    root, o, k = _root(spark, "set2"), read(spark, d, "orders").orderBy("o_orderkey"), F.col("o_orderkey")
    staged.as_text(_line(spark, _info(spark, d, codebase_version="v2.1", features={"cam": {"dtype": "video", "shape": [1, 1, 3]}}, chunks_size=100)), f"{root}/meta/info.json")
    body = F.when(k % 50 == 0, '{"episode_index"').otherwise(F.to_json(F.struct(k.alias("episode_index"), (k % 7 + 1).alias("length"), F.array("o_orderpriority").alias("tasks"))))
    staged.as_text(o.select(body.alias("value")), f"{root}/meta/episodes.jsonl")
    names = [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    staged.as_text(spark.createDataFrame([(json.dumps({"task_index": k, "task": n}),) for k, n in enumerate(names)], "value string"), f"{root}/meta/tasks.jsonl")
    if mixed:
        staged.as_parquet(o.select(k.alias("episode_index")), f"{root}/meta/episodes/chunk-000/file-000.parquet")
    return root


V21 = """
SELECT code, count(*) AS n, min(path) AS first FROM (
  SELECT 'LEROBOT_EPISODE_INVALID' AS code, 'meta/episodes.jsonl' AS path FROM orders WHERE o_orderkey % 50 = 0
  UNION ALL SELECT 'LEROBOT_DATA_MISSING', 'data/chunk-' || lpad(CAST(o_orderkey // 100 AS VARCHAR), CAST(greatest(3, length(CAST(o_orderkey // 100 AS VARCHAR))) AS INTEGER), '0') || '/episode_' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') || '.parquet' FROM orders WHERE o_orderkey % 50 <> 0
  UNION ALL SELECT 'LEROBOT_VIDEO_MISSING', 'videos/chunk-' || lpad(CAST(o_orderkey // 100 AS VARCHAR), CAST(greatest(3, length(CAST(o_orderkey // 100 AS VARCHAR))) AS INTEGER), '0') || '/cam/episode_' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') || '.mp4' FROM orders WHERE o_orderkey % 50 <> 0
  UNION ALL SELECT 'LEROBOT_V21_MIGRATION_RECOMMENDED', NULL {}) GROUP BY code
"""


@query(V21.format(""))
def layout_v21(spark, d):
    b = lerobot.read(spark, _v21(spark, d))
    return b.findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


@query(V21.format("UNION ALL SELECT 'LEROBOT_LAYOUT_VERSION_MISMATCH', 'meta'"))
def layout_mixed(spark, d):
    """Both layouts' metadata in one folder: the declared version is read, and the mix is a finding."""
    b = lerobot.read(spark, _v21(spark, d, mixed=True))
    return b.findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


@query("SELECT component, kind, class, count(*) AS n FROM (SELECT 'episodes' AS component, 'content_changed' AS kind, 'material' AS class FROM orders WHERE o_orderkey % 50 <> 0 AND false UNION ALL SELECT 'episodes', 'removed', 'material' FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'features', 'removed', 'breaking' FROM (SELECT unnest(range(4))) UNION ALL SELECT 'features', 'added', 'non_breaking' UNION ALL SELECT 'video_streams', 'removed', 'breaking' UNION ALL SELECT 'video_streams', 'added', 'non_breaking' UNION ALL SELECT 'inventory_metadata', 'added', 'non_breaking' FROM (SELECT unnest(range(2))) UNION ALL SELECT 'inventory_metadata', 'removed', 'material' FROM (SELECT unnest(range(2))) UNION ALL SELECT 'inventory_data', 'removed', 'material' FROM (SELECT unnest(range(4)))) GROUP BY ALL")
def layouts_compared(spark, d):
    """A data set in the newer layout against the same orders in the older one, as classified changes; info.json differs in size only."""
    found = audit.changes(lerobot.read(spark, _v3(spark, d)), lerobot.read(spark, _v21(spark, d)))
    return found.where("NOT (component = 'inventory_metadata' AND kind = 'changed')").groupBy("component", "kind", "class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'BLOCKED' AS status, code, about FROM (SELECT 'READINESS_FEATURE_MISSING' AS code, 'state' AS about UNION ALL SELECT 'READINESS_FEATURE_SHAPE_MISMATCH', 'action' UNION ALL SELECT 'READINESS_FEATURE_GROUP_MISSING', 'cameras' UNION ALL SELECT 'READINESS_METADATA_MISSING', 'license' UNION ALL SELECT 'READINESS_DATASET_VERSION_INCOMPATIBLE', NULL) WHERE (SELECT count(*) FROM orders) > 0")
def readiness_of_set(spark, d):
    """A profile from JSON against a data set that was read from files."""
    b = lerobot.read(spark, _v3(spark, d))
    profile = profiles.load(json.dumps({"name": "p", "versions": ["2.1"], "features": {"state": {"dtype": "float64"}, "action": {"shape": [3], "dtype": "float64"}}, "groups": [{"name": "cameras", "pattern": "cam*", "minimum": 1}], "metadata": {"license": "error"}, "capabilities": {"meta.info": "metadata"}}))
    coverage = spark.createDataFrame([("meta.info", "complete", "metadata")], "capability string, status string, integrity string")
    status, blockers, _ = profiles.evaluate(spark, profile, b, spark.createDataFrame([], model.FINDING), coverage)
    return status.select("status").join(blockers, how="cross").select("status", "code", "about")


# ---------------------------------------------------------------- artifacts


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = _root(spark, "csv")
    render.write_csv(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.option("header", "true").schema("c_custkey long, c_name string, c_mktsegment string").csv(path)


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS errors, CAST(0 AS BIGINT) AS warnings, (SELECT count(*) FROM nation) AS infos, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) = 0 AS accepted")
def report_summary(spark, d):
    """An audit report as the command line writes it."""
    found = model.findings(keys.duplicate_keys(read(spark, d, "orders"), ["o_custkey"]), "LEROBOT_EPISODE_INDEX_DUPLICATE", episode_index=F.col("o_custkey"))
    found = found.unionByName(model.findings(read(spark, d, "nation"), "ADVISORY_SHORT_EPISODE", episode_index=F.col("n_nationkey")))
    found = found.withColumn("severity", F.when(F.col("code").startswith("ADVISORY"), "info").otherwise(F.col("severity")))
    r = render.write_audit(found, f"{_root(spark, 'report')}/audit.json")
    s = r["summary"]
    return spark.createDataFrame([(s["error"], s["warning"], s["info"], r["accepted"])], "errors long, warnings long, infos long, accepted boolean")


@query("SELECT line, text FROM (SELECT 1 AS line, '# Readiness: BLOCKED' AS text UNION ALL SELECT 3, count(*) || ' blockers, 0 gaps in coverage.' FROM region UNION ALL SELECT 5, '| Code | About |' UNION ALL SELECT 6, '| --- | --- |' UNION ALL SELECT 6 + row_number() OVER (ORDER BY r_name), '| READINESS_FEATURE_MISSING | ' || r_name || ' |' FROM region)")
def readiness_report(spark, d):
    blockers = [{"code": "READINESS_FEATURE_MISSING", "feature": r["r_name"]} for r in read(spark, d, "region").orderBy("r_name").collect()]
    lines = render.readiness_markdown("BLOCKED", blockers, []).split("\n")
    return spark.createDataFrame([(k, t) for k, t in enumerate(lines, 1) if t], "line int, text string")
