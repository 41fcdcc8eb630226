"""Portable snapshots: totals by cascade, component fingerprints, evidence levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.digest import component_fingerprints
from framewright.operators.media import known_sum

COMPONENTS = ("source", "format", "features", "tasks", "episodes", "video_streams", "inventory_metadata", "inventory_data", "inventory_media", "totals", "coverage")


def totals(episodes: DataFrame, footers: DataFrame | None, tasks: DataFrame, inventory: DataFrame, declared: DataFrame, fps: float | None, videos: DataFrame | None = None) -> DataFrame:
    """(name, value): frames from footers, else lengths, else the declaration, else 0; duration from videos, else frames / fps, else 0; files by kind.

    declared (name, declared); videos (duration).
    """
    e = episodes.agg(F.count(F.lit(1)).alias("episodes"), known_sum("length").alias("lengths"))
    f = footers.agg(known_sum("num_rows").alias("rows")) if footers is not None else e.select(F.lit(None).cast("long").alias("rows"))
    t = tasks.agg(F.countDistinct("task_index").alias("tasks"))
    i = inventory.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_shards") for k in ("metadata", "data", "media")], known_sum("size_bytes").alias("size_bytes"))
    v = videos.agg(known_sum("duration").alias("seconds")) if videos is not None else e.select(F.lit(None).cast("double").alias("seconds"))
    d = declared.where("name = 'frames'").agg(F.max("declared").alias("declared"))
    row = e.join(f, how="cross").join(t, how="cross").join(i, how="cross").join(v, how="cross").join(d, how="cross")
    frames = F.coalesce("rows", "lengths", "declared", F.lit(0))
    seconds = F.coalesce("seconds", frames / F.lit(float(fps)) if fps else F.lit(None).cast("double"), F.lit(0.0))
    names = ["episodes", "frames", "tasks", "metadata_shards", "data_shards", "media_shards", "size_bytes", "duration_seconds"]
    row = row.withColumn("frames", frames).withColumn("duration_seconds", seconds)
    return row.select(F.expr("stack({}, {}) AS (name, value)".format(len(names), ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names))))


def fingerprints(components: DataFrame) -> DataFrame:
    """(component, fingerprint) of keyed rows (component, key, row), and `snapshot` over all components in order."""
    each = component_fingerprints(components, "component", "key", F.col("row"))
    top = each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("component", "fingerprint"))), lambda x: F.concat(x["component"], F.lit("="), x["fingerprint"])), "\n"), 256).alias("fingerprint"))
    return each.unionByName(top.select(F.lit("snapshot").alias("component"), "fingerprint"))


def evidence_level(status: str = "status", integrity: str = "integrity"):
    """official_claim, metadata_verified or sample_verified from coverage."""
    checked = F.col(status).isin("complete", "partial")
    return F.when(checked & F.col(integrity).isin("sample", "full"), "sample_verified").when(checked, "metadata_verified").otherwise("official_claim")


def single_fps(declared: float | None, videos: DataFrame) -> DataFrame:
    """fps: the declared one, else the only distinct one of the videos, else null."""
    one = videos.agg(F.when(F.countDistinct("fps") == 1, F.max("fps")).alias("found"))
    return one.select(F.coalesce(F.lit(declared).cast("double"), "found").alias("fps"))


def segments_of(relations: DataFrame) -> DataFrame:
    """Per episode the sorted array of its video segments."""
    return relations.where("kind = 'video'").groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct("feature_key", "from_timestamp", "to_timestamp", "path"))).alias("segments"))


def semantic_episodes(episodes: DataFrame, relations: DataFrame) -> DataFrame:
    """What a merge must keep of an episode: length, sorted tasks, distinct cameras, number of video files."""
    v = relations.where("kind = 'video'").groupBy("episode_index").agg(F.array_sort(F.collect_set("feature_key")).alias("cameras"), F.countDistinct("path").alias("n_files"))
    rows = episodes.select("episode_index", "length", F.array_sort(F.array_distinct(F.coalesce("tasks", F.array().cast("array<string>")))).alias("tasks"))
    return rows.join(v, "episode_index", "left").select("episode_index", "length", "tasks", F.coalesce("cameras", F.array().cast("array<string>")).alias("cameras"), F.coalesce("n_files", F.lit(0)).alias("n_files"))
