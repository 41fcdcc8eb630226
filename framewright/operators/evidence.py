"""What reports and verdicts rest on: measurements by feature, coverage of prepared records, loader results, episode details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.findings import INTEGRITY, deduplicated, enrich, rank

#: Seconds of a segment that a preview shows at most.
PREVIEW_SECONDS = 180.0


def measurements(moments: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per feature from moments (feature, dim, min, max, var) and static spans (feature, episode_index, first, last).

    variance by dimension, minimum and maximum over all dimensions, the sorted spans, and what the spans mean; a feature needs one of the two.
    """
    numeric = moments.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "var"))), lambda x: x["var"]).alias("variance"), F.min("min").alias("minimum"), F.max("max").alias("maximum"))
    idle = spans.where("feature IS NOT NULL AND first IS NOT NULL AND last IS NOT NULL").groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("episode_index", "first", "last"))).alias("idle_spans"))
    both = numeric.join(idle, "feature", "full_outer")
    return both.withColumn("semantics", F.when(F.col("idle_spans").isNotNull(), F.lit("validated_static_span")))


def media_complete(coverage: DataFrame) -> DataFrame:
    """(complete): whether media.metadata and media.decode are both complete at sample or full integrity."""
    done = (F.col("status") == "complete") & F.col("integrity").isin("sample", "full")
    has = lambda c: F.coalesce(F.bool_or((F.col("capability") == c) & done), F.lit(False))
    return coverage.agg((has("media.metadata") & has("media.decode")).alias("complete"))


def reusable(prepared: DataFrame, wanted: DataFrame) -> DataFrame:
    """Why prepared records cannot answer a request: no rows if they can.

    Both have one row per name (root, input_format, checksum, integrity, follow_symlinks) and value. An integrity answers for all below it and a digest for a
    request without one; everything else must be the same.
    """
    both = wanted.select("name", F.col("value").alias("wanted")).join(prepared.select("name", F.col("value").alias("prepared")), "name", "left")
    deep = rank("prepared", INTEGRITY) >= rank("wanted", INTEGRITY)
    enough = (
        F.when(F.col("name") == "integrity", F.col("prepared").isin(*INTEGRITY) & F.col("wanted").isin(*INTEGRITY) & deep)
        .when((F.col("name") == "checksum") & F.col("wanted").isNull(), True)
        .when((F.col("name") == "input_format") & (F.col("wanted") == "auto"), F.col("prepared").isNotNull())
        .otherwise(F.col("prepared") == F.col("wanted"))
    )
    return both.where(~F.coalesce(enough, F.lit(False))).select("name", "prepared", "wanted")


def uncovered_videos(videos: DataFrame, integrity: str, checksum: str | None) -> DataFrame:
    """Prepared videos whose own record does not reach what the whole claims: path and reason."""
    shallow = rank("integrity", INTEGRITY) < INTEGRITY.index(integrity)
    reason = F.when(~F.col("integrity").isin(*INTEGRITY) | shallow, "integrity").when(F.lit(integrity != "metadata") & F.col("decode_valid").isNull(), "decode")
    if checksum == "sha256":
        reason = reason.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
    return videos.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def contract_findings(found: DataFrame, registry: DataFrame, unknown: str = "error") -> DataFrame:
    """Findings that no rule made (sources, configuration) under the registry's contract, each once."""
    return deduplicated(enrich(found, registry, unknown), ["code", "path", "location", "evidence"], ["layer", "code", "message"])


def publication_source(kind: Column, publication_profile: Column, has_card: Column) -> Column:
    """Which metadata a publication gate reads: the card of a remote source under a publication profile, else what the snapshot states."""
    return F.when(has_card & publication_profile & (kind == "hub"), "publication_metadata").otherwise("snapshot_format_metadata")


def loader_status(results: DataFrame, expected: Column) -> DataFrame:
    """passed, failed or unverified of loader results (name, kind, ok, status, loaded), where kind is boolean, object, none or other.

    An object passes by `ok`, else by its status word; a pass with another number of episodes than expected fails; an unavailable loader verifies nothing.
    """
    word = F.lower(F.coalesce("status", F.lit("")))
    good = F.coalesce(F.col("ok"), word.isin("ok", "passed", "success", "succeeded"))
    counted = F.col("loaded").isNull() | expected.isNull() | (F.col("loaded") == expected)
    out = (
        F.when(F.col("kind") == "none", "unverified")
        .when(F.col("kind") == "boolean", F.when(F.col("ok"), "passed").otherwise("failed"))
        .when(F.col("kind") != "object", "failed")
        .when(word == "unavailable", "unverified")
        .otherwise(F.when(good & counted, "passed").otherwise("failed"))
    )
    return results.select("name", F.coalesce(out, F.lit("failed")).alias("status"))


def segment_details(relations: DataFrame) -> DataFrame:
    """Video segments of episodes with the seconds that a preview shows: never negative, at most PREVIEW_SECONDS."""
    seconds = F.least(F.lit(PREVIEW_SECONDS), F.greatest(F.lit(0.0), F.col("to_timestamp") - F.col("from_timestamp")))
    return relations.where("kind = 'video'").select("episode_index", F.col("feature_key").alias("key"), "path", "from_timestamp", "to_timestamp", seconds.alias("preview_seconds"))


def episode_details(episodes: DataFrame, relations: DataFrame, found: DataFrame) -> DataFrame:
    """One row per episode: length, tasks, its segments in order of camera and time, and its findings by severity and code."""
    s = segment_details(relations).groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct("key", "from_timestamp", "to_timestamp", "path", "preview_seconds"))).alias("videos"))
    f = found.where("episode_index IS NOT NULL").groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct("severity", "code"))).alias("findings"))
    return episodes.select("episode_index", "length", "tasks").join(s, "episode_index", "left").join(f, "episode_index", "left")


def hub_projection(totals: DataFrame, planned: DataFrame) -> DataFrame:
    """(name, value, status) of a remote snapshot's totals: what only a whole payload proves is partial as soon as the plan left anything out of its kind.

    totals (name, value); planned (kind, status) as `remote.coverage` gives them. Totals from metadata are proven without a payload.
    """
    kind = F.when(F.col("name").isin("frames", "data_shards"), "data").when(F.col("name").isin("media_shards", "duration_seconds"), "video")
    both = totals.withColumn("kind", kind).join(planned.select("kind", "status"), "kind", "left")
    return both.select("name", "value", F.when(F.col("kind").isNull(), "complete").otherwise(F.coalesce("status", F.lit("unavailable"))).alias("status"))


def adapter_label(adapter: Column) -> Column:
    """The label under which a reader is named in snapshots."""
    return F.when(adapter == "lerobot_v21", "LeRobot v2.1").when(adapter == "lerobot_v30", "LeRobot v3.0").when(adapter == "video", "Video folder").otherwise(adapter)
