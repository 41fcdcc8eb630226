"""Video and stream records: validity, consistency inside a stream, contracts, inventory sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata_valid() -> Column:
    """Width, height, frames, fps and duration are all positive."""
    return F.forall(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("width", "height", "frame_count", "fps", "duration")]), lambda x: x > 0)


def video_problems(videos: DataFrame) -> DataFrame:
    """One row for each code that a video record gives: unreadable, fps, duration, dimensions, decode failure."""
    codes = F.array_compact(
        F.array(
            F.when(F.col("error").isNotNull(), F.lit("VIDEO_UNREADABLE")),
            F.when(F.col("error").isNull() & ~(F.col("fps") > 0), F.lit("VIDEO_INVALID_FPS")),
            F.when(F.col("error").isNull() & ~(F.col("duration") > 0), F.lit("VIDEO_INVALID_DURATION")),
            F.when(F.col("error").isNull() & ~((F.col("width") > 0) & (F.col("height") > 0)), F.lit("VIDEO_INVALID_DIMENSIONS")),
            F.when(F.col("decode_valid").eqNullSafe(F.lit(False)), F.lit("VIDEO_PREVIEW_DECODE_FAILED")),
        )
    )
    return videos.select("path", F.explode(codes).alias("code"))


def inconsistent(df: DataFrame, stream: str, value: Column, name: str = "n_values") -> DataFrame:
    """Streams with more than one distinct value."""
    return df.groupBy(stream).agg(F.countDistinct(value).alias(name)).where(F.col(name) > 1)


def stream_summary(df: DataFrame, stream: str, path: str, size: str) -> DataFrame:
    """Per stream: distinct paths, members, total and largest size."""
    return df.groupBy(stream).agg(F.countDistinct(path).alias("n_paths"), F.count(F.lit(1)).alias("n_members"), F.sum(size).alias("size"), F.max(size).alias("largest"))


def contract_mismatch(videos: DataFrame, features: DataFrame) -> DataFrame:
    """Videos against the declared feature of their stream: resolution, fps (after rounding to 3 digits, within 1e-4) and channels (3 decoded)."""
    both = videos.join(features, videos["stream"] == features["feature"])
    fps = F.abs(F.round(videos["fps"], 3) - features["declared_fps"]) > 1e-4
    codes = F.array_compact(
        F.array(
            F.when((videos["width"] != features["declared_width"]) | (videos["height"] != features["declared_height"]), F.lit("LEROBOT_VIDEO_RESOLUTION_MISMATCH")),
            F.when(fps, F.lit("LEROBOT_VIDEO_FPS_MISMATCH")),
            F.when(features["declared_channels"] != 3, F.lit("LEROBOT_VIDEO_CHANNELS_MISMATCH")),
        )
    )
    return both.select(videos["path"], F.explode(codes).alias("code"))


def frame_total(footer_rows: int | None, lengths: int | None, declared: int | None) -> int:
    """The first known of footer rows, summed lengths and the declared total, else 0."""
    return next((x for x in (footer_rows, lengths, declared) if x is not None), 0)


def known_sum(column: str) -> Column:
    """The sum if no value is unknown, else null."""
    return F.when(F.count_if(F.col(column).isNull()) == 0, F.sum(column))


def inventory_totals(df: DataFrame, kind: str = "kind", size: str = "size_bytes") -> DataFrame:
    """Files and bytes of each kind; bytes are unknown as soon as one file's are."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n_files"), known_sum(size).alias("bytes"))


def scan_summary(videos: DataFrame) -> DataFrame:
    """One row: files, valid files, frames, seconds and bytes of the valid ones, distinct resolutions."""
    ok = metadata_valid() & ~F.col("decode_valid").eqNullSafe(F.lit(False))
    v = videos.withColumn("_ok", ok)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("_ok"), F.col(c))), F.lit(0))
    size = F.when(F.col("_ok"), F.concat_ws("x", "width", "height"))
    return v.agg(F.count(F.lit(1)).alias("files"), F.count_if("_ok").alias("valid"), of("frame_count").alias("frames"), of("duration").alias("seconds"), of("size_bytes").alias("bytes"), F.countDistinct(size).alias("resolutions"))


def match_episode_files(episodes: DataFrame, files: DataFrame, cameras: DataFrame) -> DataFrame:
    """(episode_index, feature_key, path): files whose stem is episode_<6 digits> and whose folders name the camera."""
    parts = F.split("path", "/")
    stem = F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.[^.]*$", 1)
    named = files.select("path", stem.alias("_stem"), F.explode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("_part")).distinct()
    at = named.join(cameras.select(F.col("feature_key").alias("_part")).distinct(), "_part")
    wanted = episodes.select("episode_index", F.format_string("episode_%06d", "episode_index").alias("_stem"))
    return at.join(wanted, "_stem").select("episode_index", F.col("_part").alias("feature_key"), "path")


PROBE = "path string, width int, height int, fps double, frame_count int, duration double, decode_valid boolean, decoded_frame_count int, error string"


def probe(files: DataFrame, depth: str = "sample") -> DataFrame:
    """PROBE of the files (uri, path) with OpenCV where a worker has it; else every row says that no decoder is there.

    sample decodes the first, middle and last frame, all of which must come; full decodes everything and wants as many frames as declared.
    The decoder opens local paths, so this is for file systems that the workers mount.
    """

    def run(batches):
        import pandas as pd

        try:
            import cv2
        except ImportError:
            cv2 = None
        for batch in batches:
            rows = [_probed(cv2, uri.removeprefix("file:"), path, depth) for uri, path in zip(batch["uri"], batch["path"], strict=True)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PROBE.split(", ")])

    return files.select("uri", "path").mapInPandas(run, PROBE)


def _probed(cv2, uri: str, path: str, depth: str) -> tuple:
    if cv2 is None:
        return path, None, None, None, None, None, None, None, "no decoder"
    video = cv2.VideoCapture(uri)
    try:
        if not video.isOpened():
            return path, 0, 0, 0.0, 0, 0.0, False, 0, "cannot open"
        width, height, fps, n = (video.get(k) for k in (cv2.CAP_PROP_FRAME_WIDTH, cv2.CAP_PROP_FRAME_HEIGHT, cv2.CAP_PROP_FPS, cv2.CAP_PROP_FRAME_COUNT))
        n = int(n)
        decoded = 0
        if depth == "full":
            while video.read()[0]:
                decoded += 1
            valid = decoded >= n
        else:
            places = sorted({0, max(n - 1, 0) // 2, max(n - 1, 0)})
            for k in places:
                video.set(cv2.CAP_PROP_POS_FRAMES, k)
                decoded += video.read()[0]
            valid = decoded == len(places)
        return path, int(width), int(height), float(fps), n, n / fps if fps > 0 else 0.0, valid, decoded, None
    finally:
        video.release()
