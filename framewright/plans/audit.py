"""From a data set's folder to ordered findings: read, check, enrich, de-duplicate; and the portable totals of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import model
from framewright.operators import diff, findings, keys, numeric, sequence
from framewright.sources import files, frames, lerobot, metadata


def metadata_findings(b: lerobot.Bundle) -> DataFrame:
    """Totals, indexes, task references and index ranges, from metadata and footers only."""
    found = b.findings
    add = lambda df, code, **c: found.unionByName(model.findings(df, code, **c))
    e = F.col("episode_index")
    found = add(keys.duplicate_keys(b.episodes, ["episode_index"]), "LEROBOT_EPISODE_INDEX_DUPLICATE", episode_index=e, evidence=F.col("n").cast("string"))
    found = add(sequence.holes(b.episodes, [], "episode_index"), "LEROBOT_EPISODE_INDEX_NON_CONTIGUOUS", episode_index=F.col("first_missing"), evidence=F.col("n_missing").cast("string"))
    names = keys.orphans(b.episodes.select("episode_index", F.explode("tasks").alias("task")), b.tasks, "task")
    found = add(names, "LEROBOT_TASK_REFERENCE_INVALID", episode_index=e, evidence=F.col("task"))
    ranges = b.relations.where("kind = 'data' AND dataset_from_index IS NOT NULL").drop("kind").join(b.episodes.select("episode_index", "length"), "episode_index", "left")
    bad = sequence.invalid_ranges(ranges, "dataset_from_index", "dataset_to_index", "length")
    found = add(bad.where("reason = 'invalid'"), "LEROBOT_EPISODE_RANGE_INVALID", episode_index=e, path=F.col("path"))
    found = add(bad.where("reason = 'length'"), "LEROBOT_EPISODE_RANGE_LENGTH_MISMATCH", episode_index=e, path=F.col("path"))
    ledger = sequence.ledger(ranges, [], "dataset_from_index", "dataset_to_index", ["episode_index", "path"])
    found = add(ledger.where("kind = 'gap'"), "LEROBOT_EPISODE_RANGE_GAP", episode_index=e, path=F.col("path"), evidence=F.col("furthest").cast("string"))
    found = add(ledger.where("kind = 'overlap'"), "LEROBOT_EPISODE_RANGE_OVERLAP", episode_index=e, path=F.col("path"), evidence=F.col("furthest").cast("string"))
    segments = b.relations.where("kind = 'video'")
    timed = segments.where("from_timestamp IS NOT NULL OR to_timestamp IS NOT NULL")
    found = add(sequence.segment_bounds(timed, "from_timestamp", "to_timestamp"), "LEROBOT_VIDEO_SEGMENT_BOUNDS_INVALID", episode_index=e, feature_key=F.col("feature_key"), path=F.col("path"), evidence=F.col("reason"))
    overlap = sequence.segment_overlaps(timed.where("to_timestamp > from_timestamp"), ["feature_key", "path"], "from_timestamp", "to_timestamp", ["episode_index"])
    found = add(overlap, "LEROBOT_VIDEO_SEGMENT_OVERLAP", episode_index=e, feature_key=F.col("feature_key"), path=F.col("path"))
    counted = b.episodes.agg(F.count(F.lit(1)).alias("n"), F.when(F.count_if(F.col("length").isNull()) == 0, F.coalesce(F.sum("length"), F.lit(0))).alias("frames")).select(F.expr("stack(2, 'episodes', n, 'frames', frames) AS (name, counted)"))
    counted = counted.unionByName(b.tasks.agg(F.lit("tasks").alias("name"), F.countDistinct("task_index").alias("counted")))
    counted = counted.unionByName(segments.where("path_exists").agg(F.lit("videos").alias("name"), F.countDistinct("path").alias("counted")))
    totals = keys.declared_against(metadata.declared_totals(b.info), counted).where("counted IS NOT NULL")
    for name, code in (("episodes", "LEROBOT_EPISODE_COUNT_MISMATCH"), ("frames", "LEROBOT_FRAME_COUNT_MISMATCH"), ("tasks", "LEROBOT_TASK_COUNT_MISMATCH"), ("videos", "LEROBOT_VIDEO_COUNT_MISMATCH")):
        found = add(totals.where(F.col("name") == name), code, evidence=F.concat_ws("/", "declared", "counted"))
    return found


def schema_findings(features: DataFrame, footers: DataFrame) -> DataFrame:
    """Declared features against the columns of each shard: missing, undeclared, type and shape."""
    shards = footers.where("error IS NULL").select("path", F.explode("columns").alias("c")).select("path", F.col("c.name").alias("feature"), "c.type", F.col("c.shape").alias("actual"), F.col("c.nullable").alias("actual_nullable"))
    stored = features.where("dtype NOT IN ('video', 'image')")
    wanted = footers.where("error IS NULL").select("path").join(F.broadcast(stored), how="cross")
    missing = wanted.join(shards.select("path", "feature"), ["path", "feature"], "left_anti")
    extra = shards.join(F.broadcast(features.select("feature")), "feature", "left_anti").where(~F.col("feature").isin("index", "episode_index", "frame_index", "timestamp", "task_index"))
    both = shards.join(F.broadcast(stored), "feature")
    alias = {"float": "float32", "double": "float64", "halffloat": "float16", "large_string": "string", "utf8": "string", "str": "string", "boolean": "bool"}
    canon = lambda c: F.coalesce(F.create_map(*[F.lit(x) for p in alias.items() for x in p])[c], c)
    declared = F.when(F.col("dtype") == "int", F.when(canon(F.col("type")).isin("int8", "int16", "int32", "int64"), canon(F.col("type"))).otherwise("int64")).otherwise(canon(F.col("dtype")))
    scalar = F.col("feature").isin("index", "episode_index", "frame_index", "timestamp", "task_index", "global_index") & (F.to_json("shape") == "[1]") & (F.size("actual") == 0)
    one = F.col("feature"), F.col("path")
    out = model.findings(missing, "LEROBOT_FEATURE_COLUMN_MISSING", feature_key=one[0], path=one[1])
    out = out.unionByName(model.findings(extra, "LEROBOT_FEATURE_COLUMN_UNDECLARED", feature_key=one[0], path=one[1]))
    out = out.unionByName(model.findings(both.where(declared != canon(F.col("type"))), "LEROBOT_FEATURE_DTYPE_MISMATCH", feature_key=one[0], path=one[1], evidence=F.col("type")))
    shape = F.col("actual").isNotNull() & F.col("shape").isNotNull() & (F.col("actual") != F.col("shape")) & ~scalar
    out = out.unionByName(model.findings(both.where(shape), "LEROBOT_FEATURE_SHAPE_MISMATCH", feature_key=one[0], path=one[1], evidence=F.to_json("actual")))
    nullable = F.col("nullable").isNotNull() & (F.col("nullable") != F.col("actual_nullable"))
    return out.unionByName(model.findings(both.where(nullable), "LEROBOT_FEATURE_NULLABILITY_MISMATCH", feature_key=one[0], path=one[1]))


def shard_findings(b: lerobot.Bundle, footers: DataFrame) -> DataFrame:
    """Index ranges against the rows that footers count."""
    ranges = b.relations.where("kind = 'data' AND dataset_from_index < dataset_to_index AND path IS NOT NULL")
    spans = sequence.shard_spans(ranges, "path", "dataset_from_index", "dataset_to_index", "episode_index", footers.where("num_rows IS NOT NULL").select("path", F.col("num_rows").alias("n_rows")))
    out = model.findings(spans.where("trailing_gap > 0"), "LEROBOT_EPISODE_RANGE_GAP", path=F.col("path"), episode_index=F.col("last_owner"), evidence=F.col("trailing_gap").cast("string"))
    return out.unionByName(model.findings(spans.where("overrun > 0"), "LEROBOT_EPISODE_RANGE_OUT_OF_BOUNDS", path=F.col("path"), episode_index=F.col("last_owner"), evidence=F.col("overrun").cast("string")))


ORDER = ["frame_index", "index", "path", "row"]


def frame_findings(rows: DataFrame, b: lerobot.Bundle, fps: float | None, whole: bool) -> DataFrame:
    """Checks over frame rows: duplicate and missing indexes, task references, time; what needs every row only when `whole`."""
    e, f = F.col("episode_index"), F.col("frame_index")
    found = model.findings(keys.duplicate_keys(rows, ["episode_index", "frame_index"]), "LEROBOT_FRAME_INDEX_DUPLICATE", episode_index=e, frame_index=f, evidence=F.col("n").cast("string"))
    add = lambda df, code, **c: found.unionByName(model.findings(df, code, **c))
    found = add(keys.duplicate_keys(rows, ["index"]), "LEROBOT_GLOBAL_INDEX_DUPLICATE", location=F.col("index").cast("string"), evidence=F.col("n").cast("string"))
    if whole:
        # holes over the whole index: each row asks for its predecessor, so no task orders all rows
        present = rows.where("index >= 0").select("index").distinct()
        lost = present.where("index > 0").join(present.select((F.col("index") + 1).alias("index")), "index", "left_anti")
        found = add(lost, "LEROBOT_GLOBAL_INDEX_NON_CONTIGUOUS", location=F.col("index").cast("string"))
        found = add(keys.gaps(rows.where("episode_index IS NOT NULL AND frame_index IS NOT NULL"), ["episode_index"], "frame_index"), "LEROBOT_FRAME_INDEX_NON_CONTIGUOUS", episode_index=e, frame_index=F.col("first_missing"), evidence=F.col("n_missing").cast("string"))
        counts = keys.row_count_mismatch(rows.where("episode_index IS NOT NULL"), b.episodes, "episode_index", "length")
        found = add(counts, "LEROBOT_EPISODE_ROW_COUNT_MISMATCH", episode_index=e, evidence=F.concat_ws("/", "expected", "observed"))
    found = add(keys.orphans(rows, b.tasks, "task_index"), "LEROBOT_TASK_REFERENCE_INVALID", episode_index=e, frame_index=f, path=F.col("path"), location=F.col("row").cast("string"), evidence=F.col("task_index").cast("string"))
    timed = rows.where(numeric.finite(F.col("timestamp")))
    found = add(sequence.non_monotonic(timed, ["episode_index"], ORDER, "timestamp"), "LEROBOT_TIMESTAMP_NON_MONOTONIC", episode_index=e, frame_index=f, path=F.col("path"))
    return add(sequence.off_grid(timed, "timestamp", "frame_index", fps or 0), "LEROBOT_TIMESTAMP_OFF_GRID", episode_index=e, frame_index=f, path=F.col("path"))


def vector_findings(rows: DataFrame, features: list[tuple[str, list[int] | None]], stats: DataFrame | None, whole: bool) -> DataFrame:
    """Shapes and finiteness of every vector feature and, when all rows were read, stored statistics against recomputed ones.

    Each check reads the rows once for all features together, however many there are.
    """
    found = model.findings(rows.limit(0), "LEROBOT_NUMERIC_NON_FINITE")
    if not features:
        return found
    spark, names = rows.sparkSession, [n for n, _ in features]
    place = ["episode_index", "frame_index", "path", "row"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("_v")) for n in names])).alias("f")
    long = rows.select(*place, each).select(*place, "f.feature", "f._v")
    feature = F.col("feature")
    odd = numeric.non_finite(long, ["feature", *place], "_v")
    found = found.unionByName(model.findings(odd, "LEROBOT_NUMERIC_NON_FINITE", feature_key=feature, location=F.concat_ws(":", "row", "dim"), **{c: F.col(c) for c in place[:3]}))
    widths = [x for n, shape in features if shape and len(shape) == 1 for x in (F.lit(n), F.lit(shape[0]))]
    if widths:
        wrong = long.where(F.col("_v").isNotNull()).groupBy("path", "feature", F.size("_v").alias("width")).agg(F.count(F.lit(1)).alias("n")).where(F.col("width") != F.create_map(*widths)[feature])
        found = found.unionByName(model.findings(wrong, "LEROBOT_FEATURE_SHAPE_MISMATCH", feature_key=feature, path=F.col("path"), evidence=F.col("width").cast("string")))
    if stats is None or not whole:
        return found
    fields = ["min", "max", "mean", "std"]
    own = stats.where(feature.isin(names))
    lost = numeric.stats_incomplete(spark.createDataFrame([(n,) for n in names], "feature string"), own.groupBy("feature").pivot("field", [*fields, "count"]).agg(F.first("value")), [*fields, "count"])
    found = found.unionByName(model.findings(lost, "LEROBOT_STATS_FIELD_MISSING", feature_key=feature, evidence=F.col("field")))
    bad = own.where(~numeric.finite(F.col("value")))
    found = found.unionByName(model.findings(bad, "LEROBOT_STATS_NON_FINITE", feature_key=feature, evidence=F.concat_ws(":", "field", "dim")))
    wide = own.where("field <> 'count'").groupBy("feature", "dim").pivot("field", fields).agg(F.first("value"))
    differs = numeric.stats_mismatch(wide, numeric.moments(long, "_v", ["feature"]), ["feature", "dim"])
    found = found.unionByName(model.findings(differs, "LEROBOT_STATS_VALUE_MISMATCH", feature_key=feature, location=F.concat_ws(":", "field", "dim"), evidence=F.concat_ws("/", "stored", "recomputed")))
    n = rows.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    counted = own.where("field = 'count'").join(F.broadcast(n), how="cross").where("value <> _n")
    return found.unionByName(model.findings(counted, "LEROBOT_STATS_COUNT_MISMATCH", feature_key=feature, evidence=F.concat_ws("/", "value", "_n")))


NUMERIC = ("float", "float16", "float32", "float64", "double", "int", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")


def audit(spark: SparkSession, root: str, integrity: str = "metadata") -> DataFrame:
    """All findings of the data set at `root`, enriched, de-duplicated and ordered.

    `metadata` looks at metadata, footers and schemas; `sample` also at the rows of the first, middle and last shard; `full` at every row.
    """
    b = lerobot.read(spark, root)
    shards = files.footers(spark, b.inventory.where("kind = 'data' AND path LIKE '%.parquet'"))
    found = metadata_findings(b).unionByName(files.footer_findings(shards)).unionByName(schema_findings(b.features, shards)).unionByName(shard_findings(b, shards))
    if integrity != "metadata":
        vectors = [(r["feature"], r["shape"]) for r in b.features.where(F.col("dtype").isin(*NUMERIC)).orderBy("feature").collect() if r["feature"] not in frames.STANDARD]
        rows = frames.read(spark, root, frames.selected(shards, integrity), [v for v, _ in vectors])
        fps = (b.info.select("fps").first() or [None])[0]
        there = b.inventory.where("path = 'meta/stats.json'").limit(1).count()
        stats = metadata.stats(spark, f"{root.rstrip('/')}/meta/stats.json") if there else None
        whole = integrity == "full"
        found = found.unionByName(frame_findings(rows, b, fps, whole)).unionByName(vector_findings(rows, vectors, stats, whole))
        if stats is None and whole:
            found = found.unionByName(model.findings(spark.range(1), "LEROBOT_STATS_MISSING", path=F.lit("meta/stats.json")))
    found = findings.enrich(found, model.registry(spark))
    return findings.ordered(findings.deduplicated(found, ["code", "path", "episode_index", "frame_index", "feature_key", "location", "evidence"], ["layer", "code"]))


def snapshot_components(b: lerobot.Bundle) -> dict[str, DataFrame]:
    """The keyed components of a portable snapshot that `changes` compares."""
    streams = b.relations.where("kind = 'video'").groupBy(F.col("feature_key").alias("stream")).agg(F.countDistinct("path").alias("n_paths"))
    return {"features": b.features, "tasks": b.tasks, "episodes": b.episodes, "video_streams": streams, "inventory": b.inventory}


def changes(before: lerobot.Bundle, after: lerobot.Bundle) -> DataFrame:
    """Classified changes between two versions."""
    x, y = snapshot_components(before), snapshot_components(after)
    text = lambda df: df.withColumn("shape", F.to_json("shape"))
    out = diff.keyed(text(x["features"]), text(y["features"]), "features", "feature", [("dtype_changed", ["dtype"]), ("shape_changed", ["shape"]), ("metadata_changed", ["normalization", "nullable"])])
    out = out.unionByName(diff.tasks(x["tasks"], y["tasks"]))
    named = lambda df: df.withColumn("tasks", F.to_json(F.array_sort("tasks")))
    out = out.unionByName(diff.keyed(named(x["episodes"]), named(y["episodes"]), "episodes", "episode_index", [("content_changed", ["length", "tasks"])]))
    out = out.unionByName(diff.keyed(x["video_streams"], y["video_streams"], "video_streams", "stream", [("metadata_changed", ["n_paths"])]))
    for kind in ("metadata", "data", "media"):
        of = lambda c: c["inventory"].where(F.col("kind") == kind)  # noqa: B023, E731
        out = out.unionByName(diff.keyed(of(x), of(y), f"inventory_{kind}", "path", [("changed", ["size_bytes"])]))
    return diff.ordered(out)
