"""JSON, JSON lines and statistics as frames that keep line numbers and turn broken input into rows instead of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.session import materialised


def json_objects(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, body (VARIANT; null if the text is no JSON object) and the text, one row per file."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    body = F.try_parse_json("text")
    return rows.withColumn("body", F.when(F.schema_of_variant(body).startswith("OBJECT"), body))


def json_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, line (from 1), text and body of every non-blank line; body is null where the line is no JSON object.

    Tasks read ranges of a file; a line's number is its place in its range behind the lines of the ranges before. The lines are written down once, as
    ranges may be dealt differently in a second read.
    """
    dealt = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("_value"), F.monotonically_increasing_id().alias("_id"))
    lines = materialised(dealt, "lines")
    ranges = lines.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    past = F.sum("_n").over(Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("path", "_start", "_first", F.coalesce(past, F.lit(0)).alias("_before"))
    line, text = F.col("_id") - F.col("_first") + F.col("_before") + 1, F.regexp_replace("_value", "\r\\z", "")
    rows = lines.join(F.broadcast(ranges), ["path", "_start"]).select("path", line.cast("long").alias("line"), text.alias("text"))
    body = F.try_parse_json("text")
    return rows.where(F.trim("text") != "").select("path", "line", "text", F.when(F.schema_of_variant(body).startswith("OBJECT"), body).alias("body"))


def get(body: str, path: str, kind: str):
    """A typed member of a VARIANT column, null where it is absent or of another type."""
    return F.try_variant_get(body, path, kind)


INFO = {
    "codebase_version": "string", "fps": "double", "total_episodes": "long", "total_frames": "long", "total_tasks": "long", "total_videos": "long",
    "chunks_size": "long", "robot_type": "string", "data_path": "string", "video_path": "string",
}


def info(spark: SparkSession, path: str) -> DataFrame:
    """The members of info.json that checks use, one row, and features as JSON text."""
    rows = json_objects(spark, path)
    return rows.select("path", F.col("body").isNotNull().alias("valid"), *[get("body", f"$.{k}", t).alias(k) for k, t in INFO.items()], F.to_json(get("body", "$.features", "variant")).alias("features"))


def features(found: DataFrame) -> DataFrame:
    """feature, dtype, shape, names, normalization and nullable of every declared feature of `info`."""
    kind = "map<string, struct<dtype: string, shape: array<bigint>, nullable: boolean, normalization: string>>"
    rows = found.select(F.explode(F.from_json("features", kind)).alias("feature", "f"))
    return rows.select("feature", "f.dtype", "f.shape", "f.nullable", "f.normalization")


def declared_totals(found: DataFrame) -> DataFrame:
    """(name, declared) of the totals in `info`."""
    return found.select(F.expr("stack(4, 'episodes', total_episodes, 'frames', total_frames, 'tasks', total_tasks, 'videos', total_videos) AS (name, declared)"))


def stats(spark: SparkSession, path: str) -> DataFrame:
    """(feature, field, dim, value) of a stats.json: min, max, mean, std as arrays or scalars; count as dim 0. A single {"stats": ...} wrapper is opened."""
    rows = json_objects(spark, path)
    opened = F.coalesce(get("body", "$.stats", "variant"), F.col("body"))
    kind = "map<string, struct<min: array<double>, max: array<double>, mean: array<double>, std: array<double>, count: array<double>>>"
    # a scalar becomes a list of one, so both forms parse alike
    text = F.regexp_replace(F.to_json(opened), r'"(min|max|mean|std|count)":(-?[0-9][0-9.eE+-]*)', r'"$1":[$2]')
    found = rows.where("body IS NOT NULL").select(F.explode(F.from_json(text, kind)).alias("feature", "s"))
    fields = ("min", "max", "mean", "std", "count")
    stack = "stack(5, {}) AS (field, v)".format(", ".join(f"'{f}', s.`{f}`" for f in fields))
    return found.select("feature", F.expr(stack)).where("v IS NOT NULL").select("feature", "field", F.posexplode("v").alias("dim", "value"))
