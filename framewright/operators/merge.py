"""Merge compatibility: checks over the union of inputs, each with a status, and the decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK = ("direct", "transform_required", "unknown", "incompatible")
FAMILIES = {"float": "float16 float32 float64 float double", "integer": "int int8 int16 int32 int64 uint8 uint16 uint32 uint64", "boolean": "bool boolean", "text": "string str", "media": "video image audio"}


def family(column: str = "dtype"):
    """The family of a declared type; unknown types are their own."""
    out = F.col(column)
    for name, members in FAMILIES.items():
        out = F.when(F.col(column).isin(members.split()), name).otherwise(out)
    return out


def feature_check(features: DataFrame) -> DataFrame:
    """(feature, status, reason) over features (source, feature, dtype, shape): absent from an input or another family or shape is incompatible, another type of one family needs a transform."""
    n = features.agg(F.countDistinct("source").alias("_n"))
    stats = features.withColumn("family", family()).groupBy("feature").agg(
        F.countDistinct("source").alias("n"), F.countDistinct("family").alias("families"), F.countDistinct("dtype").alias("dtypes"), F.countDistinct(F.coalesce(F.col("shape").cast("string"), F.lit("null"))).alias("shapes")
    )
    reason = F.when(F.col("n") < F.col("_n"), "missing").when(F.col("families") > 1, "dtype_family").when(F.col("shapes") > 1, "shape").when(F.col("dtypes") > 1, "dtype")
    status = F.when(reason.isNull(), "direct").when(reason == "dtype", "transform_required").otherwise("incompatible")
    return stats.join(F.broadcast(n)).select("feature", status.alias("status"), F.coalesce(reason, F.lit("same")).alias("reason"))


def agreement(values: DataFrame, key: str, value: str, differing: str = "incompatible") -> DataFrame:
    """(key, status): direct if all inputs agree, unknown if any value is missing, else `differing`."""
    g = values.groupBy(key).agg(F.countDistinct(value).alias("n"), F.count_if(F.col(value).isNull()).alias("unknown"))
    return g.select(key, F.when(F.col("n") > 1, differing).when(F.col("unknown") > 0, "unknown").otherwise("direct").alias("status"))


def overlaps(inputs: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Keys that several inputs hold, with the number of inputs."""
    return inputs.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(source).alias("n_sources")).where("n_sources > 1")


def decision(checks: DataFrame) -> DataFrame:
    """The worst status of all checks; unknown without any."""
    rank = F.lit(None).cast("int")
    for k, c in enumerate(RANK):
        rank = F.when(F.col("status") == c, k).otherwise(rank)
    return checks.agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("checks")).select(F.when(F.col("r").isNull(), "unknown").otherwise(F.element_at(F.array(*[F.lit(c) for c in RANK]), F.coalesce("r", F.lit(0)) + 1)).alias("decision"), "checks")


def unknown_remap_keys(remap: DataFrame, tasks: DataFrame) -> DataFrame:
    """Keys of a task remap that no input declares."""
    return remap.join(tasks.select("task").distinct(), "task", "left_anti")


def merged_totals(inputs: DataFrame, merged: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, expected, actual) for totals of which the inputs' sum and the merged value differ."""
    stack = "stack({}, {}) AS (name, v)".format(len(names), ", ".join(f"'{n}', CAST({n} AS LONG)" for n in names))
    expected = inputs.select(F.expr(stack)).groupBy("name").agg(F.sum("v").alias("expected"))
    return expected.join(merged.select(F.expr(stack)).withColumnRenamed("v", "actual"), "name", "left").where("NOT expected <=> actual")


def reconcile(expected: DataFrame, actual: DataFrame, position: str, columns: Sequence[str]) -> DataFrame:
    """Positions at which the merged episodes differ from the inputs' in order: missing, unexpected or changed."""
    e = expected.select(position, F.struct(*columns).alias("e"))
    a = actual.select(position, F.struct(*columns).alias("a"))
    both = e.join(a, position, "full_outer")
    return both.where("NOT e <=> a").select(position, F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("changed").alias("kind"))


def license_check(licenses: DataFrame, markers: Sequence[str]) -> DataFrame:
    """(source, status): incompatible with a restrictive marker in the licence, unknown without a licence, else direct."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.lower("license").contains(m)
    return licenses.select("source", F.when(F.col("license").isNull() | (F.trim("license") == ""), "unknown").when(hit, "incompatible").otherwise("direct").alias("status"))


def format_check(facts: DataFrame) -> DataFrame:
    """(check, status) over inputs (source, major): one supported major version is direct, a mix of 2 and 3 needs a transform, anything else is incompatible or, if missing, unknown."""
    g = facts.agg(F.countDistinct("major").alias("n"), F.count_if(F.col("major").isNull()).alias("lost"), F.count_if(~F.col("major").isin(2, 3)).alias("other"))
    status = F.when(F.col("other") > 0, "incompatible").when(F.col("lost") > 0, "unknown").when(F.col("n") > 1, "transform_required").otherwise("direct")
    return g.select(F.lit("format_and_version").alias("check"), status.alias("status"))


def coordinates_check(contracts: DataFrame) -> DataFrame:
    """(key, status) over control contracts (source, feature, key, value): a differing coordinate or normalization is incompatible, one that some inputs state and others do not is unknown."""
    n = contracts.agg(F.countDistinct("source").alias("_n"))
    g = contracts.groupBy("feature", "key").agg(F.countDistinct("value").alias("n"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("source"))).alias("told"))
    return g.join(F.broadcast(n), how="cross").select("feature", "key", F.when(F.col("n") > 1, "incompatible").when(F.col("told") < F.col("_n"), "unknown").otherwise("direct").alias("status"))


def timing_check(streams: DataFrame) -> DataFrame:
    """(camera, status, reason) over streams (source, camera, fps, resolution, codec): a camera that an input lacks or another fps is incompatible; another resolution or codec needs a transform."""
    n = streams.agg(F.countDistinct("source").alias("_n"))
    g = streams.groupBy("camera").agg(F.countDistinct("source").alias("n"), F.countDistinct("fps").alias("fps"), F.countDistinct("resolution").alias("resolution"), F.countDistinct("codec").alias("codec"), F.count_if(F.col("fps").isNull() | F.col("resolution").isNull()).alias("lost"))
    reason = F.when(F.col("n") < F.col("_n"), "missing").when(F.col("fps") > 1, "fps").when(F.col("lost") > 0, "unknown").when(F.col("resolution") > 1, "resolution").when(F.col("codec") > 1, "codec")
    status = F.when(reason.isNull(), "direct").when(reason.isin("missing", "fps"), "incompatible").when(reason == "unknown", "unknown").otherwise("transform_required")
    return g.join(F.broadcast(n), how="cross").select("camera", status.alias("status"), F.coalesce(reason, F.lit("same")).alias("reason"))


def lineage_check(sources: DataFrame) -> DataFrame:
    """(identity, status) over sources (identity, revision): the same identity and revision twice is incompatible, an unpinned one unknown."""
    g = sources.groupBy("identity", "revision").agg(F.count(F.lit(1)).alias("n"))
    pinned = F.coalesce(F.col("revision").rlike("^[0-9a-f]{40}$"), F.lit(False))
    return g.select("identity", F.when(F.col("n") > 1, "incompatible").when(~pinned, "unknown").otherwise("direct").alias("status"))


def task_check(tasks: DataFrame, references: DataFrame) -> DataFrame:
    """(source, task, reason) over tasks (source, task_index, task) and episode references (source, task): duplicate texts, duplicate indexes, undeclared references."""
    dup = lambda c, why: tasks.groupBy("source", c).agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("_t")).where("n > 1").select("source", F.col("_t").alias("task"), F.lit(why).alias("reason"))
    lost = references.join(tasks.select("source", "task").distinct(), ["source", "task"], "left_anti").select("source", "task", F.lit("undeclared").alias("reason")).distinct()
    return dup("task", "duplicate_text").unionByName(dup("task_index", "duplicate_index")).unionByName(lost)


def task_remap(tasks: DataFrame) -> DataFrame:
    """(source, task_index, task, merged_index): one index per distinct text over all inputs, in order of text; task tables are dimensions."""
    merged = tasks.select("task").distinct()
    from framewright.operators.sequence import ordinal

    return tasks.join(ordinal(merged, ["task"], "merged_index"), "task").select("source", "task_index", "task", "merged_index")


def verification(checks: DataFrame) -> DataFrame:
    """passed if every check (check, status) passed, unverified without checks, else failed."""
    return checks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "passed").alias("bad")).select(F.when(F.col("n") == 0, "unverified").when(F.col("bad") > 0, "failed").otherwise("passed").alias("status"), "n", "bad")
