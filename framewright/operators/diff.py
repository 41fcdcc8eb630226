"""Keyed comparison of two versions and the classes of their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = ("none", "non_breaking", "material", "breaking")

# What each kind of change counts as.
CLASSES = {
    ("source", "revision_changed"): "material",
    ("format", "input_format_changed"): "breaking",
    ("format", "adapter_changed"): "breaking",
    ("format", "dataset_format_version_changed"): "breaking",
    ("format", "metadata_changed"): "non_breaking",
    ("features", "added"): "non_breaking",
    ("features", "removed"): "breaking",
    ("features", "dtype_changed"): "breaking",
    ("features", "shape_changed"): "breaking",
    ("features", "names_changed"): "non_breaking",
    ("features", "metadata_changed"): "non_breaking",
    ("tasks", "added"): "material",
    ("tasks", "removed"): "material",
    ("tasks", "task_index_remapped"): "breaking",
    ("tasks", "task_identity_remapped"): "breaking",
    ("episodes", "added"): "material",
    ("episodes", "removed"): "material",
    ("episodes", "reordered"): "material",
    ("episodes", "content_changed"): "material",
    ("episodes", "source_changed"): "non_breaking",
    ("episodes", "metadata_changed"): "non_breaking",
    ("video_streams", "added"): "non_breaking",
    ("video_streams", "removed"): "breaking",
    ("video_streams", "metadata_changed"): "material",
    ("inventory_metadata", "added"): "non_breaking",
    ("inventory_metadata", "removed"): "material",
    ("inventory_metadata", "changed"): "non_breaking",
    ("inventory_data", "added"): "material",
    ("inventory_data", "removed"): "material",
    ("inventory_data", "changed"): "material",
    ("inventory_media", "added"): "material",
    ("inventory_media", "removed"): "material",
    ("inventory_media", "changed"): "material",
    ("coverage", "changed"): "non_breaking",
}

CHANGE = "component string, kind string, path string, class string, before string, after string"


def keyed(before: DataFrame, after: DataFrame, component: str, key: str, fields: Sequence[tuple[str, Sequence[str]]], classes: dict = CLASSES) -> DataFrame:
    """Changes between two versions of a keyed component.

    `fields` names kinds and the columns each looks at; a key on one side only is added or removed. One full outer join by key,
    null-safe comparison, one row per kind that changed.
    """
    columns = sorted({c for _, cs in fields for c in cs})
    b = before.select(F.col(key).alias("_key"), *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    a = after.select(F.col(key).alias("_key"), *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    both = b.join(a, "_key", "full_outer")
    text = lambda side, cs: F.concat_ws("\x1f", *[F.coalesce(F.col(f"{side}_{c}").cast("string"), F.lit("null")) for c in cs])

    def change(when: Column, kind: str, cs: Sequence[str]) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(classes[component, kind]).alias("class"), F.when(F.col("_b"), text("b", cs)).alias("before"), F.when(F.col("_a"), text("a", cs)).alias("after")))

    changes = [change(F.col("_b").isNull(), "added", columns), change(F.col("_a").isNull(), "removed", columns)]
    for kind, cs in fields:
        differs = F.lit(False)
        for c in cs:
            differs = differs | ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
        changes.append(change(F.col("_a") & F.col("_b") & differs, kind, cs))
    rows = both.select("_key", F.explode(F.array_compact(F.array(*changes))).alias("c"))
    return rows.select(F.lit(component).alias("component"), "c.kind", F.concat(F.lit(f"/{component}/"), pointer(F.col("_key").cast("string"))).alias("path"), "c.class", "c.before", "c.after")


def pointer(c: Column) -> Column:
    """A JSON Pointer token."""
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def tasks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Task changes by text (task, task_index): added, removed, index remapped; and one index with another text, where neither text was remapped already."""
    by_text = keyed(before, after, "tasks", "task", [("task_index_remapped", ["task_index"])])
    moved = by_text.where("kind = 'task_index_remapped'").select(F.col("path"))
    of = lambda df, n: df.select("task_index", F.col("task").alias(n)).where("task_index IS NOT NULL")
    pairs = of(before, "b").join(of(after, "a"), "task_index").where("NOT a <=> b")
    path = lambda c: F.concat(F.lit("/tasks/"), pointer(F.col(c)))
    pairs = pairs.withColumn("pa", path("a")).withColumn("pb", path("b"))
    free = pairs.join(moved.withColumnRenamed("path", "pa"), "pa", "left_anti").join(moved.withColumnRenamed("path", "pb"), "pb", "left_anti")
    remapped = free.select(F.lit("tasks").alias("component"), F.lit("task_identity_remapped").alias("kind"), F.concat(F.lit("/tasks/"), F.col("task_index").cast("string")).alias("path"), F.lit(CLASSES["tasks", "task_identity_remapped"]).alias("class"), F.col("b").alias("before"), F.col("a").alias("after"))
    return by_text.unionByName(remapped)


def totals(before: DataFrame, after: DataFrame, payload_changed: bool = False) -> DataFrame:
    """Changed totals (name, value): features and streams grow non-breaking and shrink breaking, metadata shards shrink material, bytes are material only with the payload, all else is material."""
    both = before.select("name", F.col("value").alias("b")).join(after.select("name", F.col("value").alias("a")), "name", "full_outer").where("NOT a <=> b")
    grows = F.coalesce(F.col("a"), F.lit(0)) > F.coalesce(F.col("b"), F.lit(0))
    cls = (
        F.when(F.col("name").isin("features", "video_streams"), F.when(grows, "non_breaking").otherwise("breaking"))
        .when(F.col("name") == "metadata_shards", F.when(grows, "non_breaking").otherwise("material"))
        .when(F.col("name") == "size_bytes", F.lit("material" if payload_changed else "non_breaking"))
        .otherwise("material")
    )
    return both.select(F.lit("totals").alias("component"), F.lit("changed").alias("kind"), F.concat(F.lit("/totals/"), "name").alias("path"), cls.alias("class"), F.col("b").cast("string").alias("before"), F.col("a").cast("string").alias("after"))


def overall(changes: DataFrame) -> DataFrame:
    """The highest class, and the number of changes of each."""
    rank = F.lit(0)
    for k, c in enumerate(RANK):
        rank = F.when(F.col("class") == c, k).otherwise(rank)
    n = lambda c: F.count_if(F.col("class") == c).alias(c)
    top = changes.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"), n("breaking"), n("material"), n("non_breaking"))
    return top.select(F.element_at(F.array(*[F.lit(c) for c in RANK]), F.col("r") + 1).alias("class"), "breaking", "material", "non_breaking")


def ordered(changes: DataFrame) -> DataFrame:
    """Highest class first, then component, path, kind."""
    rank = F.lit(9)
    for k, c in enumerate(reversed(RANK)):
        rank = F.when(F.col("class") == c, k).otherwise(rank)
    return changes.orderBy(rank, "component", "path", "kind")


def component_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """changed or unchanged for each component from its fingerprints (component, fingerprint)."""
    both = before.select("component", F.col("fingerprint").alias("b")).join(after.select("component", F.col("fingerprint").alias("a")), "component", "full_outer")
    return both.select("component", F.when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed").alias("status"))


def facts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed facts (component, name, value) of source, format and coverage: the kind is <name>_changed, for coverage just changed."""
    both = before.select("component", "name", F.col("value").alias("b")).join(after.select("component", "name", F.col("value").alias("a")), ["component", "name"], "full_outer").where("NOT a <=> b")
    kind = F.when(F.col("component") == "coverage", "changed").otherwise(F.concat("name", F.lit("_changed")))
    cls = F.lit(None).cast("string")
    for (component, k), c in CLASSES.items():
        cls = F.when((F.col("component") == component) & (kind == k), c).otherwise(cls)
    return both.select("component", kind.alias("kind"), F.concat(F.lit("/"), "component", F.lit("/"), pointer(F.col("name"))).alias("path"), F.coalesce(cls, F.lit("material")).alias("class"), F.col("b").alias("before"), F.col("a").alias("after"))


def regressions(changes: DataFrame, components: Sequence[str] = ("features", "format", "video_streams")) -> DataFrame:
    """Breaking changes of the components that a merge must not break."""
    return changes.where((F.col("class") == "breaking") & F.col("component").isin(*components))
