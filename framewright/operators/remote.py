"""Planning over a remote inventory: source names, budgets, samples and what they leave uncovered. Nothing is fetched here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import glob_regex
from framewright.operators.sequence import at_even_places, budget_prefix, ordinal, round_robin

# What a plan may take by default.
BYTES, SHARDS, EPISODES, MEDIA = 2_000_000_000, 12, 64, 9
#: Metadata that a publication is expected to state.
PUBLICATION = ("license", "pretty_name", "tags", "task_categories")


@dataclass(frozen=True)
class Budget:
    bytes: int = BYTES
    shards: int = SHARDS
    episodes: int = EPISODES
    media: int = MEDIA


def parse_sources(df: DataFrame, column: str = "source") -> DataFrame:
    """owner, name and revision of hf://datasets/owner/name@revision; null where the text is of another form, carries credentials or a query."""
    form = r"^hf://datasets/([A-Za-z0-9][A-Za-z0-9._-]*)/([A-Za-z0-9][A-Za-z0-9._-]*)(?:@([A-Za-z0-9][A-Za-z0-9._/-]*))?$"
    part = lambda k: F.nullif(F.regexp_extract(column, form, k), F.lit(""))
    return df.withColumn("owner", part(1)).withColumn("name", part(2)).withColumn("revision", part(3)).withColumn("pinned", F.coalesce(F.col("revision").rlike("^[0-9a-f]{40}$"), F.lit(False)))


def allowed(inventory: DataFrame, patterns: list[str]) -> DataFrame:
    """Files that match any of the allow-patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("path").rlike(glob_regex(p))
    return inventory.where(hit)


def conflicting_sizes(inventory: DataFrame) -> DataFrame:
    """Paths that are listed with several sizes."""
    return inventory.groupBy("path").agg(F.countDistinct("size_bytes").alias("n_sizes")).where("n_sizes > 1")


def sampled_episodes(episodes: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Evenly spread episodes, by index, up to the budget."""
    every = episodes.select("episode_index").distinct()
    n = every.count()
    if n <= budget.episodes:
        return every
    if budget.episodes <= 0:
        return every.limit(0)
    return ordinal(every, ["episode_index"], "_p").where(at_even_places(F.col("_p"), n, budget.episodes)).drop("_p")


def payload_plan(relations: DataFrame, inventory: DataFrame, episodes: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(path, kind, size_bytes, running, state): shards and videos of the sampled episodes, in order, within the budgets.

    state is selected, or budget for what the bytes, shards or media limits leave out; an unknown size stops the plan where it stands.
    """
    chosen = sampled_episodes(episodes, budget)
    wanted = relations.join(chosen, "episode_index", "left_semi").where("path IS NOT NULL").groupBy("path", "kind").agg(F.min("feature_key").alias("camera"), F.min("episode_index").alias("first"))
    sized = wanted.join(inventory.select("path", "size_bytes"), "path", "left")
    data = sized.where("kind = 'data'").orderBy("first", "path").limit(budget.shards)
    media = round_robin(sized.where("kind = 'video'"), "camera", ["first", "path"], budget.media).drop("round")
    offered = data.unionByName(media).withColumn("_k", F.when(F.col("kind") == "data", 0).otherwise(1))
    taken = budget_prefix(offered, ["_k", "first", "path"], "size_bytes", budget.bytes).select("path", "running")
    return sized.join(taken, "path", "left").select("path", "kind", "size_bytes", "running", F.when(F.col("running").isNotNull(), "selected").otherwise("budget").alias("state"))


def coverage(plan: DataFrame) -> DataFrame:
    """(kind, selected, total, status) of a plan."""
    g = plan.groupBy("kind").agg(F.count_if(F.col("state") == "selected").alias("selected"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("status", F.when(F.col("selected") == F.col("total"), "complete").when(F.col("selected") > 0, "partial").otherwise("unavailable"))


def fetched(plan: DataFrame, present: DataFrame) -> DataFrame:
    """Selected paths with whether they are there."""
    return plan.where("state = 'selected'").join(present.select("path", F.lit(True).alias("_there")), "path", "left").select("path", "kind", F.coalesce("_there", F.lit(False)).alias("there"))


def missing_publication(card: DataFrame, required: tuple[str, ...] = PUBLICATION) -> DataFrame:
    """Required keys that a card (key, value) lacks."""
    spark = card.sparkSession
    return spark.createDataFrame([(k,) for k in required], "key string").join(card.where("value IS NOT NULL AND trim(value) <> ''"), "key", "left_anti")


def suppressed(found: DataFrame, plan: DataFrame, codes: tuple[str, ...] = ("LEROBOT_DATA_MISSING", "LEROBOT_VIDEO_MISSING", "LEROBOT_DATA_SHARD_COUNT_MISMATCH", "LEROBOT_VIDEO_COUNT_MISMATCH", "LEROBOT_VIDEOS_MISSING")) -> DataFrame:
    """Findings without those that only say that a sparse plan did not fetch a file; counts over files go if the plan left anything out."""
    left = plan.where("state <> 'selected'").select("path").distinct()
    some = left.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    by_path = found.join(left.withColumn("_left", F.lit(True)), "path", "left").join(F.broadcast(some), how="cross")
    return by_path.where(~(F.col("code").isin(*codes) & (F.coalesce("_left", F.lit(False)) | (F.col("path").isNull() & (F.col("_n") > 0))))).drop("_left", "_n")
