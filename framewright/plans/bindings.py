"""The driver's tables in the roles of the episodic data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as frames: an order is an episode, a line a frame, flag and status name the shard."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("episode_index"), (F.col("l_linenumber") - 1).cast("long").alias("frame_index"), F.concat("l_returnflag", "l_linestatus").alias("shard"),
        F.col("l_returnflag").alias("camera"), F.col("l_partkey").alias("task_index"), F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("action"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as episodes; the declared length is a fixed function of the key, so some are wrong."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("stream"), (F.pmod("o_orderkey", F.lit(7)) + 1).cast("long").alias("length"), F.col("o_totalprice").alias("price"))


#: Microseconds since 1970 of a timestamp without zone, whatever the session's zone.
MICROS = "(CAST(datediff(ts, DATE'1970-01-01') AS LONG) * 86400 + hour(ts) * 3600 + minute(ts) * 60) * 1000000 + CAST(extract(SECOND FROM ts) * 1000000 AS LONG)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as time series and as half-open intervals of their value in seconds."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr(MICROS).alias("start"))
    return rows.withColumn("finish", F.col("start") + F.round(F.col("value") * 1_000_000).cast("long"))
