"""Streaming checks give what the batch gives when the stream has ended."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewright.streaming import incremental


def run(spark, source, build, mode="append"):
    name = f"t{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(write(spark, source))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def write(spark, df):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/stream-{uuid.uuid4().hex}"
    df.repartition(3, "user").write.parquet(path)
    return path


def rows(spark):
    data = [(k, k % 3, 1_700_000_000 + (k // 3) * 60 - (400 if k == 20 else 0)) for k in range(60)]
    return spark.createDataFrame(data, "id long, user long, at long").withColumn("time", F.timestamp_seconds("at"))


def test_non_monotonic(spark):
    found = run(spark, rows(spark), lambda s: incremental.non_monotonic(s, "user", "id", "at"))
    assert [(r["group_key"], r["row_order"]) for r in found.collect()] == [(2, 20)]


def test_repeats(spark):
    df = rows(spark)
    found = run(spark, df.unionByName(df), lambda s: incremental.without_repeats(s, "time", ["id"], "2 hours"))
    assert found.count() == 60


def test_windows(spark):
    df = rows(spark)
    found = run(spark, df, lambda s: incremental.windowed_moments(s, "time", "id", "user", "5 minutes", "2 hours"), "complete")
    assert found.agg(F.sum("n")).first()[0] == 60
