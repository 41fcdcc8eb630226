"""Session settings that every entry point of the engine relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "framewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `master` and `conf` override."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": os.environ.get("SHUFFLE_PARTITIONS", "8"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`; where a local master has none, one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/framewright-shared"


#: Folders below the shared one that this process has written.
_written: list[str] = []


def materialised(df: DataFrame, what: str = "frame") -> DataFrame:
    """`df` written as Parquet into the shared folder and read again.

    It cuts the lineage, survives lost executors, and fixes values that depend on how rows happen to be dealt.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input files for each task of `spread`.
PIECE = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys`, each of which must have few rows, to a task for every PIECE bytes of the files below it.

    Unlike the session's number of shuffle partitions this grows with the input, so what one task holds does not; groups and windows over more than
    these keys need no other shuffle.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    # a size that Spark does not know is given as a huge one
    known = sum(x for x in sizes if x < 1 << 60)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-known // PIECE)), *keys)


def discard(spark: SparkSession) -> int:
    """Deletes what `materialised` has written so far and gives the number of folders; for callers that have stored their results."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone
