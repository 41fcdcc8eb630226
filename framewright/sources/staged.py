"""Frames as single named files, on any file system that Spark writes.

Tasks write part files side by side; the driver then joins their bytes into one file, text as it is and Parquet by whole row groups under one footer, so no
task and no memory holds a file's rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that the driver copies at a time.
BLOCK = 1 << 20


def _join_text(spark: SparkSession, store, parts: list, target) -> None:
    jvm = spark.sparkContext._jvm
    out = store.create(target, False)
    try:
        for part in parts:
            source = store.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, BLOCK, False)
            finally:
                source.close()
    finally:
        out.close()


def _join_parquet(spark: SparkSession, store, parts: list, target) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parquet = jvm.org.apache.parquet.hadoop
    source = lambda p: parquet.util.HadoopInputFile.fromPath(p, conf)
    reader = parquet.ParquetFileReader.open(source(parts[0]))
    about = reader.getFooter().getFileMetaData()
    reader.close()
    mode = getattr(parquet, "ParquetFileWriter$Mode").CREATE
    writer = parquet.ParquetFileWriter(parquet.util.HadoopOutputFile.fromPath(target, conf), about.getSchema(), mode, parquet.ParquetWriter.DEFAULT_BLOCK_SIZE, parquet.ParquetWriter.MAX_PADDING_SIZE_DEFAULT)
    writer.start()
    for part in parts:
        writer.appendFile(source(part))
    writer.end(about.getKeyValueMetaData())


def _as_one(spark: SparkSession, folder: str, target: str, join) -> str:
    jvm = spark.sparkContext._jvm
    source, to = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(target)
    store = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in store.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: int(p.getName().split("-")[1]))
    if not parts:
        raise ValueError(f"no part files for {target}")
    if len(parts) > 1:
        whole = jvm.org.apache.hadoop.fs.Path(f"{folder}/whole")
        join(spark, store, parts, whole)
        parts = [whole]
    store.mkdirs(to.getParent())
    if store.exists(to) or not store.rename(parts[0], to):
        raise FileExistsError(target)
    store.delete(source, True)
    return target


def as_parquet(df: DataFrame, target: str) -> str:
    """`df` as one Parquet file named `target`, which must be new."""
    folder = f"{target}.{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return _as_one(df.sparkSession, folder, target, _join_parquet)


def as_text(df: DataFrame, target: str) -> str:
    """The one string column of `df` as lines of one file named `target`, which must be new, in the order of `df`."""
    folder = f"{target}.{uuid.uuid4().hex}"
    df.write.text(folder)
    return _as_one(df.sparkSession, folder, target, _join_text)
