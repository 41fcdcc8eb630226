"""Files of a data set: layout, inventory, Parquet footers, digests, path policy.

Listing goes through Spark's binaryFile source, so any file system that Spark reads will do. Footers and digests are read on the executors by ranges, so
a footer costs its own bytes whatever the file's size; for file systems that only Spark opens whole files go through binaryFile instead. Only the
symlink policy looks at a local file system, as others have no symlinks.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import model
from framewright.functions.text import stream_of_path

# What counts as a video file.
VIDEO_SUFFIXES = ("mp4", "mov", "avi", "mkv", "webm")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), uri, size_bytes, kind (metadata, data, media, other) and stream of every file below `root`; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/").split("://")[-1].split(":", 1)[-1]
    relative = F.substring_index(F.col("path"), base.rstrip("/") + "/", -1)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select(relative.alias("path"), F.col("path").alias("uri"), F.col("length").alias("size_bytes"), suffix.alias("_suffix"))
    kind = F.when(F.col("path").startswith("meta/"), "metadata").when(F.col("_suffix").isin(*VIDEO_SUFFIXES), "media").when(F.col("path").startswith("data/"), "data").otherwise("other")
    return rows.withColumn("kind", kind).withColumn("stream", F.when(kind == "media", stream_of_path(F.col("path")))).drop("_suffix")


def detect_format(paths: DataFrame, wanted: str = "auto") -> str:
    """lerobot with meta/info.json or with both meta/ and videos/, else video; `wanted` other than auto is taken as it is."""
    if wanted not in ("auto", "video", "lerobot"):
        raise ValueError(f"unknown format {wanted}")
    if wanted != "auto":
        return wanted
    has = lambda c: F.bool_or(c)
    row = paths.agg(has(F.col("path") == "meta/info.json"), has(F.col("path").startswith("meta/")), has(F.col("path").startswith("videos/"))).first()
    return "lerobot" if row[0] or (row[1] and row[2]) else "video"


FOOTER = "path string, num_rows long, row_groups int, unfinalized boolean, columns array<struct<name string, type string, shape array<long>, nullable boolean>>, error string"


def _column(field: pa.Field) -> dict:
    """Base type and shape of an Arrow field: fixed-size lists give their sizes, a variable list none."""
    kind, shape = field.type, []
    while pa.types.is_fixed_size_list(kind) or pa.types.is_list(kind) or pa.types.is_large_list(kind):
        shape = None if shape is None or not pa.types.is_fixed_size_list(kind) else [*shape, kind.list_size]
        kind = kind.value_type
    return {"name": field.name, "type": str(kind), "shape": shape, "nullable": field.nullable}


#: File systems that Arrow opens by range, with Arrow's name for them.
RANGED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
BLOCK = 1 << 20


def _scheme(uri: Column) -> Column:
    return F.regexp_extract(uri, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def by_range(uri: Column) -> Column:
    """Whether Arrow opens the file system of a URI."""
    return _scheme(uri).isin(*RANGED)


def opened(uri: str):
    """A file by URI for reading by ranges."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + unquote(rest).lstrip("/"))
    store, path = fs.FileSystem.from_uri(f"{RANGED[scheme]}:{rest}")
    return store.open_input_file(path)


def _footer(path: str, source) -> dict:
    """What a Parquet file's last bytes say; reads those only."""
    import pyarrow.parquet as pq

    row = {"path": path, "num_rows": None, "row_groups": None, "unfinalized": True, "columns": None, "error": None}
    try:
        with source() as f:
            size = f.size()
            f.seek(max(0, size - 4))
            row["unfinalized"] = size < 8 or f.read(4) != b"PAR1"
            meta = pq.read_metadata(f)
            row |= {"num_rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": [_column(x) for x in meta.schema.to_arrow_schema()]}
    except (pa.ArrowException, OSError) as e:
        row["error"] = f"{type(e).__name__}"
    return row


_COLUMNS = pa.struct([("name", pa.string()), ("type", pa.string()), ("shape", pa.list_(pa.int64())), ("nullable", pa.bool_())])
_FOOTERS = pa.schema([("path", pa.string()), ("num_rows", pa.int64()), ("row_groups", pa.int32()), ("unfinalized", pa.bool_()), ("columns", pa.list_(_COLUMNS)), ("error", pa.string())])


def _digest(path: str, source) -> dict:
    total = hashlib.sha256()
    with source() as f:
        while block := f.read(BLOCK):
            total.update(block)
    return {"path": path, "sha256": total.hexdigest()}


_DIGESTS = pa.schema([("path", pa.string()), ("sha256", pa.string())])


def _by_range(read, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(path, lambda uri=uri: opened(uri)) for path, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _whole(read, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(path, lambda data=data: pa.BufferReader(data.as_buffer())) for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _of_files(spark: SparkSession, files: DataFrame, read, schema: pa.Schema, ddl: str) -> DataFrame:
    """`read` over each file of (path, uri): by ranges where Arrow knows the file system, else from whole contents."""
    ranged = by_range(F.col("uri"))
    uris = files.select("path", "uri")
    found = uris.where(ranged).repartition("uri").mapInArrow(_by_range(read, schema), ddl)
    others = [r["uri"] for r in uris.where(~ranged).select("uri").collect()]
    if not others:
        return found
    content = spark.read.format("binaryFile").load(others).select(F.col("path").alias("uri"), "content")
    return found.unionByName(content.join(uris, "uri").select("path", "content").mapInArrow(_whole(read, schema), ddl))


def footers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The footers of the Parquet files of an inventory (path, uri): what Arrow declares, which Spark's own reader widens; a broken file gives a row with its error."""
    return _of_files(spark, files, _footer, _FOOTERS, FOOTER)


def footer_findings(found: DataFrame) -> DataFrame:
    """Unfinalized and unreadable shards as findings."""
    a = model.findings(found.where("unfinalized"), "LEROBOT_PARQUET_UNFINALIZED", path=F.col("path"))
    b = model.findings(found.where("NOT unfinalized AND error IS NOT NULL"), "LEROBOT_PARQUET_SCHEMA_UNREADABLE", path=F.col("path"), message=F.col("error"))
    return a.unionByName(b)


def checksums(spark: SparkSession, files: DataFrame) -> DataFrame:
    """path, sha256 of whole files, a block at a time."""
    return _of_files(spark, files, _digest, _DIGESTS, "path string, sha256 string")


def path_policy(root: str, follow: bool = False) -> list[tuple[str, str]]:
    """(path, code) of a local tree: links that are skipped, broken or lead outside the root."""
    out, top = [], os.path.realpath(root)
    for folder, names, files in os.walk(root, followlinks=False):
        for name in sorted([*names, *files]):
            full = os.path.join(folder, name)
            if not os.path.islink(full):
                continue
            relative = os.path.relpath(full, root)
            target = os.path.realpath(full)
            if not os.path.exists(target):
                out.append((relative, "DATASET_SYMLINK_BROKEN"))
            elif os.path.commonpath([top, target]) != top:
                out.append((relative, "DATASET_PATH_OUTSIDE_ROOT"))
            elif not follow:
                out.append((relative, "DATASET_SYMLINK_SKIPPED"))
    return out
