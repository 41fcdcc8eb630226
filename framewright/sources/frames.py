"""Frame tables: shards of a data set as one frame, at the depth that an audit asks for.

Shards may drift apart in schema, so each group of shards with one column signature is read with its own
schema and the common columns are united by name. Every row carries its shard and its row number from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.sequence import sample_ends

#: Columns that checks know; what a shard lacks is null.
STANDARD = {"index": "long", "episode_index": "long", "frame_index": "long", "timestamp": "double", "task_index": "long"}


def selected(footers: DataFrame, integrity: str) -> DataFrame:
    """The readable shards that `integrity` reads rows of: none (metadata), the first, middle and last by path (sample), or all (full)."""
    good = footers.where("error IS NULL AND NOT unfinalized")
    if integrity == "metadata":
        return good.limit(0)
    if integrity == "sample":
        return sample_ends(good.select("path", "num_rows", "columns"), ["path"])
    if integrity != "full":
        raise ValueError(f"unknown integrity {integrity}")
    return good


def read(spark: SparkSession, root: str, shards: DataFrame, vectors: list[str] = []) -> DataFrame:
    """path, row, the standard columns and the vector features of the shards (path, columns).

    An `index` column is taken where there is one, else `global_index`, by presence and not by null.
    """
    by_signature: dict[str, list[str]] = {}
    for r in shards.select("path", F.to_json(F.array_sort(F.transform("columns", lambda c: F.struct(c["name"], c["type"])))).alias("s")).orderBy("path").collect():
        by_signature.setdefault(r["s"], []).append(f"{root.rstrip('/')}/{r['path']}")
    base = root.rstrip("/").split("://")[-1].split(":", 1)[-1]
    out = None
    for paths in by_signature.values():
        rows = spark.read.parquet(*paths)
        here = set(rows.columns)
        columns = [F.substring_index(F.col("_metadata.file_path"), base + "/", -1).alias("path"), (F.col("_metadata.row_index") + 1).alias("row")]
        for name, kind in STANDARD.items():
            source = name if name in here else "global_index" if name == "index" and "global_index" in here else None
            columns.append((F.col(f"`{source}`") if source else F.lit(None)).cast(kind).alias(name))
        for v in vectors:
            value = F.col(f"`{v}`") if v in here else F.lit(None)
            if v in here and not rows.schema[v].dataType.typeName() == "array":
                value = F.array(value)
            columns.append(value.cast("array<double>").alias(v))
        part = rows.select(*columns)
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = "path string, row long, " + ", ".join(f"{n} {t}" for n, t in STANDARD.items()) + "".join(f", `{v}` array<double>" for v in vectors)
        return spark.createDataFrame([], schema)
    return out
