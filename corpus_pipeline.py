"""The corpus pipeline: five stages, each over all that the one before it kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of their input. Every stage reads its own input only, but for the benchmark table.

Null, empty and white-space texts have no language and go in the first stage; called by itself, each later stage takes them as empty: one of them stays in exact
dedup, all of them in the others. Rows that share a doc_id are rows of their own, a null doc_id comes last; columns of any name pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import by_filter, filter_of, lean, shared_dir, small_batches, stash, table
from framewright.llm.op5_byte_bpe import round_trip
from framewright.llm.op6_decontaminate import without_contaminated
from framewright.llm.op7_language_id import trained_on, without_rejected
from framewright.llm.op8_jaccard_join import jaccard_components
from framewright.llm.op9_exact_dedup import exact_dedup


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` behind a key of each row that follows doc_id (null last): doc_id itself where that is unique, else numbers that are written down with the rows."""
    key, taken = "_row_key", {c.lower() for c in docs.columns}
    while key in taken:
        key = f"_{key}"
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias(key), "*")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    return stash(docs.orderBy(F.col("doc_id").asc_nulls_last(), *rest).select(F.monotonically_increasing_id().alias(key), "*"), "keyed")


def _dropped(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of keyed `docs` without those whose key `verdict` (doc_id, stays; doc_id is the key) does not let stay; only rows that may go are shuffled."""
    key = docs.columns[0]
    gone = stash(verdict.where("NOT stays").select(F.col("doc_id").alias(key)), "gone")
    shared = filter_of(gone)
    sure = docs.mapInArrow(lean(by_filter(shared, False)), docs.schema)
    rest = docs.mapInArrow(lean(by_filter(shared)), docs.schema).join(gone, key, "left_anti")
    return sure.unionByName(rest).drop(key)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go: no letters, or a cross-entropy above the language's limit."""
    small_batches(spark)
    return without_rejected(docs, trained_on(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one stays that exact dedup names."""
    small_batches(spark)
    docs = _keyed(docs)
    return _dropped(docs, exact_dedup(docs, id_col=docs.columns[0]).select("doc_id", F.col("kept").alias("stays")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts the document with the smallest doc_id stays."""
    small_batches(spark)
    docs = _keyed(docs)
    return _dropped(docs, jaccard_components(docs, id_col=docs.columns[0]).select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    import public_tokenizers

    small_batches(spark)
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("exact")


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("decontaminate", clean_of_benchmark),
    ("byte_bpe", encode),
]

#: Language models and byte-pair merges are beyond SQL; tests/llm hold both dedup stages and decontamination against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet into the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
