"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after deleting every character of `[\\x20\\x09-\\x0D]`. Three stages,
each of which compares the full normalised content and never the digest alone:

1. each task combines its own rows: one entry for each content it has seen, however many copies there are;
2. the entries meet by (digest, content, salt), so a group that holds a third of all rows reaches up to
   `salts` tasks, and each of those gets at most one entry from each task of stage 1;
3. the salts' winners meet by (digest, content).

Rows meet their winner by 192 bits of two digests of the content; the winners of hot groups, at most HOT_GROUPS, are broadcast, so that their members
are not shuffled.

Null texts count as empty; empty and white-space texts form one group. Of equal texts the one with the most code points in the
original, then the smallest doc_id, stays (a null doc_id comes last). Rows that repeat a doc_id are rows of
their own: each counts in group_size, each is returned, and one row of each group is kept: of rows equal in length and doc_id, too, the first as
written down. Any bytes do: those that continue no code point count as one. An empty table gives an empty result. Only the
two named columns are read, so further columns of any name are harmless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import ASCII_SPACE, as_bytes, lean, stash, table

#: Bytes of content that a task holds for stage 1; beyond it the entries go out and the task starts afresh.
HELD_BYTES = 48_000_000
#: Groups with more than a HOT_GROUPSth of all rows, and more than HOT_ROWS, are not shuffled to their winner.
HOT_GROUPS, HOT_ROWS = 1000, 100
#: Above any HALF - doc_id.
SPAN = 10**20
HALF = 1 << 63

ENTRY = "digest binary, check binary, content binary, best decimal(38,0), n long, salt int"
MEMBER = "doc_id long, n_chars long, digest binary, check binary"


#: All bytes but the 64 that continue a code point.
_STARTS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


def _normalised(text: bytes) -> bytes:
    return text.translate(None, ASCII_SPACE)


def _digests(content: bytes) -> tuple[bytes, bytes]:
    """SHA-256, and a second digest of another family that joins members to winners along with it."""
    return hashlib.sha256(content).digest(), hashlib.blake2b(content, digest_size=8).digest()


def _length(text: bytes) -> int:
    """Code points of UTF-8: bytes that continue none. Defined for any bytes."""
    return len(text) if text.isascii() else len(text) - len(text.translate(None, _STARTS))


def _best(length: int, doc: int | None) -> int:
    """Orders by length, then by smaller doc_id, null last; one number, which Spark's hash aggregation can hold."""
    return length * SPAN + (HALF - doc if doc is not None else 0)


def _combine(salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(kept.items())
            for i in range(0, len(rows), 2000):
                part = rows[i : i + 2000]
                pairs = [_digests(c) for c, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in pairs], pa.binary()),
                        pa.array([p[1] for p in pairs], pa.binary()),
                        pa.array([c for c, _ in part], pa.binary()),
                        pa.array([Decimal(e[0]) for _, e in part], pa.decimal128(38, 0)),
                        pa.array([e[1] for _, e in part], pa.int64()),
                        pa.array([e[0] % SPAN * 2654435761 % (1 << 32) % salts for _, e in part], pa.int32()),
                    ],
                    names=["digest", "check", "content", "best", "n", "salt"],
                )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, as_bytes(batch.column(1)), strict=True):
                content, best = _normalised(text), _best(_length(text), doc)
                entry = kept.get(content)
                if entry is None:
                    kept[content] = [best, 1]
                    held += len(content) + 200
                else:
                    entry[0] = max(entry[0], best)
                    entry[1] += 1
            if held > HELD_BYTES:
                yield from out()
                kept.clear()
                held = 0
        yield from out()

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(1))
        pairs = [_digests(_normalised(t)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_length(t) for t in texts], pa.int64()), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())],
            names=["doc_id", "n_chars", "digest", "check"],
        )


def _merged(entries: DataFrame, *keys: str) -> DataFrame:
    """Best entry and count for each group of `keys`."""
    return entries.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, keep_id, group_size, kept, digest (SHA-256 of the normalised text, binary)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    entries = base.mapInArrow(lean(_combine(salts)), ENTRY)
    salted = _merged(entries, "digest", "check", "content", "salt")
    winners = _merged(salted, "digest", "check", "content").select(
        "digest",
        "check",
        F.col("n").alias("group_size"),
        F.expr(f"CAST(nullif({HALF}BD - pmod(best, {SPAN}BD), {HALF}BD) AS LONG)").alias("keep_id"),
        F.expr(f"CAST((best - pmod(best, {SPAN}BD)) / {SPAN}BD AS LONG)").alias("length"),
    )
    winners = stash(winners, "winners")
    members = base.mapInArrow(lean(_members), MEMBER)
    # groups with more than a share of all rows: at most HOT_GROUPS can be, so they are joined where their members are
    least = max(HOT_ROWS, (winners.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]) // HOT_GROUPS)
    on = ["digest", "check"]
    hot = winners.where(F.col("group_size") > least).select(*on, F.struct("group_size", "keep_id", "length").alias("hot"))
    members = members.join(F.broadcast(hot), on, "left")
    rest = members.where("hot IS NULL").join(winners.where(F.col("group_size") <= least), on).drop("hot")
    joined = rest.select("doc_id", "n_chars", *on, "group_size", "keep_id", "length").unionByName(members.where("hot IS NOT NULL").select("doc_id", "n_chars", *on, "hot.*"))
    # rows that only their place tells apart: the first of those with the winner's length and doc_id stays
    joined = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("length")))
    joined = stash(joined.select("doc_id", "n_chars", "keep_id", "group_size", "kept", *on, F.monotonically_increasing_id().alias("place")), "members")
    first = joined.where("kept").groupBy(*on).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("stays"))
    # by place, which no two rows share
    best = joined.where("kept").join(first, "place", "left").withColumn("kept", F.coalesce("stays", F.lit(False)))
    return joined.where("NOT kept").unionByName(best.drop("stays")).select("doc_id", "n_chars", "keep_id", "group_size", "kept", "digest")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
