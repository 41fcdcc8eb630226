"""What the training-data operators share: reading tables, cutting lineage, hashing words in bulk."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import materialised, shared_dir

#: The white space of every contract here: space and U+0009 to U+000D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: Written into the shared folder and read again: cuts the lineage and survives lost executors.
stash = materialised

__all__ = ["ASCII_SPACE", "as_bytes", "as_text", "at_leave", "by_filter", "chained", "clear_of", "digest16", "digest_columns", "filter_of", "in_batches", "item_hashes", "joined", "lean", "maybe", "mix", "paired", "shared_dir", "signed", "small_batches", "span_hashes", "spread_join", "stash", "table", "word_spans", "words_of"]


#: Rows of an Arrow batch at most; whole texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, unless they are smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: What modules keep in a worker, by module; and the module that ran there last.
_kept: dict[str, Callable[[], None]] = {}
_ran: list[str] = []


def at_leave(module: str, release: Callable[[], None]) -> None:
    """`release` gives back what `module` keeps in a worker, when the worker goes on to a function of another module."""
    _kept[module] = release


def _enter(module: str) -> None:
    if _ran and _ran[0] != module and _ran[0] in _kept:
        _kept[_ran[0]]()
        _trim()
    _ran[:] = [module]


def lean(run):
    """A function for mapInArrow that hands free memory back to the system when its task ends, as workers outlive tasks, and before it what the worker kept for another operator."""

    def wrapped(batches):
        _enter(run.__module__)
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def _trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, by whatever file system the path names."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(texts: Iterable[bytes], limit: int = 400_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `limit` bytes in all, each with the index of its first; a longer text is a run of its own."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield start, held


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest16(content: bytes) -> bytes:
    """The 128 bits that stand for a content wherever contents are not compared themselves."""
    return hashlib.blake2b(content, digest_size=16).digest()


def digest_columns(texts: list[bytes]) -> list[np.ndarray]:
    """The 128 bits of each text as two columns of Spark's long."""
    found = np.frombuffer(b"".join(map(digest16, texts)), np.int64).reshape(-1, 2)
    return [np.ascontiguousarray(found[:, k]) for k in (0, 1)]


#: Items of up to so many bytes are hashed in bulk.
LANES = 8
_LANE = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)
_STARTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def item_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, both: bool = False) -> np.ndarray:
    """64 bits for each item data[s:e], or with `both` 128 as two columns.

    Eight bytes at a time are mixed in, each step being one-to-one in them, so items of up to eight bytes and equal length never share a hash; longer than
    LANES steps, an item goes by its digest."""
    size = end - start
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))
    out = [mix(size.astype(np.uint64) + np.uint64(s)) for s in _STARTS[: 1 + both]]
    for k in range(LANES):
        on = np.flatnonzero((size > 8 * k) & (size <= 8 * LANES)) if k else np.flatnonzero(size <= 8 * LANES)
        if not len(on):
            break
        lane = eight[start[on] + 8 * k] & _LANE[np.minimum(size[on] - 8 * k, 8)]
        for h in out:
            h[on] = mix(h[on] ^ lane)
    for j in np.flatnonzero(size > 8 * LANES).tolist():
        named = np.frombuffer(digest16(data[start[j] : end[j]].tobytes()), np.uint64)
        for h, x in zip(out, named, strict=False):
            h[j] = x
    return np.stack(out, axis=1) if both else out[0]


_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64; kept up to a million, more are made for one call."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        a = np.full(n, b, np.uint64)
        a[0] = 1
        made.append(np.cumprod(a, dtype=np.uint64))
    if n <= 1_000_000:
        _powers[:] = made
    return made[0], made[1]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(ASCII_SPACE)] = True


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a newline after each, as bytes; and where each begins, with the total length last."""
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), edges


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not ASCII white space; data ends with white space."""
    space = _IS_SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        turn = np.concatenate([[0], turn])
    return turn[0::2], turn[1::2]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and for each text where its words begin, with the total last."""
    data, edges = joined([t.lower() for t in texts])
    start, end = word_spans(data)
    return item_hashes(data, start, end), np.searchsorted(start, edges)


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that follow one another; runs over the edges of texts are the caller's to drop."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : m + k]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long, bit for bit."""
    return x.view(np.int64)


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string or binary column as bytes, null as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def as_text(data: bytes) -> str:
    """UTF-8 as text; bytes that are none are read as U+FFFD."""
    return data.decode("utf-8", "replace")


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each s, e: differences of a prefix polynomial, moved to offset 0 and mixed with the length; the values are hashes themselves."""
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


#: Most bits, as a power of two, of a filter; a full filter costs time only.
FILTER_BITS = 26
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


def _slot(ids: np.ndarray, power: int) -> np.ndarray:
    return (mix(ids) >> np.uint64(64 - power)).astype(np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit value of each pair of 64-bit values, for filters."""
    return mix(a.view(np.uint64)) + b.view(np.uint64)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch of one or two long columns; null stands as LAST."""
    columns = [np.asarray(c.fill_null(LAST)).astype(np.int64).view(np.uint64) for c in batch.columns]
    return columns[0] if len(columns) == 1 else paired(*columns)


def filter_of(ids: DataFrame):
    """A broadcast filter over the one long column of `ids`, or its two as pairs, of at most 2**FILTER_BITS bits however many there are; it errs towards yes."""
    power = min(FILTER_BITS, max(12, (16 * ids.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.unique(_slot(_ids(batch), power))
            word, start = np.unique(s >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (s & 63).astype(np.uint64), start) if len(s) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(signed(bits))], names=["word", "bits"])

    words = ids.mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast((power, bits))


def maybe(shared, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter may know."""
    power, bits = shared.value
    slot = _slot(ids.view(np.uint64), power)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


#: Keys that hold more than a HOT_KEYSth of all rows are joined in SALTS parts; there are fewer than HOT_KEYS of them.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 100, 16


def spread_join(rows: DataFrame, of_key: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """`rows` joined with the one row that `of_key` has for each key; `n` in it is the number of rows with that key, and is left out.

    A hot key's rows are dealt by `spread` to SALTS parts, so that they do not meet in one task; the hot keys, fewer than HOT_KEYS, are broadcast.
    `of_key` is read more than once and should be written down.
    """
    total = of_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    marks = F.broadcast(of_key.where(hot).select(*keys, F.lit(True).alias("_hot")))
    left = rows.join(marks, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    right = of_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0)))).drop("n")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def by_filter(shared, known: bool = True):
    """For mapInArrow: the rows whose first column the filter may know, or with known=False the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(shared, _ids(batch.select([0]))) == known))

    return run


def clear_of(docs: DataFrame, found: DataFrame, clean, schema: str) -> DataFrame:
    """`docs` (doc_id, text) through `clean`, which takes them with the `drops` that `found` (doc, drops) has for them.

    Only documents that `found` may name are shuffled; the others are cleaned where they are read.
    """
    found = stash(found, "drops")
    shared = filter_of(found.select("doc"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_filter(shared, False)(batches):
            yield from clean(iter([batch.append_column("drops", pa.nulls(batch.num_rows))]))

    matched = docs.mapInArrow(by_filter(shared), docs.schema).join(found, F.coalesce(F.col("doc_id"), F.lit(LAST)) == F.col("doc"), "left")
    return docs.mapInArrow(lean(alone), schema).unionByName(matched.select("doc_id", "text", "drops").mapInArrow(lean(clean), schema))
