"""Line dedup over repeated runs of lines; and over content-defined chunks.

The query (`drop_repeated_runs`) takes every two lines that follow one another as a chunk of its own, so that any run of at least two lines
that stands in an earlier document, or earlier in its own, is covered whole by chunks that repeat. Chunks meet by the hashes of both lines; all
lines meet by (hash, bytes), and a hash that two lines share drops nothing, so equality is decided on the bytes. The document with the
smallest doc_id keeps a chunk. A line that goes stays in a document with a smaller doc_id or earlier in its own.

`drop_repeated_chunks` cuts each text once instead, and finds a repeated run only where boundaries fall inside it: a rolling hash over the last WINDOW line hashes closes a chunk where it is a multiple of EVERY, so boundaries move
with the text when lines are put in or taken out; a chunk of MOST lines closes anyway. Chunks of at least two
lines meet globally by their bytes, in each task, in Spark's combining before
the shuffle and after it. Where one content stands in several documents, the one with the smallest doc_id keeps it; the
others get its 128-bit digest back, are cut again and lose that chunk. Of several copies inside one document the first stays.

A task holds the chunks it has seen once each up to HELD_BYTES, then passes them on, so a chunk that a third of all rows
share crosses the shuffle once per task. Null texts give an empty text; empty lines are lines. Rows that share a doc_id are one document: none loses what only they
share. A null doc_id comes after all others. Bytes that are no UTF-8 come back as U+FFFD in
the text. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import LAST, as_bytes, as_text, clear_of, digest16, filter_of, in_batches, item_hashes, joined, lean, maybe, mix, paired, signed, spread_join, stash, table

WINDOW, EVERY, MOST, LEAST = 2, 4, 16, 2
HELD_BYTES = 48_000_000


class Chunks:
    """Lines and chunks of a batch of texts, as arrays over all of them."""

    def __init__(self, texts: list[bytes]):
        self.data, self.edges = joined(texts)
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        hashes = item_hashes(self.data, start, end)
        self.first_line = np.searchsorted(start, self.edges)
        n = len(start)
        text = np.repeat(np.arange(len(texts)), np.diff(self.first_line))
        place = np.arange(n) - self.first_line[text]
        rolling = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            # lines before the text's first count as nothing
            before = np.concatenate([np.zeros(k, np.uint64), hashes[: n - k]]) if k else hashes
            rolling = mix(rolling + np.where(place >= k, before, np.uint64(0)))
        closes = rolling % np.uint64(EVERY) == 0
        closes[self.first_line[1:] - 1] = True
        # a chunk that has grown to MOST lines closes: count lines since the last close
        last = np.maximum.accumulate(np.where(np.concatenate([[True], closes[:-1]]), np.arange(n), 0)) if n else np.empty(0, np.int64)
        closes |= (np.arange(n) - last) % MOST == MOST - 1
        self.stop = np.flatnonzero(closes) + 1
        self.from_ = np.concatenate([[0], self.stop[:-1]]) if len(self.stop) else self.stop
        self.text = text[self.from_] if n else text
        self.lines = self.stop - self.from_
        self.low, self.high = start[self.from_], end[self.stop - 1]
        self.first = np.searchsorted(self.from_, self.first_line)

    def content(self, c: int) -> bytes:
        return self.data[self.low[c] : self.high[c]].tobytes()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, content, first, last): each content once for as long as it is held, with the smallest and largest doc_id that had it."""
    held: dict[bytes, list[int]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = list(held.items())
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([digest16(c) for c, _ in part], pa.binary()), pa.array([c for c, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], names=["name", "content", "first", "last"])

    for batch in batches:
        ids = [LAST if x is None else x for x in batch.column(0).to_pylist()]
        for at, part in in_batches(as_bytes(batch.column(1))):
            chunks = Chunks(part)
            of = chunks.text.tolist()
            for c in np.flatnonzero(chunks.lines >= LEAST).tolist():
                content, doc = chunks.content(c), ids[at + of[c]]
                seen = held.get(content)
                if seen is None:
                    held[content] = [doc, doc]
                    size += len(content) + 250
                else:
                    seen[0], seen[1] = min(seen[0], doc), max(seen[1], doc)
            if size > HELD_BYTES:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, doc) of every chunk of at least two lines."""
    for batch in batches:
        ids = np.array([LAST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
        for at, part in in_batches(as_bytes(batch.column(1))):
            chunks = Chunks(part)
            keep = np.flatnonzero(chunks.lines >= LEAST)
            yield pa.RecordBatch.from_arrays([pa.array([digest16(chunks.content(c)) for c in keep.tolist()], pa.binary()), pa.array(ids[at + chunks.text[keep]])], names=["name", "doc"])


CLEANED = "doc_id long, n_lines int, n_removed int, n_chars long, text string"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, drops = batch.column(0), batch.column(2)
        for at, part in in_batches(as_bytes(batch.column(1))):
            chunks = Chunks(part)
            texts, removed = [], []
            for k, text in enumerate(part):
                gone = set(drops[at + k].as_py() or ())
                low, high = int(chunks.first[k]), int(chunks.first[k + 1])
                own: set[bytes] = set()
                kept, lines = [], 0
                for c in range(low, high):
                    content = chunks.content(c)
                    if chunks.lines[c] >= LEAST and (content in own or gone and digest16(content) in gone):
                        lines += int(chunks.lines[c])
                        continue
                    own.add(content)
                    kept.append(content)
                texts.append(as_text(b"\n".join(kept) if lines else text))
                removed.append(lines)
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(np.diff(chunks.first_line).astype(np.int32)), pa.array(removed, pa.int32()), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], names=[x.split()[0] for x in CLEANED.split(", ")])


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed (lines), n_chars and text without the removed chunks."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    contents = base.mapInArrow(lean(_chunks), "name binary, content binary, first long, last long").groupBy("name", "content").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    repeated = contents.where("first < last").select("name", "first")
    later = base.mapInArrow(lean(_owned), "name binary, doc long").join(repeated, "name").where("doc > first").groupBy("doc").agg(F.collect_set("name").alias("drops"))
    return clear_of(base, later, _cleaned, CLEANED)


class Lines:
    """Lines of a batch of texts and the pairs of neighbours: pair p is of lines pair[p] and pair[p] + 1."""

    def __init__(self, texts: list[bytes]):
        self.data, self.edges = joined(texts)
        self.end = np.flatnonzero(self.data == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.hash = signed(item_hashes(self.data, self.start, self.end))
        self.first = np.searchsorted(self.start, self.edges)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.pair = np.flatnonzero(self.text[1:] == self.text[:-1])

    def firsts(self) -> np.ndarray:
        """For each pair the place in `pair` of the first equal one of its text."""
        a, b, t = self.hash[self.pair], self.hash[self.pair + 1], self.text[self.pair]
        order = np.lexsort((self.pair, b, a, t))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]) | (t[order[1:]] != t[order[:-1]])
        out = np.empty(len(order), np.int64)
        out[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
        return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, content) of lines, each once for as long as it is held."""
    known: dict[int, bytes] = {}
    held: set[tuple[int, bytes]] = set()
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        # held: further lines of a hash that is known
        rows = [*known.items(), *held]
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in part], pa.int64()), pa.array([c for _, c in part], pa.binary())], names=["hash", "content"])

    for batch in batches:
        for _, part in in_batches(as_bytes(batch.column(0))):
            lines = Lines(part)
            for h, content in zip(lines.hash.tolist(), (c for t in part for c in t.split(b"\n")), strict=True):
                if (seen := known.setdefault(h, content)) is content:
                    size += len(content) + 200
                elif seen != content:
                    held.add((h, content))
        if size > HELD_BYTES:
            yield from out()
            known.clear()
            held.clear()
            size = 0
    yield from out()


def _pairs(shared=None):
    """(a, b, doc): the hashes of two lines that follow one another, once for each text, and of them what the filter may know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([LAST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            for at, part in in_batches(as_bytes(batch.column(1))):
                lines = Lines(part)
                p = lines.pair[lines.firsts() == np.arange(len(lines.pair))]
                if shared is not None:
                    p = p[maybe(shared, paired(lines.hash[p], lines.hash[p + 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(lines.hash[p]), pa.array(lines.hash[p + 1]), pa.array(ids[at + lines.text[p]])], names=["a", "b", "doc"])

    return run


def _without(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsure: np.ndarray = shared.value
        for batch in batches:
            ids, drops = batch.column(0), batch.column(2)
            for at, part in in_batches(as_bytes(batch.column(1))):
                lines = Lines(part)
                p, first = lines.pair, lines.firsts()
                # a copy that overlaps the first one of its text is part of that
                drop = p - p[first] >= LEAST if len(p) else np.empty(0, bool)
                of = np.searchsorted(lines.text[p], np.arange(len(part) + 1))
                for k in range(len(part)):
                    found = drops[at + k]
                    if found.is_valid:
                        gone = set(zip(found.values.field("a").to_pylist(), found.values.field("b").to_pylist(), strict=True))
                        mine = p[of[k] : of[k + 1]]
                        drop[of[k] : of[k + 1]] |= np.fromiter((x in gone for x in zip(lines.hash[mine].tolist(), lines.hash[mine + 1].tolist(), strict=True)), bool, len(mine))
                if len(unsure):
                    drop &= ~(np.isin(lines.hash[p], unsure) | np.isin(lines.hash[p + 1], unsure))
                gone = np.zeros(len(lines.start), bool)
                gone[p[drop]] = gone[p[drop] + 1] = True
                removed = np.add.reduceat(gone.astype(np.int32), lines.first[:-1]) if len(part) else np.empty(0, np.int32)
                texts = [t if not n else b"\n".join(c for c, g in zip(t.split(b"\n"), gone[lines.first[k] : lines.first[k + 1]].tolist(), strict=True) if not g) for k, (t, n) in enumerate(zip(part, removed.tolist(), strict=True))]
                texts = [as_text(t) for t in texts]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(np.diff(lines.first).astype(np.int32)), pa.array(removed.astype(np.int32)), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], names=[x.split()[0] for x in CLEANED.split(", ")])

    return run


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed (lines), n_chars and text without the lines of repeated runs of at least two."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = base.select("text").mapInArrow(lean(_lines), "hash long, content binary").repartition("hash").groupBy("hash", "content").agg(F.count(F.lit(1)).alias("n"))
    # hashes that several different lines have: by chance a few hundred among 1e11 lines
    unsure = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash").toArrow().column("hash").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(unsure)
    pairs = base.mapInArrow(lean(_pairs()), "a long, b long, doc long")
    first = stash(pairs.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("a", "b", "first", "n"), "first")
    again = base.mapInArrow(lean(_pairs(filter_of(first.select("a", "b")))), "a long, b long, doc long")
    later = spread_join(again, first, ["a", "b"], "doc").where("doc > first").groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("drops"))
    return clear_of(base, later, _without(shared), CLEANED)


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_runs(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (SELECT doc_id, i, ls[i] AS line, ls[i + 1] AS next, len(ls) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), p AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY line, next) AS first_doc, min(i) OVER (PARTITION BY doc_id, line, next) AS first_i FROM l WHERE i < n
), g AS (SELECT doc_id, i FROM p WHERE doc_id > first_doc OR i - first_i >= 2
), gone AS (SELECT doc_id, i FROM g UNION SELECT doc_id, i + 1 FROM g
), kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id
), r AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), t AS (SELECT d.doc_id, len(ls) AS n_lines, coalesce(r.n, 0) AS n_removed, CASE WHEN r.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed, length(text) AS n_chars, text FROM t
"""
