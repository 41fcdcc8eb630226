"""Substring dedup over sliding sentence spans.

A sentence ends at a newline or after . ! ? before white space; one of over PIECE words is cut into several at words
whose hash is a multiple of 8, and after 4 * PIECE words at the latest. From every sentence on, and up to every sentence, the shortest run of at least RUN sentences and WORDS words is hashed by
its words (A-Z lower-cased, white space ignored); the one or the other covers each sentence of a repeated passage that is long enough, its closing ones too. Equal hashes meet globally: a task sends each hash once per document, Spark adds up counts and
the smallest doc_id before and after the shuffle, and each document with a larger doc_id gets the hash back.
Its text is then cut again into runs, and every sentence that a returned run covers goes, as does any run that stood earlier in
the same document. So a passage that any number of documents share stays once, in the document with the smallest doc_id.

Only links from a hash to its first document travel, never pairs of documents; the join that returns them deals the links of a very common
passage to several tasks. Runs whose 64-bit hash no other document has are left out before 128 bits, polynomials over the words' hashes, decide.
A text with fewer than RUN sentences or WORDS words is one run, so repeated short texts go whole.
Null texts give an empty text, as do texts all of whose sentences repeat. Rows that share a doc_id are one document: none of them
loses what it shares only with the others. A null doc_id comes after all others. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import LAST, as_bytes, as_text, clear_of, filter_of, in_batches, item_hashes, joined, lean, maybe, signed, span_hashes, spread_join, stash, table, word_spans

RUN, WORDS, PIECE = 2, 20, 16


class Runs:
    """Sentences and runs of a batch of texts, as arrays over all of them."""

    def __init__(self, texts: list[bytes], run: int = RUN, least: int = WORDS, piece: int = PIECE):
        self.data, self.edges = joined(texts)
        start, end = word_spans(self.data)
        first = np.searchsorted(start, self.edges)
        n = len(start)
        closing = self.data[end - 1] if n else np.empty(0, np.uint8)
        breaks = np.isin(closing, list(b".!?"))
        # a newline anywhere in the white space behind a word
        lines = np.concatenate([[0], np.cumsum(self.data == 10)])
        upto = np.append(start[1:], len(self.data)) if n else start
        breaks |= lines[upto] > lines[end] if n else breaks
        begins = np.ones(n, bool)
        begins[1:] = breaks[:-1]
        begins[first[:-1][first[:-1] < n]] = True
        both = item_hashes(np.frombuffer(self.data.tobytes().lower(), np.uint8), start, end, both=True)
        hashes = np.ascontiguousarray(both[:, 0])
        # a long sentence is cut by its content, so that pieces agree wherever the sentence began
        opened = np.flatnonzero(begins)
        length = np.diff(np.append(opened, n))
        place = np.arange(n) - np.repeat(opened, length)
        cut = (np.repeat(length, length) > piece) & ((hashes % np.uint64(8) == 0) | (place % (4 * piece) == 0))
        self.word = np.flatnonzero(begins | cut)
        self.first = np.searchsorted(self.word, first)
        self.word = np.append(self.word, n)
        self.start, self.end = start, end
        s = len(self.word) - 1
        # the run from each sentence: its last sentence is the first with enough sentences and words behind the run's start
        stop = np.maximum(np.arange(s) + run, np.searchsorted(self.word, self.word[:s] + least, "left"))
        from_ = np.flatnonzero(stop <= np.repeat(self.first[1:], np.diff(self.first)))
        # the run up to each sentence, likewise
        back = np.minimum(np.arange(1, s + 1) - run, np.searchsorted(self.word, self.word[1:] - least, "right") - 1)
        last = np.flatnonzero(back >= np.repeat(self.first[:-1], np.diff(self.first)))
        # a text too short for either is a run of its own
        low, high = self.first[:-1], self.first[1:]
        small = np.flatnonzero((high > low) & ((high - low < run) | (self.word[high] - self.word[low] < least)))
        found = np.unique(np.concatenate([from_ * (s + 1) + stop[from_], back[last] * (s + 1) + last + 1, low[small] * (s + 1) + high[small]]))
        self.from_, self.stop = found // (s + 1), found % (s + 1)
        of = self.word[self.from_], self.word[self.stop]
        self.hash, self.check = span_hashes(hashes, *of), span_hashes(np.ascontiguousarray(both[:, 1]), *of)
        self.text = np.searchsorted(self.first, self.from_, "right") - 1

    def first_in_text(self) -> np.ndarray:
        """Whether each run is the first with its hash in its text."""
        order = np.lexsort((self.from_, self.check, self.hash, self.text))
        h, c, t = self.hash[order], self.check[order], self.text[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (t[1:] != t[:-1])
        out = np.empty(len(order), bool)
        out[order] = fresh
        return out

    def covered(self, drop: np.ndarray) -> np.ndarray:
        """Sentences that the runs of `drop` cover."""
        step = np.zeros(len(self.word), np.int64)
        np.add.at(step, self.from_[drop], 1)
        np.add.at(step, self.stop[drop], -1)
        return np.cumsum(step)[:-1] > 0

    def without(self, gone: np.ndarray, k: int) -> bytes:
        """Text k without the sentences of `gone`: each goes with the white space behind it."""
        low, high = int(self.first[k]), int(self.first[k + 1])
        begin, finish = int(self.edges[k]), int(self.edges[k + 1]) - 1
        if not gone[low:high].any():
            return self.data[begin:finish].tobytes()
        at = [begin, *self.start[self.word[low + 1 : high]].tolist(), finish]
        return b"".join(self.data[a:b].tobytes() for a, b, g in zip(at[:-1], at[1:], gone[low:high].tolist(), strict=True) if not g).rstrip()


def _runs(shared=None):
    """(hash, check, doc), once for each run of a document, and of them those whose hash the filter may know; without a filter check is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([LAST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            for at, part in in_batches(as_bytes(batch.column(1))):
                runs = Runs(part)
                keep = runs.first_in_text()
                if shared is not None:
                    keep &= maybe(shared, runs.hash)
                check = signed(runs.check[keep]) if shared is not None else np.zeros(int(keep.sum()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(runs.hash[keep])), pa.array(check), pa.array(ids[at + runs.text[keep]])], names=["hash", "check", "doc"])

    return run


CLEANED = "doc_id long, n_sentences int, n_removed int, n_chars long, text string"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, drops = batch.column(0), batch.column(2)
        for at, part in in_batches(as_bytes(batch.column(1))):
            runs = Runs(part)
            drop = ~runs.first_in_text()
            for k in range(len(part)):
                found = drops[at + k]
                if found.is_valid:
                    gone = set(zip(found.values.field("hash").to_pylist(), found.values.field("check").to_pylist(), strict=True))
                    a, b = np.searchsorted(runs.text, [k, k + 1])
                    drop[a:b] |= np.fromiter((x in gone for x in zip(signed(runs.hash[a:b]).tolist(), signed(runs.check[a:b]).tolist(), strict=True)), bool, b - a)
            gone = runs.covered(drop)
            texts = [as_text(runs.without(gone, k)) for k in range(len(part))]
            total = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(part)), pa.array(np.diff(runs.first).astype(np.int32)), pa.array((total[runs.first[1:]] - total[runs.first[:-1]]).astype(np.int32)), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())],
                names=[x.split()[0] for x in CLEANED.split(", ")],
            )


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_sentences, n_removed, n_chars and text without the removed sentences."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "hash long, check long, doc long"
    span = [F.min("doc").alias("first"), F.max("doc").alias("last")]
    # 64 bits name the candidates, 128 decide
    repeated = base.mapInArrow(lean(_runs()), schema).groupBy("hash").agg(*span).where("first < last").select("hash")
    runs = stash(base.mapInArrow(lean(_runs(filter_of(stash(repeated, "repeated")))), schema), "runs")
    first = stash(runs.groupBy("hash", "check").agg(*span, F.count(F.lit(1)).alias("n")).where("first < last").select("hash", "check", "first", "n"), "first")
    later = spread_join(runs, first, ["hash", "check"], "doc").where("doc > first").groupBy("doc").agg(F.collect_set(F.struct("hash", "check")).alias("drops"))
    return clear_of(base, later, _cleaned, CLEANED)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(table(spark, sf_dir, "documents"))
