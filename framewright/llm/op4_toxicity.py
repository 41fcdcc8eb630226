"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text; they share the ordinary content, and the
toxic one adds the words that mark toxic text. A window is a word between its delimiters. Its margin is the share by which
the toxic dictionary shortens what it compresses to with the ordinary one, in steps; a carrier string that both
dictionaries hold stands before and after it, so that zstandard emits a compressed block even for a short window. The words that a
dictionary gets are chosen from labelled texts: those that occur, or hold character 5-grams that occur, in a far larger share of toxic than
of ordinary texts go to the toxic one, those in most ordinary texts to the ordinary one.

A text's evidence is the sum of its distinct windows' margins above a threshold; threshold and the monotone map from
evidence to probability are calibrated on labelled texts. The model is fitted on a bounded sample, at most `per_class` texts of each
label (smallest hash of doc_id first); every text is scored whole. Null and empty texts have no
evidence and get the lowest score. Rows of `labels` with a null in doc_id or label are left out; without labels of both
kinds every score is 0. Repeated documents get equal results. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import as_bytes, as_text, lean, table

LEVEL = 9
#: Words of a dictionary, characters of a window (a longer word is cut into such windows), windows a task keeps measured.
DICTIONARY_WORDS, WINDOW, KEPT = 1500, 48, 500_000
#: A 5-gram marks toxic text from this many texts, this share of toxic texts and this ratio of shares on.
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 3, 0.01, 20.0
#: A word that has such 5-grams, or is so marked itself, goes into the toxic dictionary from this share of toxic texts on; ordinary texts
#: may hold it, as long as the ratio of shares is reached, so a larger sample does not evict it.
WORD_SHARE = 0.003
BEFORE = bytes([*range(1, 9), *range(14, 32), *range(0x80, 0xA0)])
AFTER = bytes(range(0xC0, 0xE0))
#: A window's score is in steps of its normalised distance, for windows of at least so many compressed bytes.
STEPS, LEAST_BYTES = 16, 3
THRESHOLDS = range(1, STEPS + 1)
BINS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48)


_WORD = re.compile(r"\w+").findall


def windows(text: str) -> set[str]:
    """The distinct words, each as one window or, if long, as several that overlap by half; for training and scoring alike."""
    out = set()
    for w in set(_WORD(text.lower())):
        if len(w) <= WINDOW:
            out.add(w)
        else:
            out.update(w[i : i + WINDOW] for i in range(0, len(w), WINDOW // 2))
    return out


def grams(word: str, n: int = 5) -> set[str]:
    padded = f" {word} "
    return {padded[i : i + n] for i in range(max(1, len(padded) - n + 1))}


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: int = 1
    #: probability for evidence in [BINS[i], BINS[i+1])
    levels: list[float] = field(default_factory=lambda: [0.0] * len(BINS))

    def __post_init__(self) -> None:
        self._tools = None
        self._margins: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"toxic": self.toxic, "ordinary": self.ordinary, "threshold": self.threshold, "levels": self.levels, "_tools": None, "_margins": {}}

    def _lengths(self, window: str) -> tuple[int, int]:
        """Bytes that the window adds to an empty one, by the ordinary and by the toxic dictionary."""
        if self._tools is None:
            import zstandard as z

            make = lambda d: z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            by = make(self.ordinary).compress, make(self.toxic).compress
            empty = b"".join((BEFORE, b" ", AFTER))
            self._tools = (*by, *(len(c(empty)) for c in by))
        ordinary, toxic, o, t = self._tools
        framed = b"".join((BEFORE, f" {window} ".encode(), AFTER))
        return len(ordinary(framed)) - o, len(toxic(framed)) - t

    def _measure(self, window: str) -> int:
        o, t = self._lengths(window)
        score = round(STEPS * (o - t) / o) if o >= LEAST_BYTES else 0
        if len(self._margins) >= KEPT:
            self._margins.clear()
        self._margins[window] = score
        return score

    def margins(self, text: str) -> list[int]:
        known, measure = self._margins.get, self._measure
        return [m if (m := known(w)) is not None else measure(w) for w in windows(text)]

    def evidence(self, text: str) -> int:
        least = self.threshold - 1
        return sum(m - least for m in self.margins(text) if m > least)

    def score(self, text: str) -> float:
        if not self.toxic:
            return 0.0
        e = self.evidence(text)
        k = int(np.searchsorted(BINS, e, "right")) - 1
        low, high = self.levels[k], self.levels[min(k + 1, len(BINS) - 1)]
        top = BINS[k + 1] if k + 1 < len(BINS) else 2 * BINS[k]
        # within a bin the score rises by less than the step to the next
        return low + (high - low) * 0.5 * (min(e, top) - BINS[k]) / (top - BINS[k])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, item, toxic, texts): document frequencies of words (w) and 5-grams (g) by label."""
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for start in range(0, batch.num_rows, 500):
            counts = {(kind, t): Counter() for kind in "wg" for t in (0, 1)}
            for toxic, raw in zip(labels[start : start + 500], as_bytes(batch.column(1).slice(start, 500)), strict=True):
                words = windows(as_text(raw))
                counts["w", toxic].update(words)
                counts["g", toxic].update(set().union(*map(grams, words)) if words else ())
            for (kind, toxic), c in counts.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c)), pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["kind", "item", "toxic", "n"])


def _evidence(shared):
    """(toxic, found): for each text its evidence under every threshold of THRESHOLDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            found = []
            for raw in as_bytes(batch.column(1)):
                m = np.array(model.margins(as_text(raw)), np.int64)
                found.append([int(np.maximum(m - (t - 1), 0).sum()) for t in THRESHOLDS])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "found"])

    return run


def _rising(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of p."""
    blocks: list[list[float]] = []
    for value, w in zip(p, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in blocks])


def _with_words(chosen: list[str], ordinary: list[str]) -> Model:
    """zstandard finds what stands last in a dictionary at the smallest distance."""
    common = (" ".join(reversed(ordinary)) + " ").encode("utf-8", "surrogatepass") + BEFORE + AFTER
    return Model((" " + " ".join(reversed(chosen)) + " ").encode("utf-8", "surrogatepass") + common, common)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 8000) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); at most per_class texts of each label."""
    spark = docs.sparkSession
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    seen = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen.get(0) or not seen.get(1):
        return Model()
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = marked.where("toxic = 1").orderBy(*by_hash).limit(per_class).unionByName(marked.where("toxic = 0").orderBy(*by_hash).limit(per_class))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text").dropDuplicates()
    counts = texts.mapInArrow(lean(_word_counts), "kind string, item string, toxic int, n long").groupBy("kind", "item").agg(F.sum(F.expr("CASE WHEN toxic = 1 THEN n ELSE 0 END")).alias("t"), F.sum(F.expr("CASE WHEN toxic = 0 THEN n ELSE 0 END")).alias("o"))
    n1, n0 = min(per_class, seen[1]), min(per_class, seen[0])
    counts = counts.withColumn("ratio", (F.col("t") / n1) / ((F.col("o") + 0.5) / n0)).where(F.expr(f"kind = 'w' OR t >= {max(LEAST_TEXTS, LEAST_SHARE * n1)} AND ratio >= {LEAST_RATIO}"))
    usual = {r["item"]: r["o"] for r in counts.where("kind = 'w' AND ratio < 2").orderBy(F.desc("o"), "item").limit(4 * DICTIONARY_WORDS).collect()}
    ordinary = list(usual)[:DICTIONARY_WORDS]
    marks = {r["item"]: r["ratio"] * min(r["t"], 50) for r in counts.where("kind = 'g'").orderBy(F.desc(F.col("ratio") * F.least(F.col("t"), F.lit(50))), "item").limit(4 * DICTIONARY_WORDS).collect()}
    of_marks = counts.where(f"kind = 'w' AND ratio >= {LEAST_RATIO / 4} AND (o = 0 OR ratio >= {LEAST_RATIO}) AND t >= {max(2, WORD_SHARE * n1)}").orderBy(F.desc("t"), "item").limit(40 * DICTIONARY_WORDS)
    found = of_marks.collect()
    texts_of = {r["item"]: r["t"] for r in found}
    own = {r["item"]: r["ratio"] * min(r["t"], 50) for r in found if r["ratio"] >= LEAST_RATIO and r["t"] >= max(LEAST_TEXTS, LEAST_SHARE * n1)}
    if not marks and not own:
        return Model()
    strength = {w: max([own.get(w, 0), *(marks.get(g, 0) for g in grams(w))]) for w in texts_of}
    chosen = [w for w, x in sorted(strength.items(), key=lambda x: (-x[1], x[0])) if x > 0][:DICTIONARY_WORDS]
    model = _with_words(chosen, ordinary)
    # a chosen word that shortens a usual word whose share of ordinary texts is larger than its own of toxic texts goes out again
    against: dict[str, int] = {}
    for word, n in usual.items():
        o, t = model._lengths(word)
        if o - t > 1:
            against |= {g: max(n, against.get(g, 0)) for g in grams(word, 4)}
    model = _with_words([w for w in chosen if all(against.get(g, 0) / n0 <= texts_of[w] / n1 for g in grams(w, 4))], ordinary)
    shared = spark.sparkContext.broadcast(model)
    measured = texts.mapInArrow(lean(_evidence(shared)), "toxic int, found array<long>").groupBy("toxic", "found").agg(F.count(F.lit(1)).alias("n")).collect()
    cases = [(r["toxic"], r["found"], r["n"] * (seen[r["toxic"]] / (n1 if r["toxic"] else n0))) for r in measured]
    # the threshold under which some amount of evidence parts the labels best
    wrong = [min(sum(w for toxic, found, w in cases if (found[k] >= least) != bool(toxic)) for least in BINS[1:]) for k in range(len(THRESHOLDS))]
    best = int(np.argmin(wrong))
    model.threshold = THRESHOLDS[best]
    hit, total = np.full(len(BINS), 0.0), np.full(len(BINS), 0.0)
    for toxic, found, w in cases:
        k = int(np.searchsorted(BINS, found[best], "right")) - 1
        hit[k] += w * toxic
        total[k] += w
    prior = seen[1] / (seen[0] + seen[1])
    model.levels = [float(x) for x in np.clip(_rising((hit + prior) / (total + 1), total + 1), 0, 1)]
    model._tools, model._margins = None, {}
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            score = [model.score(as_text(t)) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score in 0..1, predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = base.mapInArrow(lean(_scored(shared)), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels op4 does not learn from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
