"""Language identification by interpolated Kneser-Ney character models, one per language.

Training counts character 5-grams of labelled texts in Spark; the driver turns the counts into one table
per order: the sorted array of the n-grams that any language has seen, with each language's log probability beside it, and
the sorted array of contexts with each language's back-off weight. A text's characters are looked up at
order 5; those not found go on to order 4 with the weight of their context, and so down to order 1. The
language with the lowest cross-entropy per character wins; ties go to the first in code-point order. A
prediction is rejected when that cross-entropy is above the language's limit, which is set from training
texts that the counts have not seen.

The classifier is fitted on a bounded sample: at most about `per_lang` texts and `bytes_per_lang` bytes of each language, chosen by a
hash of their id; counting cost and model size are bounded by it. Every text is scored whole. A text that is null or
has no letter gets `und`, score 0 and rejected. Labels that are null are not learned from; without any training text
every prediction is `und`. Repeated rows get equal results; a text's result is the same
alone, in any batch and in any order. Bytes that are no UTF-8 are read as U+FFFD, no letter. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import as_bytes, as_text, in_batches, lean, table

ORDER = 5
BITS = 12
UNKNOWN = "und"
DISCOUNT = 0.75
#: Of the sample, the share (1 in this many) that sets the limits of rejection instead of being counted.
HOLD = 8


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point: 0 for no letter, else a 12-bit symbol, the code point itself where it fits."""
    found = np.zeros(0x110000, np.uint16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.int64)
    found[letters] = np.where(letters < 0x1000, letters, 0x800 + letters % 0x7FF)
    return found


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, one space after each run of letters and nothing else; and where each text begins, with the total last."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("".join([t + "\n" for t in lowered]).encode("utf-32-le", "replace"), np.uint32)
    sym = _classes()[code]
    # the newline behind each text ends its last run, so what a text gives does not depend on its neighbours
    keep = sym != 0
    keep[1:] |= keep[:-1]
    sym[sym == 0] = 32
    ends = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    return sym[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def codes(sym: np.ndarray, edges: np.ndarray, n: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each symbol, 12 bits for each; before the first symbol of each text there are spaces."""
    at = np.arange(len(sym)) + (n - 1) * np.repeat(np.arange(1, len(edges)), np.diff(edges))
    wide = np.full(len(sym) + (n - 1) * (len(edges) - 1), 32, np.uint64)
    wide[at] = sym
    out = np.zeros(len(sym), np.uint64)
    for k in range(n):
        out = (out << np.uint64(BITS)) | wide[at - (n - 1 - k)]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, 5-gram, count) of each Arrow batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = [as_text(t) for t in as_bytes(batch.column(1))]
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for _, part in in_batches(own, 1_000_000):
                grams, n = np.unique(codes(*symbols(part)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Sorted n-gram arrays with one column of log probabilities per language."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.floor = np.zeros(len(langs), np.float32)
        self.limit = np.full(len(langs), np.inf)

    def look(self, gram: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log probability of each n-gram's last symbol after the others, a column for each language."""
        if n == 0:
            return np.broadcast_to(self.floor, (len(gram), len(self.langs)))
        mask = np.uint64((1 << (BITS * n)) - 1)
        gram = gram & mask
        keys, values = self.grams[n]
        at = np.searchsorted(keys, gram)
        at[at == len(keys)] = 0
        out = values[at]
        miss = np.flatnonzero(keys[at] != gram)
        if len(miss):
            lost = gram[miss]
            ckeys, weights = self.contexts[n]
            context = lost >> np.uint64(BITS)
            c = np.searchsorted(ckeys, context)
            c[c == len(ckeys)] = 0
            back = np.where((ckeys[c] == context)[:, None], weights[c], np.float32(0))
            out[miss] = back + self.look(lost, n - 1)
        return out

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log probability per symbol for each text and language, and the number of symbols."""
        sym, edges = symbols(texts)
        size = np.diff(edges)
        total = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(size)
        if len(some):
            # each text is added up by itself, so its sum is the same in any batch
            total[some] = np.add.reduceat(self.look(codes(sym, edges)).astype(np.float64), edges[some], axis=0)
        return total / np.maximum(size, 1)[:, None], size


def build_model(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from 5-gram counts: lower orders count the distinct symbols that precede an n-gram."""
    model = Model(langs)
    per: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {n: {} for n in range(1, ORDER + 1)}
    for k in range(len(langs)):
        own = lang == k
        g, c = gram[own], count[own].astype(np.float64)
        order = np.argsort(g)
        per[ORDER][k] = (g[order], c[order])
        for n in range(ORDER - 1, 0, -1):
            g = per[n + 1][k][0] & np.uint64((1 << (BITS * n)) - 1)
            u, c = np.unique(g, return_counts=True)
            per[n][k] = (u, c.astype(np.float64))
    vocabulary = max(2, len(np.unique(np.concatenate([per[1][k][0] for k in range(len(langs))]))) + 1)
    model.floor = np.full(len(langs), -np.log(vocabulary), np.float32)
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([per[n][k][0] for k in range(len(langs))]))
        contexts = np.unique(keys >> np.uint64(BITS))
        weights = np.zeros((len(contexts), len(langs)), np.float32)
        values = np.zeros((len(keys), len(langs)), np.float32)
        of_key = np.searchsorted(contexts, keys >> np.uint64(BITS))
        lower = np.exp(model.look(keys, n - 1).astype(np.float64))
        for k in range(len(langs)):
            g, c = per[n][k]
            at = np.searchsorted(contexts, g >> np.uint64(BITS))
            total = np.bincount(at, c, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            weights[:, k] = np.log(back)
            p = back[of_key] * lower[:, k]
            here = np.searchsorted(keys, g)
            p[here] += np.maximum(c - DISCOUNT, 0) / total[at]
            values[:, k] = np.log(p)
        model.grams[n], model.contexts[n] = (keys, values), (contexts, weights)
    return model


def _entropies(shared, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = [as_text(t) for t in as_bytes(batch.column(1))]
            for at, part in in_batches(texts, 300_000):
                mean, size = model.means(part)
                k = [langs.index(x) for x in own[at : at + len(part)]]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(-mean[np.arange(len(k)), k]), pa.array(size)], names=["k", "entropy", "size"])

    return run


def train(labelled: DataFrame, per_lang: int = 1500, bytes_per_lang: int = 64_000_000) -> tuple[Model | None, dict[str, int]]:
    """A model from rows (doc_id, text, lang), null langs left out; per_lang and bytes_per_lang bound what of a language it learns from, as shares of its texts."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    seen, size = {r["lang"]: r["n"] for r in sizes}, {r["lang"]: r["size"] for r in sizes}
    langs = sorted(seen)
    if not langs:
        return None, {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for a in langs for x in (a, min(1_000_000, -(-1_000_000 * per_lang // seen[a]), -(-1_000_000 * bytes_per_lang // max(1, size[a]))))])
    sample = rows.where(place < share[F.col("lang")])
    held = F.pmod(F.xxhash64("doc_id", F.lit("hold")), F.lit(HOLD)) == 0
    counts = sample.where(~held).select("lang", "text").mapInArrow(lean(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.select(F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int").alias("k"), "gram", "n").toArrow()
    if not got.num_rows:
        return None, seen
    k, gram, n = (got.column(c).to_numpy() for c in ("k", "gram", "n"))
    model = build_model(langs, k.astype(np.int64) - 1, gram.view(np.uint64), n)
    shared = spark.sparkContext.broadcast(model)
    limits = sample.where(held).select("lang", "text").mapInArrow(lean(_entropies(shared, langs)), "k int, entropy double, size long")
    # decimals add up to the same in any order
    limits = limits.where("size >= 20").groupBy("k").agg(F.sum(F.col("entropy").cast("decimal(20, 9)")).alias("s"), F.count(F.lit(1)).alias("n"), F.max("entropy").alias("top"))
    for r in limits.collect():
        # above all that unseen labelled text showed, and at least halfway from its mean to a uniform guess
        model.limit[r["k"]] = max(r["top"] * 1.15, (float(r["s"]) / r["n"] - float(model.floor[r["k"]])) / 2)
    return model, seen


def verdicts(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, list[float | None], np.ndarray]:
    """Language, score, entropy and rejection of each text."""
    lang, score, entropy, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), np.ones(len(texts), bool)
    if model is not None:
        mean, size = model.means(texts)
        best = mean.argmax(axis=1)
        odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(size, 40)[:, None])
        sure = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        for i, t in enumerate(texts):
            if any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t[64:])):
                lang[i], score[i], entropy[i] = model.langs[best[i]], sure[i], -mean[i, best[i]]
                rejected[i] = entropy[i] > model.limit[best[i]] and size[i] >= 20
    return lang, score, entropy, rejected


def _identified(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [as_text(t) for t in as_bytes(batch.column(1))]
            for at, part in in_batches(texts, 300_000):
                lang, score, entropy, rejected = verdicts(shared.value, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (probability among the learned languages), entropy (nats per character), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(_identified(shared)), "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def without_rejected(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose prediction is not rejected; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [as_text(t) for t in as_bytes(batch.column(k))]
            keep = [~verdicts(shared.value, part)[3] for _, part in in_batches(texts, 300_000)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.empty(0, bool)))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that op7 does not learn from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def trained_on(docs: DataFrame) -> Model | None:
    return train(docs.select("doc_id", "text", "lang").where(~held_out()))[0]


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, trained_on(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
