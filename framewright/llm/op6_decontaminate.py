"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the kept positions of a fixed mask; words at ignored positions may
differ. Each benchmark item gives a seed for each mask and offset, each text one for each mask and word.
Seeds of texts that a filter of the items' seeds, of bounded size, cannot rule out are joined with the items' seeds, salted, as
a seed may be common; the join names candidate pairs of text and item, once each however many seeds they share.

A candidate text meets its items in blocks of about BLOCK. Around the seeds that both hold the item is laid over the text
and the best-scoring aligned stretch (a match counts 1, a substituted word -1) is found; the text is contaminated by the item when that
stretch holds at least `share` of the item's words as matches and at least `least` of them (all, for a shorter item).
Words are runs of other than ASCII white space, A-Z lower-cased, and are compared by 64-bit hashes. What is held for a pair
grows with the lengths of text and item, not with their product.

Texts go by 128 bits of their digest, so copies are searched once, and rows are never matched up by doc_id: each row gives one row, whatever
ids repeat or are null. Null or empty texts and items have no words and give no
hits. Repeated items count once each by item_id; of equally good items the smallest item_id is named, a null one last. An
item shorter than the masks is sought by all its words. Any bytes do. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import as_bytes, digest_columns, filter_of, in_batches, lean, maybe, mix, paired, signed, stash, table, words_of

#: 1: the word counts; 0: any word will do.
MASKS = ("1110110111", "1101011011", "1011101101", "11111111")
SPAN = min(map(len, MASKS))
SHARE, LEAST = 0.5, 8
#: Items that a candidate text meets at once, salts of the joins, and texts whose digests a task remembers.
BLOCK, SALTS, REMEMBERED = 256, 8, 200_000


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed that begins at each word; runs over the end of a text are the caller's to drop."""
    m = len(words) - len(mask) + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, hash_of(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : k + m]
    return mix(h)


def hash_of(mask: str) -> np.uint64:
    return np.uint64(int(mask, 2) * 1_000_003 + len(mask))


def masks_of(n: int) -> list[str]:
    """The masks by which an item of n words is sought."""
    return [m for m in MASKS if len(m) <= n] if n >= SPAN else ["1" * n] * (n > 0)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """First and last index and matches of the stretch with the highest score, the longest and then the first of equal ones, by prefix sums and their running minimum."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -1))])
    low = np.minimum.accumulate(total)
    gain = total - low
    ends = np.flatnonzero(gain == gain.max())
    starts = np.searchsorted(-low, -low[ends], "left")
    k = int(np.argmax(ends - starts))
    start, end = int(starts[k]), int(ends[k])
    return start, end - 1, int(same[start:end].sum())


class Text:
    """The words of a text and, for each mask asked for, where its seeds stand."""

    def __init__(self, text: bytes):
        self.words = words_of([text])[0]
        self.sorted: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        if mask not in self.sorted:
            s = seeds(self.words, mask)
            order = np.argsort(s, kind="stable")
            self.sorted[mask] = s[order], order
        return self.sorted[mask]

    def laid(self, own: np.ndarray) -> np.ndarray:
        """The words of the text over which the first word of an item can lie, by shared seeds; negative ones before its start."""
        over = np.zeros(len(self.words) + len(own), bool)
        for mask in masks_of(len(own)):
            key, at = self.places(mask)
            s = seeds(own, mask)
            low, high = np.searchsorted(key, s, "left"), np.searchsorted(key, s, "right")
            for offset in np.flatnonzero(high > low).tolist():
                over[at[low[offset] : high[offset]] - offset + len(own)] = True
        return np.flatnonzero(over) - len(own)

    def held(self, own: np.ndarray, share: float, least: int) -> tuple[float, int, int] | None:
        """(overlap, first word, last word) of the best stretch that holds, the first of equally good ones."""
        best = None
        for lies in self.laid(own).tolist():
            a, b = max(lies, 0), min(lies + len(own), len(self.words))
            first, last, matches = best_stretch(self.words[a:b] == own[a - lies : b - lies])
            if matches >= min(least, len(own)) and matches >= share * len(own):
                case = (-matches / len(own), a + first, a + last)
                best = case if best is None else min(best, case)
                if matches == len(own):
                    break  # what follows is not better and lies further on
        return None if best is None else (-best[0], *best[1:])


ITEM = "item_id long, text binary, i1 long, i2 long, seed long"


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct seeds of each item, named by item_id and text."""
    for batch in batches:
        for at, part in in_batches(as_bytes(batch.column(1))):
            ids = batch.column(0).slice(at, len(part))
            names = digest_columns([b"%s " % str(i).encode() + t for i, t in zip(ids.to_pylist(), part, strict=True)])
            words, edges = words_of(part)
            own = [words[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            found = [np.unique(np.concatenate([np.empty(0, np.uint64), *(seeds(w, m) for m in masks_of(len(w)))])) for w in own]
            row = np.repeat(np.arange(len(part)), [len(f) for f in found])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([ids.take(take), pa.array(part, pa.binary()).take(take), *(pa.array(n[row]) for n in names), pa.array(signed(np.concatenate(found)))], names=[x.split()[0] for x in ITEM.split(", ")])


def _text_seeds(shared, masks: list[str]):
    """(d1, d2, seed): the seeds of each text that the filter may know, once for each text as long as its digest is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, part in in_batches(as_bytes(batch.column(0))):
                names = [n.tolist() for n in digest_columns(part)]
                fresh = []
                for t, name in zip(part, zip(*names, strict=True), strict=True):
                    if name not in seen:
                        seen.add(name)
                        fresh.append((t, name))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not fresh:
                    continue
                words, edges = words_of([t for t, _ in fresh])
                at, key = [], []
                for mask in masks:
                    s = seeds(words, mask)
                    hit = np.flatnonzero(maybe(shared, s))
                    text = np.searchsorted(edges, hit, "right") - 1
                    inside = hit + len(mask) <= edges[text + 1]
                    at.append(text[inside])
                    key.append(s[hit[inside]])
                found = np.unique(np.stack([np.concatenate(at).astype(np.int64), signed(np.concatenate(key))], axis=1), axis=0) if at else np.empty((0, 2), np.int64)
                name = np.array([n for _, n in fresh], np.int64).reshape(-1, 2)[found[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(name[:, 0])), pa.array(np.ascontiguousarray(name[:, 1])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["d1", "d2", "seed"])

    return run


def _needed(shared):
    """(d1, d2, text) of the texts that the filter may know, once for each as long as it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            d1, d2 = digest_columns(texts)
            rows = []
            for k in np.flatnonzero(maybe(shared, paired(d1, d2))).tolist():
                if (name := (int(d1[k]), int(d2[k]))) not in seen:
                    seen.add(name)
                    rows.append(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(d1[rows]), pa.array(d2[rows]), pa.array([texts[k] for k in rows], pa.binary())], names=["d1", "d2", "text"])

    return run


MET = "d1 long, d2 long, n_items long, item_id long, overlap double, first_word long, last_word long"


def _met(share: float, least: int):
    """Of rows (d1, d2, block, is_item, item_id, text) in order, a text before its items: what the items of a block find, as one row of MET."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, found = None, None, {}

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                item, (overlap, first, last) = min(found.items(), key=lambda x: (-x[1][0], x[0] is None, x[0] or 0))
                values = [*key[:2], len(found), item, overlap, first, last]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.float64() if n == "overlap double" else pa.int64()) for v, n in zip(values, MET.split(", "), strict=True)], names=[x.split()[0] for x in MET.split(", ")])

        for batch in batches:
            d1, d2, block, is_item, ids = (batch.column(k).to_pylist() for k in range(5))
            for k, own in enumerate(as_bytes(batch.column(5))):
                if not is_item[k]:
                    yield from out()
                    key, text, found = (d1[k], d2[k], block[k]), Text(own), {}
                    continue
                if key != (d1[k], d2[k], block[k]):
                    raise ValueError("items without their text")
                case = text.held(words_of([own])[0], share, least)
                if case is not None and (ids[k] not in found or (-case[0], *case[1:]) < (-found[ids[k]][0], *found[ids[k]][1:])):
                    found[ids[k]] = case
        yield from out()

    return run


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))


def found_items(texts: DataFrame, benchmark: DataFrame, share: float, least: int) -> DataFrame:
    """MET for each contaminated text of the one column of `texts`, named by its digest."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = stash(items.mapInArrow(lean(_item_seeds), ITEM).dropDuplicates(["i1", "i2", "seed"]), "item-seeds")
    # at most SPAN - 1 lengths are below SPAN
    short = items.where(F.octet_length("text") >= 0).select(F.size(F.split(F.trim(F.regexp_replace(F.decode("text", "ISO-8859-1"), r"[\t\n\x0b\f\r ]+", " ")), " ")).alias("n")).where(f"n < {SPAN}").distinct().collect()
    masks = [*MASKS, *("1" * r["n"] for r in sorted(short, key=lambda r: r["n"]))]
    hits = texts.mapInArrow(lean(_text_seeds(filter_of(items.select("seed")), masks)), "d1 long, d2 long, seed long")
    hits = hits.withColumn("salt", F.pmod(F.col("d1"), F.lit(SALTS)).cast("int"))
    pairs = stash(hits.join(_salted(items.select("seed", "i1", "i2")), ["seed", "salt"]).select("d1", "d2", "i1", "i2").distinct(), "candidates")
    per_text = pairs.groupBy("d1", "d2").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    whole = items.select("i1", "i2", "item_id", "text").dropDuplicates(["i1", "i2"])
    # all items of one item_id are in one block, so blocks add up
    blocked = pairs.join(per_text, ["d1", "d2"]).join(whole, ["i1", "i2"]).withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("blocks")))
    blocked = stash(blocked.select("d1", "d2", "block", F.lit(True).alias("is_item"), "item_id", "text"), "blocks")
    known = texts.mapInArrow(lean(_needed(filter_of(per_text.select("d1", "d2")))), "d1 long, d2 long, text binary").dropDuplicates(["d1", "d2"])
    heads = blocked.select("d1", "d2", "block").distinct().join(known, ["d1", "d2"]).select("d1", "d2", "block", F.lit(False).alias("is_item"), F.lit(None).cast("long").alias("item_id"), "text")
    rows = heads.unionByName(blocked).repartition("d1", "d2", "block").sortWithinPartitions("d1", "d2", "block", "is_item", "item_id")
    met = rows.mapInArrow(lean(_met(share, least)), MET)
    best = F.min(F.struct((-F.col("overlap")).alias("o"), F.col("item_id").isNull().alias("z"), "item_id", "first_word", "last_word")).alias("best")
    met = met.groupBy("d1", "d2").agg(F.sum("n_items").alias("n_items"), best)
    return stash(met.select("d1", "d2", "n_items", "best.item_id", (-F.col("best.o")).alias("overlap"), "best.first_word", "best.last_word"), "contaminated")


def _parted(docs: DataFrame, text_col: str, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` that `met` cannot name, and the others with the digest of their text and a salt in the columns given last."""
    shared, k, schema = filter_of(met.select("d1", "d2")), docs.columns.index(text_col), docs.schema
    d1, d2, salt = _free(docs, "d1"), _free(docs, "d2"), _free(docs, "salt")

    def run(known: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for batch in batches:
                names = digest_columns(as_bytes(batch.column(k)))
                keep = pa.array(maybe(shared, paired(*names)) == known)
                if known:
                    salts = (np.arange(n, n + batch.num_rows) % SALTS).astype(np.int32)
                    n += batch.num_rows
                    batch = pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, names), pa.array(salts)], names=[*batch.schema.names, d1, d2, salt])
                yield batch.filter(keep)

        return lean(rows)

    wide = docs.select("*", F.lit(0).cast("long").alias(d1), F.lit(0).cast("long").alias(d2), F.lit(0).alias(salt)).schema
    return docs.mapInArrow(run(False), schema), docs.mapInArrow(run(True), wide)


def _free(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, and of the best item: item_id, overlap (share of its words matched), first_word, last_word."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    met = found_items(base.select("text"), benchmark, share, least)
    clean, rest = _parted(base, "text", met)
    joined = rest.join(_salted(met), ["d1", "d2", "salt"], "left")
    none = {c: F.lit(None).cast("long").alias(c) for c in ("item_id", "first_word", "last_word")}
    clean = clean.select("doc_id", F.lit(False).alias("contaminated"), F.lit(0).alias("n_items"), none["item_id"], F.lit(0.0).alias("overlap"), none["first_word"], none["last_word"])
    found = joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("int").alias("n_items"), "item_id", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), "first_word", "last_word")
    return clean.unionByName(found)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that no item contaminates; null texts stay; only rows that may go are shuffled."""
    met = found_items(docs.select(F.col(text_col).alias("text")), benchmark, share, least)
    clean, rest = _parted(docs, text_col, met)
    d1, d2, salt = rest.columns[-3:]
    gone = _salted(met.select("d1", "d2")).select(F.col("d1").alias(d1), F.col("d2").alias(d2), F.col("salt").alias(salt))
    return clean.unionByName(rest.join(gone, [d1, d2, salt], "left_anti").select(*docs.columns))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
