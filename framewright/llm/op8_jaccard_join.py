"""N-gram Jaccard join by T-occurrence search.

A text's set holds its distinct 4-word shingles (64-bit hashes for the search; fewer words give one shingle of all of them).
Two texts link when 100 * |A & B| >= 85 * |A | B|, so of a set with n shingles any partner has at least
T = ceil(0.85 n). Texts with one and the same set form a class, named by 128 bits (of the shingles' bytes where there are few), and classes stand for their texts from there on.

Candidates. Shingles are ordered from rare to frequent; a set and any partner share one of the set's n - T + 1
first shingles, so only these short inverted lists are made and merged; the T - 1 others are the long lists, which are
never made. Of each list, one class, the hub (fewest rare shingles, so the original rather than its variants),
is paired with the others: no list is expanded into all pairs. Pairs whose 512-bit parity sketches differ in more bits than two linked
sets may differ in shingles are dropped; that bound is exact.

Verification. A hub meets its candidates in blocks of at most about BLOCK: the block's inverted lists are split into long and short ones, the
short ones merged by counting, candidates with at least T - L hits kept, and their missing hits found by
binary search in the L long lists (DivideSkip). A link counts when the shingles themselves, not their hashes, overlap enough.

Classes already linked need no further pairs. Lists that still hold several components get a second hub, and
what then remains apart is compared pair by pair, behind the sketches, so every pair that shares a short list is either in
one component or compared: no link is lost and nothing is capped.

Null, empty and white-space texts have empty sets, link with nothing and are their own component. Repeated rows and equal texts fall into one
class. A null doc_id belongs to its class and gets that class's component. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import as_bytes, by_filter, chained, digest16, filter_of, in_batches, lean, signed, span_hashes, spread_join, stash, table, words_of
from framewright.llm.components import components

SHINGLE = 4
PERCENT = 85
#: Frequent shingles: at least SEEN times in one task's window of PER_COUNT shingles; at most FREQUENT of them are sorted behind the others.
SEEN, PER_COUNT, FREQUENT = 2, 3_000_000, 1_000_000
SKETCH_WORDS, WIDE_FROM = 8, 512
BLOCK = 256
#: Up to so many shingles a class is named by the shingles' own bytes, beyond by their hashes.
SPELLED = 16


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, edges = words_of(texts)
    chains = chained(words, SHINGLE)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(chains[a : b - SHINGLE + 1]))
        else:
            out.append(span_hashes(words, np.array([a]), np.array([b])) if b > a else np.empty(0, np.uint64))
    return out


def shingles_of(text: bytes) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves."""
    words = text.lower().split()
    return set(zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else {tuple(words)} - {()}


def class_of(sets: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """128 bits for each whole set, as two columns; 0 for the empty one."""
    spelled = lambda t: b"\n".join(sorted(map(b" ".join, shingles_of(t))))
    names = [bytes(16) if not len(s) else digest16(s.tobytes() if len(s) > SPELLED else spelled(t)) for s, t in zip(sets, texts, strict=True)]
    return np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 512 buckets: two sets differ in at least as many shingles as sketches in bits."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def wide_sketch(s: np.ndarray) -> bytes | None:
    """For a set too large for `sketch` to tell much: parities of about half as many buckets as it has shingles, a power of two."""
    if len(s) <= WIDE_FROM:
        return None
    buckets = 1 << (len(s) - 1).bit_length() - 1
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (buckets - 1), minlength=buckets) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def wide_apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ; the longer is folded to the shorter one's buckets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, a_cls, b, b_cls) whose wide sketches, where both have one, allow a link."""
    for batch in batches:
        keep = [x is None or y is None or wide_apart(x, y) <= most for x, y, most in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
        yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))


def least_overlap(n: int) -> int:
    """The fewest shingles that a set of n shares with any set it links to."""
    return -(-PERCENT * n // 100)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[np.ndarray], np.ndarray]]:
    """ids, texts, sets and classes"""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at, part in in_batches(as_bytes(batch.column(1))):
            sets = shingle_sets(part)
            yield ids[at : at + len(part)], part, sets, class_of(sets, part)


FIRST = "doc_id long, n long, cls long, check long, sketch binary, wide binary, shingle long, seen long"


def _named(classes: np.ndarray) -> list[pa.Array]:
    """cls and check"""
    return [pa.array(signed(np.ascontiguousarray(classes[:, k]))) for k in (0, 1)]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows: (doc_id, n, cls, check, sketch) of each text, and (shingle, seen) of shingles that several different texts of a window hold."""
    held: list[np.ndarray] = []
    size, known = 0, set()
    names = [x.split()[0] for x in FIRST.split(", ")]

    def out() -> Iterator[pa.RecordBatch]:
        s, n = np.unique(np.concatenate(held), return_counts=True)
        s, n = s[n >= SEEN], n[n >= SEEN]
        none = pa.nulls(len(s), pa.int64())
        nothing = pa.nulls(len(s), pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, none, none, nothing, nothing, pa.array(signed(s)), pa.array(n)], names=names)

    for ids, _, sets, classes in _each(batches):
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *_named(classes), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([wide_sketch(s) for s in sets], pa.binary()), none, none], names=names)
        for s, c in zip(sets, map(tuple, classes.tolist()), strict=True):
            if c not in known:
                known.add(c)
                held.append(s)
                size += len(s)
        if size > PER_COUNT:
            yield from out()
            held, size, known = [], 0, set()
    if held:
        yield from out()


class Frequency:
    """The frequent shingles, sorted, with counts; a small bitmap answers for most of the others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(keys >> np.uint64(42)).astype(np.int64)] = True

    def ranked(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """A sorted set from rare to frequent, and how many of it are rare; equally frequent shingles by hash."""
        maybe = np.flatnonzero(self.bitmap[(s >> np.uint64(42)).astype(np.int64)])
        if not len(maybe):
            return s, len(s)
        at = np.searchsorted(self.keys, s[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == s[maybe]
        often, n = maybe[hit], self.counts[at[hit]]
        rare = np.ones(len(s), bool)
        rare[often] = False
        return np.concatenate([s[rare], s[often[np.argsort(n, kind="stable")]]]), len(s) - len(often)


POSTINGS = "token long, cls long, prio long"


def _prio(rare: int, cls: int) -> int:
    return min(rare, (1 << 15) - 1) << 48 | cls & ((1 << 48) - 1)


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency: Frequency = shared.value
        seen: set[tuple[int, int]] = set()
        for _, _, sets, classes in _each(batches):
            tokens, cls, prio = [], [], []
            for s, (c, check) in zip(sets, classes.tolist(), strict=True):
                if (c, check) in seen or not len(s):
                    continue
                seen.add((c, check))
                ranked, rare = frequency.ranked(s)
                short = ranked[: len(s) - least_overlap(len(s)) + 1]
                tokens.append(short)
                cls.append(np.full(len(short), c, np.uint64))
                prio.append(np.full(len(short), _prio(rare, c), np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(signed(np.concatenate(cls))), pa.array(np.concatenate(prio))], names=["token", "cls", "prio"])

    return run


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of `sets` link to `query`, by T-occurrence search over the inverted lists of `sets`."""
    sizes = np.array([len(s) for s in sets], np.int64)
    need = -(-PERCENT * (len(query) + sizes) // (100 + PERCENT))
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    low, high = np.searchsorted(token, query, "left"), np.searchsorted(token, query, "right")
    length = high - low
    by_length = np.argsort(length, kind="stable")
    # as many long lists as half the smallest overlap asked for: candidates then need the other half from the short ones
    longest = min(int(need.min()) // 2, len(query) - 1)
    short, long = by_length[: len(query) - longest], by_length[len(query) - longest :]
    n = length[short]
    entries = np.repeat(low[short] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    hits = np.bincount(owner[entries], minlength=len(sets))
    alive = np.flatnonzero(hits >= need - longest)
    for k in long.tolist():
        if not len(alive):
            break
        own = owner[low[k] : high[k]]
        if len(own):
            at = np.searchsorted(own, alive)
            at[at == len(own)] = 0
            hits[alive] += own[at] == alive
    out = np.zeros(len(sets), bool)
    out[alive] = hits[alive] >= need[alive]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (a, block, b, text) in order; the first row of each (a, block) is the hub itself (b null).

    What the hashes link is compared shingle by shingle, so no link rests on a hash."""
    query, hub, own = None, None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        block = batch.column(1).to_pylist()
        left, right = [], []
        for at, part in in_batches(as_bytes(batch.column(3))):
            sets = shingle_sets(part)
            k = 0
            while k < len(part):
                if b[at + k] is None:
                    query, hub, own = sets[k], (a[at + k], block[at + k]), shingles_of(part[k])
                    k += 1
                    continue
                stop = k
                while stop < len(part) and b[at + stop] is not None and (a[at + stop], block[at + stop]) == hub:
                    stop += 1
                if stop == k:
                    raise ValueError("candidates without their hub")
                good = divide_skip(query, sets[k:stop])
                for j in np.flatnonzero(good).tolist():
                    other = shingles_of(part[k + j])
                    both = len(own & other)
                    if 100 * both < PERCENT * (len(own) + len(other) - both):
                        continue
                    left.append(a[at + k])
                    right.append(b[at + k + j])
                k = stop
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _links(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts link."""
    pairs = stash(pairs, "pairs")
    both = pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct()
    shared = filter_of(both)
    # a doc_id that several rows carry stands for its class by one of them; any of the class will do, so rows of other classes go
    texts = base.where("doc_id IS NOT NULL").mapInArrow(lean(_needed_texts(shared)), "doc_id long, text binary, cls long")
    per_hub = stash(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "per-hub")
    blocked = stash(spread_join(pairs, per_hub, ["a"], "b").select("a", "a_cls", "b", "b_cls", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "blocked")
    hubs = blocked.select("a", "a_cls", "block").distinct()
    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("cls").alias(f"{side}_cls"), "text").dropDuplicates([side, f"{side}_cls"])
    rows = hubs.join(of("a"), ["a", "a_cls"]).select("a", "block", F.lit(None).cast("long").alias("b"), "text").unionByName(blocked.join(of("b"), ["b", "b_cls"]).select("a", "block", "b", "text"))
    return rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(lean(_verified), "a long, b long")


def _needed_texts(shared):
    """The texts that the filter may know, with their classes; one function, so that a task needs one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _, classes in _each(by_filter(shared)(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), _named(classes)[0]], names=["doc_id", "text", "cls"])

    return run


def _apart(a: str, b: str) -> str:
    """SQL: sizes and sketches of a and b allow a link."""
    words = [f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(SKETCH_WORDS)]
    return f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) AND {' + '.join(words)} <= (({a}.n + {b}.n) * {100 - PERCENT}) div {100 + PERCENT}"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    first = stash(base.mapInArrow(lean(_first_pass), FIRST), "first")
    frequent = first.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shared = spark.sparkContext.broadcast(Frequency(frequent.column("shingle").to_numpy().view(np.uint64), frequent.column("n").to_numpy()))
    of_docs = first.where("n IS NOT NULL").select("doc_id", "n", "cls", "check", "sketch", "wide")
    parts = [F.conv(F.hex(F.substring("sketch", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"s{k}") for k in range(SKETCH_WORDS)]
    sketches = [f"s{k}" for k in range(SKETCH_WORDS)]
    # min of the sketch is any of the class: all are equal
    classes = of_docs.where("n > 0").select("doc_id", "n", "cls", "check", *parts)
    every = stash(classes.groupBy("cls", "check", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.min(s).alias(s) for s in sketches]), "class")
    # a class of rows without an id links with nothing
    classes = every.where("rep IS NOT NULL")
    wides = stash(of_docs.where("wide IS NOT NULL").select("doc_id", "cls", "wide").join(classes.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"]).select("cls", "wide").dropDuplicates(["cls"]), "wide")

    def narrowed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, a_cls, b, b_cls, most) behind the wide sketches, which only the pairs that got this far fetch."""
        pairs = pairs.join(wides.select(F.col("cls").alias("a_cls"), F.col("wide").alias("a_wide")), "a_cls", "left").join(wides.select(F.col("cls").alias("b_cls"), F.col("wide").alias("b_wide")), "b_cls", "left")
        return pairs.select("a", "a_cls", "b", "b_cls", "a_wide", "b_wide", "most").mapInArrow(lean(_near_enough), "a long, a_cls long, b long, b_cls long")

    postings = stash(base.where("doc_id IS NOT NULL").mapInArrow(lean(_postings(shared)), POSTINGS), "postings")
    hubs = postings.groupBy("token").agg(F.min("prio").alias("hub"), F.max("prio").alias("other"), F.min("cls").alias("c0"), F.max("cls").alias("c1"), F.count(F.lit(1)).alias("n")).where("hub < other OR c0 < c1").select("token", "hub", "n")
    hubs = stash(hubs, "hubs")
    shorter = postings.mapInArrow(lean(by_filter(filter_of(hubs.select("token")))), POSTINGS)
    lists = stash(spread_join(shorter, hubs, ["token"], "cls").select("token", "cls", "prio", "hub").distinct(), "lists")
    hub_of = lists.select("prio", F.col("cls").alias("hub_cls")).distinct()

    most = F.expr(f"((a.n + b.n) * {100 - PERCENT}) div {100 + PERCENT}").alias("most")

    def candidates(found: DataFrame) -> DataFrame:
        """Pairs of representatives from (hub prio, cls), behind sizes and sketches."""
        named = found.select("hub", "cls").distinct().join(hub_of, F.expr("hub = prio AND cls <> hub_cls")).select("hub_cls", "cls")
        x = named.join(classes.alias("b"), "cls").join(classes.withColumnRenamed("cls", "hub_cls").alias("a"), "hub_cls")
        return narrowed(x.where(_apart("a", "b")).select(F.col("a.rep").alias("a"), F.col("hub_cls").alias("a_cls"), F.col("b.rep").alias("b"), F.col("cls").alias("b_cls"), most))

    links = stash(_links(base, candidates(lists)), "links")
    def apart(rest: DataFrame) -> DataFrame:
        """The entries (token, cls, prio, rep, label) of lists that hold several components."""
        named = rest.join(classes.select("cls", "rep"), "cls").join(components(links), F.col("rep") == F.col("v"), "left").select("token", "cls", "prio", "rep", F.coalesce("label", "rep").alias("label"))
        named = stash(named, "named")
        mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("token", "n")
        return stash(spread_join(named, stash(mixed, "mixed-tokens"), ["token"], "cls"), "mixed")

    # a hub has met its whole list and leaves it
    rest = lists.where("prio <> hub").select("token", "cls", "prio")
    named = apart(rest)
    # the second hub: the first class of the list's largest label, so that it is of another component than at least one other
    second = named.groupBy("token").agg(F.max(F.struct("label", (-F.col("prio")).alias("p"))).alias("m"), F.count(F.lit(1)).alias("n"))
    second = stash(second.select("token", (-F.col("m.p")).alias("hub"), F.col("m.label").alias("hub_label"), "n"), "second")
    met = stash(spread_join(named, second, ["token"], "cls"), "met")
    links = stash(links.unionByName(_links(base, candidates(met.where("label <> hub_label")))), "links")
    named = apart(met.where("prio <> hub").select("token", "cls", "prio"))
    full = named.join(classes.select("cls", "n", *sketches), "cls")
    left, right = full.alias("a"), full.alias("b")
    pairs = left.join(right, F.expr(f"a.token = b.token AND a.label < b.label AND {_apart('a', 'b')}"))
    pairs = pairs.select(F.col("a.rep").alias("a"), F.col("a.cls").alias("a_cls"), F.col("b.rep").alias("b"), F.col("b.cls").alias("b_cls"), most).distinct()
    links = stash(links.unionByName(_links(base, narrowed(pairs))), "links")
    labels = components(links)
    of_class = every.join(labels, F.col("rep") == F.col("v"), "left").select("cls", "check", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"), F.col("copies").alias("n"))
    some = of_docs.select("doc_id", F.col("n").alias("n_shingles"), "cls", "check")
    alone = some.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    keys = ["cls", "check", "n_shingles"]
    named = spread_join(some.where("n_shingles > 0"), stash(of_class, "of-class"), keys, "doc_id")
    return alone.unionByName(named.select("doc_id", "n_shingles", "component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS o FROM s p JOIN s q ON p.sh = q.sh AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) m ON m.v = d.doc_id
"""
