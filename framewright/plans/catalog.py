"""Registered queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import model
from framewright.functions import text
from framewright.operators import diff, digest, findings, gates, keys, media, merge, numeric, repair, sequence, signals
from framewright.plans.bindings import episodes, frames, read, series
from framewright.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


FRAMES = "(SELECT l_orderkey AS episode_index, CAST(l_linenumber - 1 AS BIGINT) AS frame_index, l_returnflag || l_linestatus AS shard, l_returnflag AS camera, l_partkey AS task_index FROM lineitem)"
EPISODES = "(SELECT o_orderkey AS episode_index, o_orderpriority AS task, o_orderstatus AS stream, CAST(o_orderkey % 7 + 1 AS BIGINT) AS length FROM orders)"
SERIES = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) AS start, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS finish FROM events)"

# ---------------------------------------------------------------- keys, references, totals


@query(f"SELECT episode_index, frame_index, count(*) AS n FROM {FRAMES} GROUP BY ALL HAVING count(*) > 1")
def dup_frame_keys(spark, d):
    return keys.duplicate_keys(frames(spark, d), ["episode_index", "frame_index"])


GAPS = f"""
SELECT episode_index, first_missing, frame_index - 1 AS last_missing, frame_index - first_missing AS n_missing FROM (
  SELECT episode_index, frame_index, coalesce(lag(frame_index) OVER (PARTITION BY episode_index ORDER BY frame_index), -1) + 1 AS first_missing
  FROM (SELECT DISTINCT episode_index, frame_index FROM {FRAMES})) WHERE frame_index > first_missing
"""


@query(GAPS)
def frame_gaps(spark, d):
    return keys.gaps(frames(spark, d), ["episode_index"], "frame_index")


@query(f"""
SELECT e.episode_index, n_rows, n_distinct, first, last, e.length AS expected, e.length - coalesce(inside, 0) AS n_missing, n_distinct - coalesce(inside, 0) AS n_unexpected
FROM (SELECT episode_index, count(*) AS n_rows, count(DISTINCT frame_index) AS n_distinct, min(frame_index) AS first, max(frame_index) AS last FROM {FRAMES} GROUP BY 1) f
JOIN {EPISODES} e ON e.episode_index = f.episode_index
LEFT JOIN (SELECT f.episode_index, count(DISTINCT frame_index) AS inside FROM {FRAMES} f JOIN {EPISODES} e ON e.episode_index = f.episode_index WHERE frame_index BETWEEN 0 AND length - 1 GROUP BY 1) i ON i.episode_index = f.episode_index
""")
def frame_missing_sets(spark, d):
    return keys.contiguity(frames(spark, d), ["episode_index"], "frame_index", episodes(spark, d).select("episode_index", "length"))


@query(f"SELECT episode_index FROM {EPISODES} e WHERE NOT EXISTS (SELECT 1 FROM {FRAMES} f WHERE f.episode_index = e.episode_index)")
def episodes_without_frames(spark, d):
    return keys.absent(episodes(spark, d), frames(spark, d), "episode_index").select("episode_index")


@query(f"SELECT episode_index, frame_index, task_index FROM {FRAMES} WHERE task_index NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def orphan_frames(spark, d):
    """Small parts are left out of the reference, so that their frames are orphans; every frame is checked."""
    return keys.orphans(frames(spark, d), read(spark, d, "part").where("p_size > 10"), "task_index", "p_partkey").select("episode_index", "frame_index", "task_index")


@query(f"""
SELECT e.episode_index, e.length AS expected, coalesce(n, 0) AS observed FROM {EPISODES} e
LEFT JOIN (SELECT episode_index, count(*) AS n FROM {FRAMES} GROUP BY 1) f ON f.episode_index = e.episode_index WHERE e.length <> coalesce(n, 0)
""")
def episode_row_count_mismatch(spark, d):
    return keys.row_count_mismatch(frames(spark, d), episodes(spark, d), "episode_index", "length")


@query("""
SELECT 'episodes' AS name, (SELECT count(*) FROM orders) AS counted UNION ALL SELECT 'frames', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'tasks', (SELECT count(DISTINCT o_orderpriority) FROM orders) UNION ALL SELECT 'shards', (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)
""")
def counted_totals(spark, d):
    return _counted(spark, d)


def _counted(spark, d):
    e = episodes(spark, d).agg(F.count(F.lit(1)).alias("episodes"), F.countDistinct("task").alias("tasks")).select(F.expr("stack(2, 'episodes', episodes, 'tasks', tasks) AS (name, counted)"))
    f = frames(spark, d).agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("shard").alias("shards")).select(F.expr("stack(2, 'frames', frames, 'shards', shards) AS (name, counted)"))
    return e.unionByName(f)


@query("""
SELECT 'frames' AS name, CAST(5 AS BIGINT) AS declared, (SELECT count(*) FROM lineitem) AS counted
UNION ALL SELECT 'tasks', CAST(4 AS BIGINT), (SELECT count(DISTINCT o_orderpriority) FROM orders)
""")
def declared_totals(spark, d):
    declared = spark.createDataFrame([("frames", 5), ("tasks", 4), ("shards", None)], "name string, declared long")
    return keys.declared_against(declared, _counted(spark, d))


@query(f"""
SELECT e.episode_index, c.camera FROM {EPISODES} e CROSS JOIN (SELECT DISTINCT camera FROM {FRAMES}) c
WHERE NOT EXISTS (SELECT 1 FROM {FRAMES} f WHERE f.episode_index = e.episode_index AND f.camera = c.camera)
""")
def episode_camera_coverage(spark, d):
    f = frames(spark, d)
    return keys.coverage_missing(episodes(spark, d), f, f, "episode_index", "camera")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def task_fk_check(spark, d):
    """Nations of one region are left out of the reference, so that their customers are orphans; every customer is checked."""
    return keys.orphans(read(spark, d, "customer"), read(spark, d, "nation").where("n_regionkey <> 2"), "c_nationkey", "n_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n, max(o_orderkey) - min(o_orderkey) + 1 = count(DISTINCT o_orderkey) AS contiguous FROM orders")
def key_contiguity(spark, d):
    k = F.col("episode_index")
    return episodes(spark, d).agg(F.min(k).alias("first"), F.max(k).alias("last"), F.count(F.lit(1)).alias("n"), (F.max(k) - F.min(k) + 1 == F.countDistinct(k)).alias("contiguous"))


@query("SELECT 'missing' AS side, c_nationkey AS k FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 3 = 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT 'unexpected', s_nationkey FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 EXCEPT SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0)")
def set_differences(spark, d):
    """Each side is a fixed part of its table, so that both differ; both parts are compared whole."""
    a = read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("k"))
    b = read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("k"))
    return keys.both_ways(a, b, "k")


@query("SELECT text, count(*) AS n FROM benchmark GROUP BY text HAVING count(*) > 1 UNION ALL SELECT lang, count(*) FROM documents GROUP BY lang")
def group_counts(spark, d):
    b = keys.duplicate_keys(read(spark, d, "benchmark"), ["text"])
    return b.unionByName(keys.counts(read(spark, d, "documents"), "lang").withColumnRenamed("lang", "text"))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def key_conflicts(spark, d):
    return keys.conflicts(read(spark, d, "orders"), "o_custkey", "o_orderstatus")


# ---------------------------------------------------------------- sequences

MONOTONIC = "SELECT user_id, event_id, start, previous FROM (SELECT *, lag(start) OVER (PARTITION BY user_id ORDER BY {o}) AS previous FROM {s}) WHERE start <= previous"


@query(MONOTONIC.format(o="event_id", s=SERIES))
def timestamp_monotonic(spark, d):
    return sequence.non_monotonic(series(spark, d), ["user_id"], ["event_id"], "start").select("user_id", "event_id", "start", "previous")


@query(MONOTONIC.format(o="value, event_id", s=SERIES))
def timestamp_monotonic_by_value(spark, d):
    return sequence.non_monotonic(series(spark, d), ["user_id"], ["value", "event_id"], "start").select("user_id", "event_id", "start", "previous")


@query(f"SELECT event_id, round(start / 1e6, 6) AS seconds FROM {SERIES} WHERE abs(value - event_id % 50 / 10.0) > 0.5")
def timestamp_off_grid(spark, d):
    rows = series(spark, d).withColumn("frame", F.pmod("event_id", F.lit(50)))
    return sequence.off_grid(rows, "value", "frame", 10.0, 0.5).select("event_id", F.round(F.col("start") / F.lit(1e6), 6).alias("seconds"))


SPANS = f"""
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length, min(event_type) AS event_type FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
    SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS fresh FROM {SERIES}))
GROUP BY user_id, run HAVING count(*) >= {{least}}
"""


@query(SPANS.format(least=2))
def static_spans(spark, d):
    return sequence.static_spans(series(spark, d), ["user_id"], ["event_id"], "event_type")


@query(SPANS.format(least=4))
def idle_spans(spark, d):
    return signals.idle_spans(series(spark, d), ["user_id"], ["event_id"], "event_type", 4)


@query(f"""
SELECT user_id, event_id, kind, furthest FROM (
  SELECT *, CASE WHEN start > coalesce(before, lo) THEN 'gap' WHEN start < before THEN 'overlap' END AS kind, coalesce(before, lo) AS furthest FROM (
    SELECT *, max(finish) OVER (PARTITION BY user_id ORDER BY start, finish, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, CAST(0 AS BIGINT) AS lo
    FROM {SERIES} WHERE start < finish)) WHERE kind IS NOT NULL
""")
def range_ledger(spark, d):
    return sequence.ledger(series(spark, d), ["user_id"], "start", "finish", ["event_id"]).select("user_id", "event_id", "kind", F.col("furthest").cast("long").alias("furthest"))


@query(f"""
SELECT event_type, event_id, furthest FROM (SELECT *, max(finish) OVER (PARTITION BY event_type ORDER BY start, finish, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM {SERIES})
WHERE start < furthest
""")
def segment_overlap(spark, d):
    return sequence.segment_overlaps(series(spark, d), ["event_type"], "start", "finish", ["event_id"], 0).select("event_type", "event_id", "furthest")


@query(f"""
SELECT event_type, event_id, previous_end FROM (SELECT *, lag(finish) OVER (PARTITION BY event_type ORDER BY start, finish, event_id) AS previous_end FROM {SERIES}) WHERE start < previous_end
""")
def adjacent_collisions(spark, d):
    return sequence.adjacent_collisions(series(spark, d), ["event_type"], "start", "finish", ["event_id"]).select("event_type", "event_id", "previous_end")


@query(f"""
SELECT event_type, min(start) AS low, max(finish) AS high, first(event_id ORDER BY finish DESC, start DESC, event_id DESC) AS last_owner, count(*) AS n_ranges FROM {SERIES} GROUP BY 1
""")
def shard_span(spark, d):
    return sequence.shard_spans(series(spark, d), "event_type", "start", "finish", "event_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 2 < 0 OR l_linenumber - 2 >= CAST(l_quantity AS BIGINT) THEN 'invalid' ELSE 'length' END AS reason FROM lineitem WHERE l_linenumber - 2 < 0 OR l_linenumber - 2 >= CAST(l_quantity AS BIGINT) OR CAST(l_quantity AS BIGINT) - (l_linenumber - 2) <> 20")
def range_invalid(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 2).cast("long").alias("a"), F.round("l_quantity").cast("long").alias("b"), F.lit(20).cast("long").alias("n"))
    return sequence.invalid_ranges(rows, "a", "b", "n").select("l_orderkey", "l_linenumber", "reason")


@query("SELECT event_id, CASE WHEN value > 90 THEN 'missing' WHEN value - 10 < 0 THEN 'negative' ELSE 'reversed' END AS reason FROM events WHERE value > 90 OR value - 10 < 0 OR value - 10 >= 40")
def segment_bounds(spark, d):
    rows = read(spark, d, "events").select("event_id", (F.col("value") - 10).alias("a"), F.when(F.col("value") <= 90, F.lit(40.0)).alias("b"))
    return sequence.segment_bounds(rows, "a", "b").select("event_id", "reason")


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal / 100 > n.n_regionkey * 10 + 1.0 / (n.n_nationkey + 1)")
def segment_out_of_range(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("path"), (F.col("s_acctbal") / 100).alias("finish"))
    v = read(spark, d, "nation").select(F.col("n_nationkey").alias("path"), (F.col("n_regionkey") * 10).cast("double").alias("duration"), (F.col("n_nationkey") + 1).cast("double").alias("fps"))
    return sequence.out_of_range(s, v, "path", "finish", "duration", "fps").select("s_suppkey", F.col("path").alias("n_nationkey"))


PLACE = "SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {o}) - 1 AS place, count(*) OVER (PARTITION BY {g}) AS n FROM documents"


@query(f"SELECT doc_id, lang, place FROM ({PLACE.format(g='lang', o='source, doc_id')}) WHERE place IN (0, (n - 1) // 2, n - 1)")
def sample_first_mid_last(spark, d):
    return sequence.sample_ends(read(spark, d, "documents"), ["source", "doc_id"], ["lang"]).select("doc_id", "lang", "place")


@query(f"SELECT doc_id, place FROM ({PLACE.format(g='1', o='doc_id')}) WHERE place IN (SELECT CAST(round_even(i * (n - 1) / 6.0, 0) AS BIGINT) FROM range(7) r(i), (SELECT count(*) AS n FROM documents))")
def sample_even(spark, d):
    return sequence.sample_even(read(spark, d, "documents"), ["doc_id"], 7).select("doc_id", "place")


@query(f"SELECT doc_id, lang, place AS round FROM ({PLACE.format(g='lang', o='doc_id')}) ORDER BY place, lang LIMIT 10")
def round_robin_sample(spark, d):
    return sequence.round_robin(read(spark, d, "documents"), "lang", ["doc_id"], 10).select("doc_id", "lang", "round")


@query("SELECT doc_id, n_chars, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS running FROM documents) WHERE running <= 500000")
def budget_prefix(spark, d):
    return sequence.budget_prefix(read(spark, d, "documents"), ["doc_id"], "n_chars", 500_000).select("doc_id", "n_chars", "running")


@query("SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE place % greatest(1, CAST(ceil(n / 15.0) AS BIGINT)) = 0")
def trace_stride(spark, d):
    return sequence.stride_sample(read(spark, d, "events"), ["user_id"], ["event_id"], 15).select("user_id", "event_id", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders")
def source_ordinal(spark, d):
    return sequence.ordinal(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "ordinal")


@query("SELECT b.o_orderkey, b.r AS before, a.r AS after FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) b JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders) a ON a.o_orderkey = b.o_orderkey WHERE a.r <> b.r")
def reorder_detect(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return sequence.reordered(sequence.ordinal(rows, ["o_orderkey"]), sequence.ordinal(rows, ["o_orderdate", "o_orderkey"]), "o_orderkey")


@query("SELECT conv_id, count(*) AS n_rows, count(DISTINCT turn) AS n_distinct, min(turn) AS first, max(turn) AS last, count(DISTINCT turn) AS expected, count(DISTINCT turn) - count(DISTINCT CASE WHEN turn BETWEEN 0 AND k - 1 THEN turn END) AS n_missing, count(DISTINCT turn) - count(DISTINCT CASE WHEN turn BETWEEN 0 AND k - 1 THEN turn END) AS n_unexpected FROM conversations JOIN (SELECT conv_id AS c, count(DISTINCT turn) AS k FROM conversations GROUP BY 1) ON c = conv_id GROUP BY conv_id")
def turn_contiguity(spark, d):
    return keys.contiguity(read(spark, d, "conversations"), ["conv_id"], "turn")


# ---------------------------------------------------------------- vectors and statistics

LEAVES = "(SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


@query(f"SELECT label, CAST(dim AS INT) AS dim, count(*) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(var_pop(CAST(v AS DOUBLE)), 6) AS var, round(stddev_pop(CAST(v AS DOUBLE)), 6) AS std FROM {LEAVES} GROUP BY label, dim")
def vector_moments(spark, d):
    return _rounded(numeric.moments(read(spark, d, "embeddings"), "embedding", ["label"]), 6)


def _rounded(df, digits):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query(f"SELECT CAST(dim AS INT) AS dim, round(var_pop(CAST(v AS DOUBLE)), 6) AS var FROM {LEAVES} GROUP BY dim HAVING var_pop(CAST(v AS DOUBLE)) <= 0.0155")
def near_zero_variance(spark, d):
    return _rounded(numeric.near_zero_variance(numeric.moments(read(spark, d, "embeddings"), "embedding"), 0.0155).select("dim", "var"), 6)


@query(f"SELECT vec_id, CAST(dim AS INT) AS dim FROM {LEAVES} WHERE vec_id % 5 = 0 AND dim = vec_id % 64")
def non_finite_leaves(spark, d):
    spoiled = F.transform("embedding", lambda x, i: F.when((F.pmod("vec_id", F.lit(5)) == 0) & (i == F.pmod("vec_id", F.lit(64))), F.when(F.pmod("vec_id", F.lit(2)) == 0, F.lit(float("nan"))).otherwise(F.lit(None))).otherwise(x.cast("double")))
    return numeric.non_finite(read(spark, d, "embeddings").withColumn("x", spoiled), ["vec_id"], "x").select("vec_id", "dim")


@query(f"SELECT CAST(dim AS INT) AS dim, 'mean' AS field, round(m + 0.001, 6) AS stored, round(m, 6) AS recomputed FROM (SELECT dim, avg(CAST(v AS DOUBLE)) AS m FROM {LEAVES} GROUP BY dim) WHERE dim % 9 = 0")
def stored_vs_recomputed(spark, d):
    now = numeric.moments(read(spark, d, "embeddings"), "embedding")
    stored = now.withColumn("mean", F.col("mean") + F.when(F.col("dim") % 9 == 0, 0.001).otherwise(1e-9))
    return _rounded(numeric.stats_mismatch(stored, now), 6)


@query("SELECT CAST(len(embedding) AS INT) AS width, count(*) AS n FROM embeddings WHERE len(embedding) <> 32 GROUP BY 1")
def shape_check(spark, d):
    return numeric.shapes(read(spark, d, "embeddings"), "embedding", 32)


@query("""
SELECT feature, round(lo, 4) + 0.0 AS min, round(hi, 4) + 0.0 AS max FROM (
  SELECT 'l_quantity' AS feature, CAST(min(l_quantity) AS DOUBLE) AS lo, CAST(max(l_quantity) AS DOUBLE) AS hi FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem) WHERE lo <= -1 OR hi >= 0.09
""")
def action_saturation(spark, d):
    return _rounded(numeric.saturation(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], -1.0, 0.09), 4)


# ---------------------------------------------------------------- digests and duplicates


@query("SELECT user_id, sha256(string_agg(event_id || chr(31) || event_type, chr(10) ORDER BY event_id) || chr(10)) AS digest, count(*) AS n_rows FROM events GROUP BY user_id")
def episode_digest(spark, d):
    return digest.episode_digests(read(spark, d, "events"), ["user_id"], ["event_id"], digest.canonical("event_id", "event_type"))


@query("SELECT conv_id, sha256(string_agg(role || chr(31) || coalesce(text, chr(0)), chr(10) ORDER BY turn) || chr(10)) AS digest, count(*) AS n_rows FROM conversations GROUP BY conv_id")
def conversation_digest(spark, d):
    return digest.episode_digests(read(spark, d, "conversations"), ["conv_id"], ["turn"], digest.canonical("role", "text"))


@query("SELECT sha256(text) AS digest, count(*) AS n_members, min(doc_id) AS first_member FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    return digest.duplicate_content(read(spark, d, "documents"), F.sha2("text", 256), "doc_id")


INPUTS = "(SELECT sha256(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM documents UNION ALL SELECT sha256(text), 'c' FROM benchmark)"


@query(f"SELECT digest, count(DISTINCT source) AS n_sources, count(*) AS n_members FROM {INPUTS} WHERE digest IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def merge_digest_overlap(spark, d):
    docs = read(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("source"))
    return digest.shared_payloads(docs.unionByName(read(spark, d, "benchmark").select(F.sha2("text", 256).alias("digest"), F.lit("c").alias("source"))))


def tree_sql(rows: str) -> str:
    """(component, fingerprint) of rows (component, k, h): digests in a tree of leaves and branches."""
    leaves = f"SELECT component, substr(r.h, 1, 5) AS leaf, sha256(string_agg(r.h, '' ORDER BY k, r.h)) AS lh FROM ({rows}) r GROUP BY component, substr(r.h, 1, 5)"
    branches = f"SELECT component, substr(leaf, 1, 2) AS branch, sha256(string_agg(lh, '' ORDER BY leaf)) AS bh FROM ({leaves}) GROUP BY component, substr(leaf, 1, 2)"
    return f"SELECT component, sha256(string_agg(bh, '' ORDER BY branch)) AS fingerprint FROM ({branches}) GROUP BY component"


@query(tree_sql("SELECT lang AS component, doc_id AS k, sha256(CAST(doc_id AS VARCHAR) || chr(31) || source) AS h FROM documents"))
def component_fingerprints(spark, d):
    return digest.component_fingerprints(read(spark, d, "documents").withColumnRenamed("lang", "component"), "component", "doc_id", digest.canonical("doc_id", "source"))


# ---------------------------------------------------------------- media and inventory


@query("SELECT lang, count(DISTINCT source) AS n_paths, count(*) AS n_members, CAST(sum(n_chars) AS BIGINT) AS size, max(n_chars) AS largest FROM documents GROUP BY lang")
def stream_summary(spark, d):
    return media.stream_summary(read(spark, d, "documents"), "lang", "source", "n_chars")


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey % 3) AS n_values FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey % 3) > 1")
def inconsistent_stream(spark, d):
    return media.inconsistent(read(spark, d, "customer"), "c_mktsegment", F.col("c_nationkey") % 3)


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, code FROM (SELECT *, unnest(['VIDEO_UNREADABLE', 'VIDEO_INVALID_FPS', 'VIDEO_INVALID_DURATION', 'VIDEO_INVALID_DIMENSIONS', 'VIDEO_PREVIEW_DECODE_FAILED']) AS code FROM part)
WHERE CASE code WHEN 'VIDEO_UNREADABLE' THEN p_size = 50 WHEN 'VIDEO_INVALID_FPS' THEN p_size <> 50 AND p_size % 10 = 0 WHEN 'VIDEO_INVALID_DURATION' THEN p_size <> 50 AND p_partkey % 11 = 0
WHEN 'VIDEO_INVALID_DIMENSIONS' THEN p_size <> 50 AND p_size - 3 <= 0 ELSE p_partkey % 13 = 0 END
""")
def video_validity(spark, d):
    rows = read(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_size") == 50, "cannot open").alias("error"), (F.col("p_size") % 10).cast("double").alias("fps"), (F.col("p_partkey") % 11).cast("double").alias("duration"),
        (F.col("p_size") - 3).alias("width"), F.lit(4).alias("height"), (F.col("p_partkey") % 13 != 0).alias("decode_valid"),
    )
    return media.video_problems(rows)


@query("SELECT source AS kind, count(*) AS n_files, CASE WHEN count(*) FILTER (WHERE doc_id % 97 = 0) = 0 THEN CAST(sum(n_chars) AS BIGINT) END AS bytes FROM documents GROUP BY source")
def inventory_totals(spark, d):
    rows = read(spark, d, "documents").select(F.col("source").alias("kind"), F.when(F.col("doc_id") % 97 != 0, F.col("n_chars")).alias("size_bytes"))
    return media.inventory_totals(rows)


@query("SELECT s_suppkey AS path, code FROM (SELECT s_suppkey, unnest(['LEROBOT_VIDEO_RESOLUTION_MISMATCH', 'LEROBOT_VIDEO_FPS_MISMATCH', 'LEROBOT_VIDEO_CHANNELS_MISMATCH']) AS code, s_nationkey FROM supplier) WHERE CASE code WHEN 'LEROBOT_VIDEO_RESOLUTION_MISMATCH' THEN s_suppkey % 4 <> 1 WHEN 'LEROBOT_VIDEO_FPS_MISMATCH' THEN s_suppkey % 5 <> 2 ELSE s_nationkey % 4 <> 3 END")
def video_contract(spark, d):
    v = read(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("stream"), (F.col("s_suppkey") % 4).alias("width"), F.lit(7).alias("height"), (F.col("s_suppkey") % 5).cast("double").alias("fps"))
    f = read(spark, d, "nation").select(F.col("n_nationkey").alias("feature"), F.lit(1).alias("declared_width"), F.lit(7).alias("declared_height"), F.lit(2.0).alias("declared_fps"), (F.col("n_nationkey") % 4).alias("declared_channels"))
    return media.contract_mismatch(v, f)


# ---------------------------------------------------------------- findings, registry, triage


def _findings(spark, d):
    f = spread(frames(spark, d), "episode_index")
    dup = model.findings(keys.duplicate_keys(f, ["episode_index", "frame_index"]), "LEROBOT_FRAME_INDEX_DUPLICATE", episode_index=F.col("episode_index"), frame_index=F.col("frame_index"), evidence=F.col("n").cast("string"))
    gap = model.findings(keys.gaps(f, ["episode_index"], "frame_index"), "LEROBOT_FRAME_INDEX_NON_CONTIGUOUS", episode_index=F.col("episode_index"), frame_index=F.col("first_missing"), evidence=F.col("n_missing").cast("string"))
    lost = model.findings(keys.row_count_mismatch(f, episodes(spark, d), "episode_index", "length"), "LEROBOT_EPISODE_ROW_COUNT_MISMATCH", episode_index=F.col("episode_index"), evidence=F.concat_ws("/", "expected", "observed"))
    return dup.unionByName(gap).unionByName(lost)


FOUND = f"""(
SELECT 'LEROBOT_FRAME_INDEX_DUPLICATE' AS code, episode_index, frame_index, CAST(count(*) AS VARCHAR) AS evidence FROM {FRAMES} GROUP BY episode_index, frame_index HAVING count(*) > 1
UNION ALL SELECT 'LEROBOT_FRAME_INDEX_NON_CONTIGUOUS', episode_index, first_missing, CAST(n_missing AS VARCHAR) FROM ({GAPS})
UNION ALL SELECT 'LEROBOT_EPISODE_ROW_COUNT_MISMATCH', e.episode_index, NULL, e.length || '/' || coalesce(n, 0) FROM {EPISODES} e LEFT JOIN (SELECT episode_index, count(*) AS n FROM {FRAMES} GROUP BY 1) f ON f.episode_index = e.episode_index WHERE e.length <> coalesce(n, 0))"""


@query(f"SELECT code, 'error' AS severity, 'alignment' AS layer, episode_index, frame_index, evidence FROM {FOUND}")
def frame_audit(spark, d):
    """Duplicates, gaps and length mismatches as enriched, de-duplicated findings."""
    found = findings.deduplicated(findings.enrich(spread(_findings(spark, d), "episode_index"), model.registry(spark)), ["code", "episode_index", "frame_index", "evidence"], ["code"])
    return found.select("code", "severity", "layer", "episode_index", "frame_index", "evidence")


@query(f"SELECT code, 'delegated' AS repair, count(*) AS n FROM {FOUND} GROUP BY code")
def finding_enrich(spark, d):
    return findings.enrich(_findings(spark, d), model.registry(spark)).groupBy("code", "repair").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT code, count(*) AS n FROM {FOUND} GROUP BY code")
def finding_dedupe(spark, d):
    found = _findings(spark, d)
    return findings.deduplicated(found.unionByName(found), ["code", "episode_index", "frame_index", "evidence"], ["code"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'error' AS severity, count(*) AS n FROM {FOUND}")
def severity_summary(spark, d):
    return findings.severity_summary(_findings(spark, d))


@query(f"SELECT episode_index, count(*) AS errors, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS infos FROM {FOUND} GROUP BY 1")
def episode_findings(spark, d):
    return findings.per_episode(spread(_findings(spark, d), "episode_index"))


@query(f"SELECT 'episode' AS kind, CAST(episode_index AS VARCHAR) AS name, count(*) AS errors, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS advisories FROM {FOUND} GROUP BY 2")
def triage_groups(spark, d):
    return findings.triage(_findings(spark, d).withColumn("camera", F.lit(None).cast("string")))


@query("SELECT * FROM (VALUES ('grid', 'run', ''), ('rows', 'skip', 'data.rows'), ('both', 'skip', 'data.rows,media.decode'), ('stats', 'run', '')) t(rule, state, missing)")
def rule_gating(spark, d):
    needs = spark.createDataFrame([("grid", "meta.info", "metadata", "available"), ("rows", "data.rows", "full", "complete"), ("both", "data.rows", "full", "complete"), ("both", "media.decode", "sample", "available"), ("stats", "data.rows", "sample", "available")], "rule string, capability string, minimum string, need string")
    have = spark.createDataFrame([("meta.info", "complete", "metadata"), ("data.rows", "partial", "sample"), ("media.decode", "unavailable", "metadata")], "capability string, status string, integrity string")
    return findings.gate(needs, have)


@query("SELECT source, CASE WHEN checked = 0 THEN 'unavailable' WHEN checked >= total THEN 'complete' ELSE 'partial' END AS status, checked, total FROM (SELECT source, count(l.doc_id) AS checked, count(*) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source)")
def coverage_ledger(spark, d):
    both = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", F.lit(1).alias("c")).distinct(), "doc_id", "left")
    return both.groupBy("source").agg(F.count("c").alias("checked"), F.count(F.lit(1)).alias("total")).select("source", findings.coverage_status(F.col("checked"), F.col("total")).alias("status"), "checked", "total")


@query(f"SELECT code, count(*) AS n FROM {FOUND} WHERE episode_index % 2 = 0 GROUP BY code")
def findings_resolved(spark, d):
    found = _findings(spark, d).withColumn("location", F.concat_ws(":", "episode_index", "frame_index", "evidence"))
    return findings.resolved(found, found.where("episode_index % 2 = 1")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- signals


@query(f"SELECT episode_index, round(length / 4.0, 6) AS seconds FROM {EPISODES} WHERE length / 4.0 < 1")
def short_episodes(spark, d):
    fps = spark.createDataFrame([(4.0,), (4.0,)], "fps double")
    return signals.short_episodes(episodes(spark, d), fps, "length", 1.0).select("episode_index", F.round("seconds", 6).alias("seconds"))


@query("SELECT count(*) AS n_groups, min(n) AS smallest, max(n) AS largest FROM (SELECT count(*) AS n FROM events GROUP BY event_type) HAVING min(n) <> max(n)")
def group_balance(spark, d):
    return signals.imbalance(read(spark, d, "events"), "event_type")


# ---------------------------------------------------------------- diff


@query("""
SELECT 'features' AS component, kind, '/features/' || coalesce(b.k, a.k) AS path, class FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS dtype, c_nationkey AS shape FROM customer WHERE c_custkey % 10 <> 1) b
FULL OUTER JOIN (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 10 = 3 THEN 'X' ELSE c_mktsegment END AS dtype, CASE WHEN c_custkey % 10 = 4 THEN NULL ELSE c_nationkey END AS shape FROM customer WHERE c_custkey % 10 <> 2) a ON a.k = b.k
JOIN (VALUES ('added', 'non_breaking'), ('removed', 'breaking'), ('dtype_changed', 'breaking'), ('shape_changed', 'breaking')) t(kind, class)
ON CASE kind WHEN 'added' THEN b.k IS NULL WHEN 'removed' THEN a.k IS NULL WHEN 'dtype_changed' THEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.dtype IS DISTINCT FROM b.dtype ELSE a.k IS NOT NULL AND b.k IS NOT NULL AND a.shape IS DISTINCT FROM b.shape END
""")
def diff_features(spark, d):
    """The later version leaves out and changes some rows, as an edit would; both versions are compared whole."""
    return _feature_changes(spark, d).select("component", "kind", "path", "class")


def _feature_changes(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_custkey", F.col("c_mktsegment").alias("dtype"), F.col("c_nationkey").alias("shape"))
    m = F.col("c_custkey") % 10
    after = rows.where(m != 2).withColumn("dtype", F.when(m == 3, "X").otherwise(F.col("dtype"))).withColumn("shape", F.when(m != 4, F.col("shape")))
    return diff.keyed(rows.where(m != 1), after, "features", "k", [("dtype_changed", ["dtype"]), ("shape_changed", ["shape"])])


@query("""
WITH b AS (SELECT n_name AS task, CAST(n_nationkey AS BIGINT) AS i FROM nation), a AS (SELECT CASE WHEN n_nationkey = 5 THEN 'NEW' ELSE n_name END AS task, CAST(CASE WHEN n_nationkey = 7 THEN 107 ELSE n_nationkey END AS BIGINT) AS i FROM nation WHERE n_nationkey <> 9)
SELECT 'removed' AS kind, '/tasks/' || task AS path, 'material' AS class FROM b WHERE task NOT IN (SELECT task FROM a)
UNION ALL SELECT 'added', '/tasks/' || task, 'material' FROM a WHERE task NOT IN (SELECT task FROM b)
UNION ALL SELECT 'task_index_remapped', '/tasks/' || a.task, 'breaking' FROM a JOIN b ON a.task = b.task WHERE a.i <> b.i
UNION ALL SELECT 'task_identity_remapped', '/tasks/' || a.i, 'breaking' FROM a JOIN b ON a.i = b.i WHERE a.task <> b.task
""")
def diff_tasks(spark, d):
    """The later version leaves out and changes some rows, as an edit would; both versions are compared whole."""
    b = read(spark, d, "nation").select(F.col("n_name").alias("task"), F.col("n_nationkey").cast("long").alias("task_index"))
    a = b.where("task_index <> 9").select(F.when(F.col("task_index") == 5, "NEW").otherwise(F.col("task")).alias("task"), F.when(F.col("task_index") == 7, 107).otherwise(F.col("task_index")).cast("long").alias("task_index"))
    return diff.tasks(b, a).select("kind", "path", "class")


@query("""
SELECT 'content_changed' AS kind, '/episodes/' || o_orderkey AS path, 'material' AS class FROM orders WHERE o_orderkey % 100 = 8
UNION ALL SELECT 'removed', '/episodes/' || o_orderkey, 'material' FROM orders WHERE o_orderkey % 100 = 9
UNION ALL SELECT 'source_changed', '/episodes/' || o_orderkey, 'non_breaking' FROM orders WHERE o_orderkey % 100 = 10 AND o_orderpriority IS DISTINCT FROM 'moved'
""")
def diff_episodes(spark, d):
    """The later version leaves out and changes some rows, as an edit would; both versions are compared whole."""
    b = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("length"), F.col("o_orderpriority").alias("source"))
    m = F.col("k") % 100
    a = b.where(m != 9).withColumn("length", F.when(m == 8, F.col("length") + 1).otherwise(F.col("length"))).withColumn("source", F.when(m == 10, "moved").otherwise(F.col("source")))
    return diff.keyed(b, a, "episodes", "k", [("content_changed", ["length"]), ("source_changed", ["source"])]).select("kind", "path", "class")


@query("""
SELECT '/totals/' || name AS path, class, before, after FROM (VALUES ('features', 'breaking', '5', '4'), ('video_streams', 'non_breaking', '2', '3'), ('metadata_shards', 'material', '3', '2'), ('size_bytes', 'non_breaking', '10', '11'), ('frames', 'material', (SELECT CAST(count(*) AS VARCHAR) FROM lineitem), (SELECT CAST(count(*) AS VARCHAR) FROM orders))) t(name, class, before, after)
""")
def diff_totals(spark, d):
    n = read(spark, d, "lineitem").agg(F.lit("frames").alias("name"), F.count(F.lit(1)).alias("value"))
    m = read(spark, d, "orders").agg(F.lit("frames").alias("name"), F.count(F.lit(1)).alias("value"))
    b = spark.createDataFrame([("features", 5), ("video_streams", 2), ("metadata_shards", 3), ("size_bytes", 10), ("tasks", 1)], "name string, value long").unionByName(n)
    a = spark.createDataFrame([("features", 4), ("video_streams", 3), ("metadata_shards", 2), ("size_bytes", 11), ("tasks", 1)], "name string, value long").unionByName(m)
    return diff.totals(b, a).select("path", "class", "before", "after")


@query("""
SELECT 'breaking' AS class, count(*) FILTER (WHERE c_custkey % 10 IN (2, 3) OR c_custkey % 10 = 4 AND c_nationkey IS NOT NULL) AS breaking, CAST(0 AS BIGINT) AS material, count(*) FILTER (WHERE c_custkey % 10 = 1) AS non_breaking FROM customer
""")
def diff_overall(spark, d):
    return diff.overall(_feature_changes(spark, d))


# ---------------------------------------------------------------- readiness


def _gates(spark):
    r = [("action", "float32", [7], None, None, 7, None, None), ("state", "float32", None, 1, 16, None, "mean_std", None), ("image", "video", None, 3, None, None, None, None), ("wrist", "video", None, None, None, None, None, None), ("delta", "float32", None, None, None, None, None, [0.0, 0.1])]
    f = [("action", "float64", [6], None, None), ("state", "float32", [32], "min_max", None), ("image", "video", [480, 640, 3], None, None), ("delta", "float32", [1], None, [0.0])]
    return spark.createDataFrame(r, gates.FEATURE_REQUIREMENT), spark.createDataFrame(f, "feature string, dtype string, shape array<long>, normalization string, deltas array<double>")


@query("""
SELECT * FROM (VALUES ('action', 'READINESS_FEATURE_DTYPE_MISMATCH'), ('action', 'READINESS_FEATURE_SHAPE_MISMATCH'), ('action', 'READINESS_ACTION_DIMENSION_MISMATCH'), ('state', 'READINESS_FEATURE_SHAPE_MISMATCH'),
('state', 'READINESS_NORMALIZATION_MISMATCH'), ('wrist', 'READINESS_FEATURE_MISSING'), ('delta', 'READINESS_DELTA_HORIZON_MISMATCH')) t(feature, code)
""")
def readiness_gates(spark, d):
    return gates.feature_gates(*_gates(spark))


@query("SELECT CAST(7 AS BIGINT) AS blockers, CAST(1 AS BIGINT) AS gaps, 'BLOCKED' AS status")
def readiness_status(spark, d):
    need = spark.createDataFrame([("meta.info", "metadata"), ("data.rows", "full")], "capability string, minimum string")
    have = spark.createDataFrame([("meta.info", "complete", "metadata"), ("data.rows", "complete", "sample")], "capability string, status string, integrity string")
    return gates.status(gates.feature_gates(*_gates(spark)), gates.coverage_gaps(need, have))


@query("SELECT 'brands' AS name, 'Brand#1?' AS pattern, CAST(99 AS BIGINT) AS minimum, count(DISTINCT p_brand) AS n FROM part WHERE regexp_matches(p_brand, '^Brand#1.$') HAVING count(DISTINCT p_brand) < 99")
def feature_group_glob(spark, d):
    groups = spark.createDataFrame([("brands", "Brand#1?", 99), ("any", "*", 1)], "name string, pattern string, minimum int")
    return gates.feature_groups(groups, read(spark, d, "part").select(F.col("p_brand").alias("feature")))


@query("SELECT 'READINESS_METADATA_MISSING' AS code, key, severity FROM (VALUES ('license', 'error'), ('homepage', 'warning')) t(key, severity)")
def metadata_gates(spark, d):
    need = spark.createDataFrame([("license", "error"), ("homepage", "warning"), ("fps", "error")], "key string, severity string")
    return gates.metadata_gates(need, spark.createDataFrame([("fps", "10"), ("license", " ")], "key string, value string"))


# ---------------------------------------------------------------- merge and repair


@query("SELECT doc_id % 500 AS k, count(DISTINCT doc_id // 500) AS n_sources FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id // 500) > 1")
def merge_index_overlap(spark, d):
    rows = read(spark, d, "documents").select((F.col("doc_id") % 500).alias("k"), F.floor(F.col("doc_id") / 500).alias("source"))
    return merge.overlaps(rows, "k")


def _checks(spark, d):
    f = spark.createDataFrame([("a", "x", "float32", "[3]"), ("b", "x", "float64", "[3]"), ("a", "y", "int64", "[1]"), ("b", "y", "float32", "[1]"), ("a", "z", "string", None), ("b", "z", "string", None), ("a", "w", "bool", "[1]")], "source string, feature string, dtype string, shape string")
    return merge.feature_check(f)


@query("SELECT * FROM (VALUES ('x', 'transform_required', 'dtype'), ('y', 'incompatible', 'dtype_family'), ('z', 'direct', 'same'), ('w', 'incompatible', 'missing')) t(feature, status, reason)")
def merge_features(spark, d):
    return _checks(spark, d)


@query("SELECT 'incompatible' AS decision, CAST(4 AS BIGINT) AS checks")
def merge_decision(spark, d):
    return merge.decision(_checks(spark, d))


@query("SELECT 'frames' AS name, CAST(sum(l_linenumber) AS BIGINT) AS expected, CAST(sum(l_linenumber) + 1 AS BIGINT) AS actual FROM lineitem")
def merged_totals(spark, d):
    parts = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 2).alias("source")).agg(F.sum("l_linenumber").cast("long").alias("frames"), F.count(F.lit(1)).alias("episodes"))
    merged = read(spark, d, "lineitem").agg((F.sum("l_linenumber") + 1).cast("long").alias("frames"), F.count(F.lit(1)).alias("episodes"))
    return merge.merged_totals(parts, merged, ["frames", "episodes"])


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 1 THEN 'missing' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 50 IN (1, 2)")
def episode_reconcile(spark, d):
    """The merged side leaves out and changes some rows, as a faulty merge would; both sides are compared whole."""
    e = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderpriority")
    a = e.where("k % 50 <> 1").withColumn("o_custkey", F.when(F.col("k") % 50 == 2, -1).otherwise(F.col("o_custkey")))
    return merge.reconcile(e, a, "k", ["o_custkey", "o_orderpriority"])


@query("""
SELECT '/total_episodes' AS pointer, CAST(3 AS BIGINT) AS before, (SELECT count(*) FROM orders) AS after UNION ALL SELECT '/total_frames', CAST(999 AS BIGINT), (SELECT CAST(sum(o_orderkey % 7 + 1) AS BIGINT) FROM orders)
""")
def repair_totals(spark, d):
    derived = repair.derived_totals(episodes(spark, d), None, read(spark, d, "nation").select(F.col("n_nationkey").alias("task_index"), F.col("n_name").alias("task")), read(spark, d, "documents").select(F.col("source").alias("path")))
    declared = spark.createDataFrame([("/total_episodes", 3), ("/total_frames", 999), ("/total_tasks", 25), ("/total_videos", 20)], "pointer string, declared long")
    return repair.steps(declared, derived)


# ---------------------------------------------------------------- scalar functions


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS locator FROM pages")
def portable_locator(spark, d):
    return read(spark, d, "pages").select("page_id", text.public_locator(F.col("url")).alias("locator"))


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'cam' || page_id % 5 WHEN 1 THEN 'p' || page_id % 7 ELSE 'default' END AS stream FROM pages
""")
def stream_key_from_path(spark, d):
    i = F.col("page_id")
    path = F.when(i % 3 == 0, F.format_string("videos/chunk-%03d/cam%d/file-0.mp4", i, i % 5)).when(i % 3 == 1, F.format_string("data/p%d/x.mp4", i % 7)).otherwise("x.mp4")
    return read(spark, d, "pages").select("page_id", text.stream_of_path(path).alias("stream"))


@query("""
SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\\b(?:hf_|ghp_|sk-)[A-Za-z0-9]{8,}', '[redacted]', 'g'), '(?:/home/|/Users/)[^/\\s]+', '[private]', 'g') || ' [private]/x Bearer [redacted]' AS safe FROM conversations
""")
def redact_private(spark, d):
    c = F.concat(F.coalesce("text", F.lit("")), F.lit(" /home/"), F.col("role"), F.lit("/x bearer abc.def"))
    return read(spark, d, "conversations").select("conv_id", "turn", text.redacted(c).alias("safe"))


@query("""
SELECT * FROM (VALUES ('v2.1', 'exact'), ('3.0', 'exact'), ('3.0.0', 'exact'), ('v3.1', 'unknown_minor'), ('2.1.4', 'unknown_minor'), ('v4.0', 'unsupported_major'), ('x', 'invalid'), (NULL, 'missing'), (' ', 'missing')) t(version, state)
""")
def version_probe(spark, d):
    rows = spark.createDataFrame([("v2.1",), ("3.0",), ("3.0.0",), ("v3.1",), ("2.1.4",), ("v4.0",), ("x",), (None,), (" ",)], "version string")
    return rows.select("version", text.version_state(F.col("version"), {2: 1, 3: 0}).alias("state"))


@query("SELECT o_orderkey, 'data/chunk-' || printf('%03d', o_orderkey // 1000) || '/episode_' || printf('%06d', o_orderkey) || '.parquet' AS path FROM orders")
def template_paths(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", text.template_path("data/chunk-{chunk:03d}/episode_{episode:06d}.parquet", chunk=F.floor(k / 1000), episode=k).alias("path"))


@query("""
SELECT * FROM (SELECT 'documents' AS fact, count(*) AS value FROM documents UNION ALL SELECT 'bytes', CAST(sum(n_chars) AS BIGINT) FROM documents UNION ALL SELECT 'labelled', count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'streams', count(DISTINCT lang) FROM documents)
""")
def catalog_facts(spark, d):
    docs = read(spark, d, "documents").agg(F.count(F.lit(1)).alias("a"), F.sum("n_chars").alias("b"), F.countDistinct("lang").alias("c")).select(F.expr("stack(3, 'documents', a, 'bytes', b, 'streams', c) AS (fact, value)"))
    return docs.unionByName(read(spark, d, "labels").agg(F.lit("labelled").alias("fact"), F.countDistinct("doc_id").alias("value")))


# the other registered queries put themselves into QUERIES and SQL
from framewright.plans import catalog_files, catalog_rules  # noqa: E402, F401
