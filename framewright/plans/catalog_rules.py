"""More registered queries: scalar functions, findings, snapshots, gates, merges, repairs and remote plans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright import model
from framewright.functions import canonical, text
from framewright.operators import diff, evidence, findings, gates, keys, media, merge, numeric, remote, repair, snapshot
from framewright.plans import receipts
from framewright.plans.bindings import read
from framewright.plans.catalog import query, tree_sql
from framewright.plans.rules import Rule, Rules, inferred_coverage

# ---------------------------------------------------------------- scalar functions


@query("""
SELECT event_id, CASE WHEN regexp_full_match(v, '\\s*\\d{1,18}\\s*') THEN CAST(trim(v) AS BIGINT) END AS whole, x IS NOT NULL AND isfinite(x) AS is_finite, abs(value - round(value, 3)) <= greatest(1e-6, 1e-5 * greatest(abs(value), abs(round(value, 3)))) AS is_close,
  event_id // 1000 AS chunk, CASE WHEN (event_id * 5) % 10 = 5 AND ((event_id * 5) // 10) % 2 = 0 THEN (event_id * 5) // 10 ELSE CAST(round(event_id * 5 / 10.0) AS BIGINT) END AS half_even
FROM (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN '-' || event_id WHEN 2 THEN 'true' ELSE event_id || '.0' END AS v, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS x FROM events)
""")
def scalar_numbers(spark, d):
    k = F.col("event_id")
    form = F.when(k % 4 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("-"), k)).when(k % 4 == 2, "true").otherwise(F.concat(k, F.lit(".0")))
    x = F.when(k % 5 == 0, F.lit("nan").cast("double")).when(k % 5 == 1, F.lit("inf").cast("double")).when(k % 5 == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    half = text.half_even((k * 5 / F.lit(10)).cast("decimal(20, 1)"), 0).cast("long")
    return read(spark, d, "events").select("event_id", text.non_negative_integer(form).alias("whole"), numeric.finite(x).alias("is_finite"), numeric.close(F.col("value"), F.round("value", 3)).alias("is_close"), F.floor(k / 1000).alias("chunk"), half.alias("half_even"))


@query("""
SELECT page_id, p AS path, NOT contains(p, '\\') AND NOT regexp_matches(p, '^[A-Za-z]:') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS valid,
  regexp_full_match(p, 'data/.*/[^/]*1[.]h.ml', 's') AS matched, replace(replace(p, '~', '~0'), '/', '~1') AS token, substr(sha1(p), 1, 8) AS short
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'data/' || page_id || '/a~b.html' WHEN 1 THEN '/abs/' || page_id WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN 'C:/x/' || page_id WHEN 4 THEN 'a\\b' || page_id ELSE 'data/x/' || page_id || '1.html' END AS p FROM pages)
""")
def scalar_paths(spark, d):
    k = F.col("page_id")
    p = (
        F.when(k % 6 == 0, F.concat(F.lit("data/"), k, F.lit("/a~b.html"))).when(k % 6 == 1, F.concat(F.lit("/abs/"), k)).when(k % 6 == 2, F.concat(F.lit("a/../"), k))
        .when(k % 6 == 3, F.concat(F.lit("C:/x/"), k)).when(k % 6 == 4, F.concat(F.lit("a\\b"), k)).otherwise(F.concat(F.lit("data/x/"), k, F.lit("1.html")))
    )
    rows = read(spark, d, "pages").select("page_id", p.alias("path"))
    return rows.select("page_id", "path", text.relative_path_valid(F.col("path")).alias("valid"), F.col("path").rlike(text.glob_regex("data/*/*1.h?ml")).alias("matched"), diff.pointer(F.col("path")).alias("token"), F.substring(F.sha1("path"), 1, 8).alias("short"))


@query("SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path FROM pages) WHERE regexp_matches(path, '^[a-m].*$') OR regexp_matches(path, '^.*[0-9]$')")
def allowed_files(spark, d):
    rows = read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/", "").alias("path"))
    return remote.allowed(rows, ["[a-m]*", "*[0-9]"])


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)(?:^|[^a-z])(?:token|secret|password|api[_-]?key)\\s*[=:]|\\b(?:hf_|ghp_|sk-)[A-Za-z0-9]{8,}|bearer\\s+\\S+') AS found FROM documents")
def secret_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", text.secret_like(F.coalesce("text", F.lit(""))).alias("found"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_size % 4 END AS major, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_partkey % 7 END AS minor, CASE WHEN p_partkey % 5 IN (1, 3) THEN p_partkey % 3 END AS patch,
  CASE WHEN p_partkey % 5 = 4 THEN 'invalid' WHEN p_size % 4 NOT IN (2, 3) THEN 'unsupported_major' WHEN p_partkey % 7 = (CASE p_size % 4 WHEN 2 THEN 1 ELSE 0 END) AND (p_partkey % 5 IN (0, 2) OR p_partkey % 3 = 0) THEN 'exact' ELSE 'unknown_minor' END AS state
FROM part
""")
def version_texts(spark, d):
    k, v = F.col("p_partkey"), F.concat(F.col("p_size") % 4, F.lit("."), F.col("p_partkey") % 7)
    form = F.when(k % 5 == 0, v).when(k % 5 == 1, F.concat(F.lit("v"), v, F.lit("."), k % 3)).when(k % 5 == 2, F.concat(F.lit(" v"), v)).when(k % 5 == 3, F.concat(v, F.lit("."), k % 3)).otherwise(F.concat(v, F.lit("-rc")))
    rows = read(spark, d, "part").select("p_partkey", text.version_parts(form).alias("v"), text.version_state(form, {2: 1, 3: 0}).alias("state"))
    return rows.select("p_partkey", "v.major", "v.minor", "v.patch", "state")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate - CASE WHEN o_orderkey % 3 = 1 THEN INTERVAL 150 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM orders")
def utc_times(spark, d):
    zone = F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+02:30").otherwise("")
    return read(spark, d, "orders").select("o_orderkey", text.utc_seconds(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)).alias("utc"))


@query("""
SELECT s_suppkey, sha256('["object",[["k",["number","integer","' || s_suppkey || '"]],["n",["string","' || s_name || '"]],["ok",["bool","' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END || '"]],["x",["array",[["null"],["number","integer","' || s_nationkey || '"]]]]]]') AS digest
FROM supplier
""")
def typed_digests(spark, d):
    rows = read(spark, d, "supplier")
    body = F.concat(F.lit('{"x": [null, '), F.col("s_nationkey"), F.lit('.0], "n": "'), F.col("s_name"), F.lit('", "ok": '), F.col("s_suppkey") % 2 == 0, F.lit(', "k": '), F.col("s_suppkey"), F.lit("}"))
    return rows.select("s_suppkey", canonical.typed_digests(body).alias("digest"))


# ---------------------------------------------------------------- findings and rules


@query("""
SELECT code, severity, layer, path FROM (
  SELECT 'LEROBOT_TASK_INVALID' AS code, 'error' AS severity, (SELECT 0) AS s, 1 AS l, 'metadata' AS layer, p_name AS path FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT 'ADVISORY_SHORT_EPISODE', 'info', 2, 3, 'data', p_name FROM part WHERE p_size % 2 = 1) ORDER BY s, l, code, path LIMIT 40
""")
def findings_in_order(spark, d):
    """The first 40 findings of a report; the limit is the report's."""
    rows = read(spark, d, "part")
    one = rows.where("p_size % 2 = 0").select(F.lit("LEROBOT_TASK_INVALID").alias("code"), F.lit("error").alias("severity"), F.lit("metadata").alias("layer"), F.col("p_name").alias("path"))
    two = rows.where("p_size % 2 = 1").select(F.lit("ADVISORY_SHORT_EPISODE").alias("code"), F.lit("info").alias("severity"), F.lit("data").alias("layer"), F.col("p_name").alias("path"))
    both = two.unionByName(one)
    return findings.ordered(both.select("*", *[F.lit(None).cast("string").alias(c) for c in ("location", "evidence", "message")])).limit(40).select("code", "severity", "layer", "path")


@query("""
SELECT 'LEROBOT_EPISODE_INDEX_DUPLICATE' AS name, 'found' AS state, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n
UNION ALL SELECT 'LEROBOT_FRAME_INDEX_DUPLICATE', 'found', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'LEROBOT_TASK_INVALID', 'found', CAST(1 AS BIGINT)
UNION ALL SELECT 'LEROBOT_STATS_MISSING', 'skipped', CAST(1 AS BIGINT)
""")
def rule_pack(spark, d):
    """Rules that a caller brings: two that run over tables, one skipped for want of depth, one of another kind of data set, and a seed finding."""
    pack, frames = Rules(), {"episodes": read(spark, d, "orders"), "frames": read(spark, d, "lineitem")}
    pack.add(Rule("LEROBOT_EPISODE_INDEX_DUPLICATE", lambda f: model.findings(keys.duplicate_keys(f["episodes"], ["o_custkey"]), "LEROBOT_EPISODE_INDEX_DUPLICATE", episode_index=F.col("o_custkey")), (("meta.episodes", "metadata", "available"),), ("lerobot",)))
    pack.add(Rule("LEROBOT_FRAME_INDEX_DUPLICATE", lambda f: model.findings(keys.duplicate_keys(f["frames"], ["l_orderkey", "l_linenumber"]), "LEROBOT_FRAME_INDEX_DUPLICATE", episode_index=F.col("l_orderkey"), frame_index=F.col("l_linenumber")), (("data.rows", "full", "complete"),)))
    pack.add(Rule("LEROBOT_STATS_MISSING", lambda f: model.findings(f["episodes"], "LEROBOT_STATS_MISSING"), (("meta.stats", "metadata", "complete"),)))
    pack.add(Rule("VIDEO_UNREADABLE", lambda f: model.findings(f["episodes"], "VIDEO_UNREADABLE"), (), ("video",)))
    coverage = spark.createDataFrame([("meta.episodes", "partial", "metadata"), ("data.rows", "complete", "full"), ("meta.stats", "unavailable", "metadata")], "capability string, status string, integrity string")
    found, skipped = pack.run(spark, frames, coverage, "lerobot", model.findings(spark.range(1), "LEROBOT_TASK_INVALID"))
    return found.groupBy(F.col("code").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("name", F.lit("found").alias("state"), "n").unionByName(skipped.select(F.col("rule").alias("name"), F.lit("skipped").alias("state"), F.lit(1).cast("long").alias("n")))


@query("""
WITH v AS (SELECT source AS capability, 0 AS k, CASE WHEN count(*) % 2 = 0 THEN 'failed' ELSE 'complete' END AS status, count(*) + 5 AS checked, count(*) AS total FROM documents WHERE lang = 'de' GROUP BY source),
a AS (SELECT source AS capability, 1 AS k, 'partial' AS status, min(doc_id) AS checked, max(doc_id) AS total FROM documents GROUP BY source),
r AS (SELECT capability, arg_min(status, k) AS status, arg_min(checked, k) AS checked, arg_min(total, k) AS total FROM (SELECT * FROM v UNION ALL SELECT * FROM a) GROUP BY 1)
SELECT capability, CASE status WHEN 'failed' THEN 'unavailable' ELSE status END AS status, 'full' AS integrity, least(checked, total) AS checked, total FROM r
UNION ALL SELECT 'media.decode', 'complete', 'full', 3, 3
""")
def coverage_inferred(spark, d):
    docs = read(spark, d, "documents")
    v = docs.where("lang = 'de'").groupBy(F.col("source").alias("capability")).agg(F.when(F.count(F.lit(1)) % 2 == 0, "failed").otherwise("complete").alias("status"), (F.count(F.lit(1)) + 5).alias("checked"), F.count(F.lit(1)).alias("total")).withColumn("integrity", F.lit("full"))
    a = docs.groupBy(F.col("source").alias("capability")).agg(F.lit("partial").alias("status"), F.min("doc_id").alias("checked"), F.max("doc_id").alias("total")).withColumn("integrity", F.lit("full"))
    base = spark.createDataFrame([("media.decode", "complete", "full", 3, 3)], "capability string, status string, integrity string, checked long, total long")
    return inferred_coverage(v, a, base)


@query("SELECT 'LEROBOT_TASK_INVALID' AS code, 'error' AS severity, 'metadata' AS layer, count(DISTINCT o_orderpriority) AS n FROM orders")
def contract_findings(spark, d):
    found = read(spark, d, "orders").select(F.lit("LEROBOT_TASK_INVALID").alias("code"), F.lit("error").alias("severity"), F.lit("data").alias("layer"), F.col("o_orderpriority").alias("path"), *[F.lit(None).cast("string").alias(c) for c in ("location", "evidence", "message")])
    return evidence.contract_findings(found, model.registry(spark)).groupBy("code", "severity", "layer").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag AS capability, count(DISTINCT l_linestatus) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def capability_conflicts(spark, d):
    return keys.conflicts(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("capability"), "l_linestatus"), "capability", "l_linestatus")


# ---------------------------------------------------------------- snapshots and evidence


def _snapshot_inputs(spark, d):
    """Orders as episodes (null lengths on every 200th), lineitem by shard as footers, pages as inventory, events as videos."""
    e = read(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), F.when(F.col("o_orderkey") % 200 != 0, F.col("o_orderkey") % 7 + 1).alias("length"))
    f = read(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("path")).agg(F.count(F.lit(1)).alias("num_rows"))
    t = read(spark, d, "nation").select(F.col("n_nationkey").alias("task_index"))
    i = read(spark, d, "pages").select(F.element_at(F.array(F.lit("metadata"), F.lit("data"), F.lit("media")), (F.col("page_id") % 3 + 1).cast("int")).alias("kind"), F.octet_length("html").cast("long").alias("size_bytes"))
    v = read(spark, d, "part").select(F.col("p_size").cast("double").alias("duration"))
    return e, f, t, i, v


SNAPSHOT_TOTALS = """
WITH c AS (SELECT (SELECT count(*) FROM orders) AS episodes, (SELECT count(DISTINCT n_nationkey) FROM nation) AS tasks, (SELECT count(*) FROM pages WHERE page_id % 3 = 0) AS m, (SELECT count(*) FROM pages WHERE page_id % 3 = 1) AS dd, (SELECT count(*) FROM pages WHERE page_id % 3 = 2) AS v,
  (SELECT CASE WHEN count(*) = count(html) THEN sum(strlen(html)) END FROM pages) AS bytes, (SELECT count(*) FROM lineitem) AS rows, (SELECT CASE WHEN count(*) FILTER (o_orderkey % 200 = 0) = 0 THEN sum(o_orderkey % 7 + 1) END FROM orders) AS lengths, (SELECT sum(p_size) FROM part) AS seconds),
u AS (SELECT 'whole' AS variant, rows AS frames, seconds AS duration, * FROM c UNION ALL SELECT 'lengths', coalesce(lengths, 77), coalesce(lengths, 77) / 8, * FROM c)
SELECT variant, name, CAST(value AS DOUBLE) AS value FROM (
  SELECT variant, unnest(['episodes', 'frames', 'tasks', 'metadata_shards', 'data_shards', 'media_shards', 'size_bytes', 'duration_seconds']) AS name, unnest([CAST(episodes AS DOUBLE), frames, tasks, m, dd, v, bytes, duration]) AS value FROM u)
"""


@query(SNAPSHOT_TOTALS)
def snapshot_totals(spark, d):
    """Both cascades: from footers and videos, and from lengths or the declaration without them."""
    e, f, t, i, v = _snapshot_inputs(spark, d)
    declared = spark.createDataFrame([("frames", 77)], "name string, declared long")
    whole = snapshot.totals(e, f, t, i, declared, 8.0, v).select(F.lit("whole").alias("variant"), "name", "value")
    return whole.unionByName(snapshot.totals(e, None, t, i, declared, 8.0).select(F.lit("lengths").alias("variant"), "name", "value"))


PARTS = "SELECT 'tasks' AS component, CAST(n_nationkey AS VARCHAR) AS k, sha256(n_name) AS h FROM nation UNION ALL SELECT 'features', r_name, sha256(CAST(r_regionkey AS VARCHAR)) FROM region"


@query(f"WITH f AS ({tree_sql(PARTS)}) SELECT component, fingerprint FROM f UNION ALL SELECT 'snapshot', sha256(string_agg(component || '=' || fingerprint, chr(10) ORDER BY component)) FROM f")
def snapshot_fingerprints(spark, d):
    return snapshot.fingerprints(_components(spark, d))


def _components(spark, d):
    a = read(spark, d, "nation").select(F.lit("tasks").alias("component"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("row"))
    return a.unionByName(read(spark, d, "region").select(F.lit("features").alias("component"), F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("row")))


@query("SELECT * FROM (SELECT 'features' AS component, 'unchanged' AS status UNION ALL SELECT 'tasks', CASE WHEN count(*) FILTER (n_regionkey = 3) > 0 THEN 'changed' ELSE 'unchanged' END FROM nation UNION ALL SELECT 'snapshot', CASE WHEN count(*) FILTER (n_regionkey = 3) > 0 THEN 'changed' ELSE 'unchanged' END FROM nation)")
def component_status(spark, d):
    """A loaded snapshot's fingerprints against those of the tables, in which the tasks of one region got other texts."""
    now = _components(spark, d).join(read(spark, d, "nation").where("n_regionkey = 3").select(F.col("n_name").alias("row"), F.lit(True).alias("_other")), "row", "left")
    return diff.component_status(snapshot.fingerprints(_components(spark, d)), snapshot.fingerprints(now.select("component", "key", F.when(F.col("_other"), F.upper(F.reverse("row"))).otherwise(F.col("row")).alias("row"))))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'official_claim' WHEN p_partkey % 3 = 0 THEN 'metadata_verified' ELSE 'sample_verified' END AS level FROM part")
def evidence_levels(spark, d):
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c % 3 + 1).cast("int"))
    rows = read(spark, d, "part").select("p_partkey", pick(F.col("p_size"), "unavailable", "partial", "complete").alias("status"), pick(F.col("p_partkey"), "metadata", "sample", "full").alias("integrity"))
    return rows.select("p_partkey", snapshot.evidence_level().alias("level"))


@query("SELECT 'declared' AS variant, CAST(10 AS DOUBLE) AS fps UNION ALL SELECT 'single', CAST(max(r) AS DOUBLE) FROM (SELECT DISTINCT 30.0 AS r FROM part) UNION ALL SELECT 'several', CASE WHEN count(DISTINCT p_size) = 1 THEN CAST(max(p_size) AS DOUBLE) END FROM part")
def fps_cascade(spark, d):
    parts = read(spark, d, "part")
    of = lambda name, declared, fps: snapshot.single_fps(declared, parts.select(fps.cast("double").alias("fps"))).select(F.lit(name).alias("variant"), "fps")
    return of("declared", 10.0, F.col("p_size")).unionByName(of("single", None, F.lit(30))).unionByName(of("several", None, F.col("p_size")))


def _relations(spark, d):
    """Lines as video relations: the return flag is the camera, the ship mode of time is quantity."""
    return read(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") % 5 == 0, "data").otherwise("video").alias("kind"), F.col("l_orderkey").alias("episode_index"), F.col("l_returnflag").alias("feature_key"), F.concat(F.lit("v/"), "l_linestatus", F.lit("/"), F.col("l_orderkey") % 9).alias("path"),
        F.col("l_quantity").alias("from_timestamp"), (F.col("l_quantity") * 8 - 20).alias("to_timestamp"),
    )


SEGMENTS = "(SELECT l_orderkey AS episode_index, l_returnflag AS feature_key, 'v/' || l_linestatus || '/' || l_orderkey % 9 AS path, l_quantity AS from_timestamp, l_quantity * 8 - 20 AS to_timestamp FROM lineitem WHERE l_linenumber % 5 <> 0)"


@query(f"SELECT episode_index, string_agg(feature_key || '@' || CAST(from_timestamp AS BIGINT), ',' ORDER BY feature_key, from_timestamp, to_timestamp, path) AS segments FROM {SEGMENTS} GROUP BY 1")
def episode_segments(spark, d):
    found = snapshot.segments_of(_relations(spark, d))
    return found.select("episode_index", F.array_join(F.transform("segments", lambda x: F.concat(x["feature_key"], F.lit("@"), x["from_timestamp"].cast("long"))), ",").alias("segments"))


@query(f"""
SELECT o_orderkey AS episode_index, o_orderkey % 7 + 1 AS length, least(o_orderstatus, o_orderpriority) || '|' || greatest(o_orderstatus, o_orderpriority) AS tasks, coalesce(cameras, '') AS cameras, coalesce(n_files, 0) AS n_files
FROM orders LEFT JOIN (SELECT episode_index, string_agg(DISTINCT feature_key, '|' ORDER BY feature_key) AS cameras, count(DISTINCT path) AS n_files FROM {SEGMENTS} GROUP BY 1) v ON v.episode_index = o_orderkey
""")
def semantic_episodes(spark, d):
    e = read(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), (F.col("o_orderkey") % 7 + 1).alias("length"), F.array("o_orderpriority", "o_orderstatus", "o_orderpriority").alias("tasks"))
    found = snapshot.semantic_episodes(e, _relations(spark, d))
    return found.select("episode_index", "length", F.array_join("tasks", "|").alias("tasks"), F.array_join("cameras", "|").alias("cameras"), "n_files")


@query("SELECT 'orders' AS name, CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN count(*) ELSE 0 END AS n FROM orders UNION ALL SELECT 'lines', CASE WHEN count(*) = count(DISTINCT l_orderkey) THEN count(*) ELSE 0 END FROM lineitem")
def keyed_uniqueness(spark, d):
    of = lambda name, t, k: keys.unique_or_null(read(spark, d, t), k).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return of("orders", "orders", "o_orderkey").unionByName(of("lines", "lineitem", "l_orderkey"))


@query("""
WITH m AS (SELECT l_returnflag AS feature, min(least(l_quantity, l_linenumber)) AS minimum, max(greatest(l_quantity, l_linenumber)) AS maximum FROM lineitem GROUP BY 1),
s AS (SELECT l_linestatus AS feature, count(*) AS spans FROM (SELECT DISTINCT l_linestatus, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49) GROUP BY 1)
SELECT coalesce(m.feature, s.feature) AS feature, CASE WHEN m.feature IS NOT NULL THEN 2 END AS dims, minimum, maximum, spans, CASE WHEN s.feature IS NOT NULL THEN 'validated_static_span' END AS semantics FROM m FULL JOIN s ON s.feature = m.feature
""")
def measurement_contract(spark, d):
    lines = read(spark, d, "lineitem")
    moments = numeric.moments(lines.select(F.col("l_returnflag").alias("feature"), F.array("l_quantity", F.col("l_linenumber").cast("double")).alias("v")), "v", ["feature"])
    spans = lines.where("l_quantity > 49").select(F.col("l_linestatus").alias("feature"), F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").alias("first"), F.col("l_linenumber").alias("last")).distinct()
    found = evidence.measurements(moments, spans)
    return found.select("feature", F.when(F.col("variance").isNotNull(), F.size("variance")).alias("dims"), "minimum", "maximum", F.when(F.col("idle_spans").isNotNull(), F.size("idle_spans").cast("long")).alias("spans"), "semantics")


@query("SELECT bool_or(p_size > 40 AND p_partkey % 2 = 0) AND bool_or(p_size > 40 AND p_partkey % 2 = 1) AS complete FROM part")
def media_completeness(spark, d):
    rows = read(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "media.metadata").otherwise("media.decode").alias("capability"), F.when(F.col("p_size") > 40, "complete").otherwise("partial").alias("status"), F.lit("sample").alias("integrity"))
    return evidence.media_complete(rows)


@query("""
SELECT p_partkey, name, prepared, wanted FROM (
  SELECT p_partkey, 'integrity' AS name, ['metadata', 'sample', 'full'][p_size % 3 + 1] AS prepared, ['metadata', 'sample', 'full'][p_partkey % 3 + 1] AS wanted, p_size % 3 < p_partkey % 3 AS bad FROM part
  UNION ALL SELECT p_partkey, 'checksum', CASE WHEN p_size % 2 = 0 THEN 'sha256' END, CASE WHEN p_partkey % 2 = 0 THEN 'sha256' END, p_partkey % 2 = 0 AND p_size % 2 = 1 FROM part
  UNION ALL SELECT p_partkey, 'input_format', 'lerobot', ['auto', 'video', 'lerobot'][p_partkey % 3 + 1], p_partkey % 3 = 1 FROM part) WHERE bad
""")
def prepared_reuse(spark, d):
    """One request and one prepared snapshot per part; the names carry the part, as every part asks for its own."""
    p = read(spark, d, "part")
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c % len(v) + 1).cast("int"))
    depth = ("metadata", "sample", "full")
    fields = [("integrity", pick(F.col("p_size"), *depth), pick(F.col("p_partkey"), *depth)), ("checksum", F.when(F.col("p_size") % 2 == 0, "sha256"), F.when(F.col("p_partkey") % 2 == 0, "sha256")), ("input_format", F.lit("lerobot"), pick(F.col("p_partkey"), "auto", "video", "lerobot"))]
    out = None
    for name, have, want in fields:
        rows = p.select("p_partkey", F.lit(name).alias("name"), have.alias("have"), want.alias("want"))
        for pair in rows.select("have", "want").distinct().collect():  # at most nine pairs of options
            one = lambda v: spark.createDataFrame([(name, v)], "name string, value string")  # noqa: B023, E731
            bad = evidence.reusable(one(pair["have"]), one(pair["want"]))
            part = rows.where(F.col("have").eqNullSafe(pair["have"]) & F.col("want").eqNullSafe(pair["want"])).select("p_partkey", "name").join(F.broadcast(bad), "name")
            out = part if out is None else out.unionByName(part)
    return out.select("p_partkey", "name", "prepared", "wanted")


@query("SELECT s_suppkey AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'integrity' WHEN s_suppkey % 4 = 0 THEN 'decode' ELSE 'digest' END AS reason FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 OR s_suppkey % 5 = 0")
def prepared_videos(spark, d):
    k = F.col("s_suppkey")
    v = read(spark, d, "supplier").select(k.alias("path"), F.when(k % 3 == 0, "metadata").when(k % 3 == 1, "sample").otherwise("full").alias("integrity"), F.when(k % 4 != 0, True).alias("decode_valid"), F.when(k % 5 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"))
    return evidence.uncovered_videos(v, "sample", "sha256")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 3 = 0 AND page_id % 5 < 3 THEN 'publication_metadata' ELSE 'snapshot_format_metadata' END AS source FROM pages")
def publication_source(spark, d):
    k = F.col("page_id")
    return read(spark, d, "pages").select("page_id", evidence.publication_source(F.when(k % 2 == 0, "hub").otherwise("local"), k % 3 == 0, k % 5 < 3).alias("source"))


@query("""
SELECT event_id AS name, CASE event_id % 6 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'unverified' WHEN 3 THEN CASE WHEN event_id % 4 = 0 THEN 'passed' ELSE 'failed' END WHEN 4 THEN 'unverified' ELSE 'failed' END AS status FROM events
""")
def loader_results(spark, d):
    k = F.col("event_id")
    kind = F.when(k % 6 < 2, "boolean").when(k % 6 == 2, "none").when(k % 6 == 5, "other").otherwise("object")
    rows = read(spark, d, "events").select(k.alias("name"), kind.alias("kind"), F.when(k % 6 == 0, True).when(k % 6 == 1, False).alias("ok"), F.when(k % 6 == 3, "Success").when(k % 6 == 4, "unavailable").alias("status"), (k % 4).alias("loaded"))
    return evidence.loader_status(rows, F.lit(0))


@query(f"SELECT episode_index, feature_key AS key, path, from_timestamp, to_timestamp, least(180.0, greatest(0.0, to_timestamp - from_timestamp)) AS preview_seconds FROM {SEGMENTS}")
def segment_details(spark, d):
    return evidence.segment_details(_relations(spark, d))


@query(f"""
SELECT o_orderkey AS episode_index, o_orderkey % 7 + 1 AS length, n AS videos, CASE WHEN o_orderkey % 10 = 0 THEN 1 END AS findings FROM orders LEFT JOIN (SELECT episode_index, count(*) AS n FROM {SEGMENTS} GROUP BY 1) v ON v.episode_index = o_orderkey
""")
def episode_details(spark, d):
    e = read(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), (F.col("o_orderkey") % 7 + 1).alias("length"), F.array("o_orderpriority").alias("tasks"))
    found = model.findings(e.where("episode_index % 10 = 0"), "ADVISORY_SHORT_EPISODE", episode_index=F.col("episode_index"))
    out = evidence.episode_details(e, _relations(spark, d), found)
    return out.select("episode_index", "length", F.when(F.col("videos").isNotNull(), F.size("videos").cast("long")).alias("videos"), F.when(F.col("findings").isNotNull(), F.size("findings")).alias("findings"))


@query("SELECT p_type AS adapter, CASE p_type WHEN 'lerobot_v21' THEN 'LeRobot v2.1' ELSE p_type END AS label FROM (SELECT DISTINCT p_type FROM part UNION SELECT 'lerobot_v21')")
def adapter_labels(spark, d):
    rows = read(spark, d, "part").select("p_type").unionByName(spark.createDataFrame([("lerobot_v21",)], "p_type string")).distinct()
    return rows.select(F.col("p_type").alias("adapter"), evidence.adapter_label(F.col("p_type")).alias("label"))


@query("SELECT p_partkey AS path, p_partkey % 11 > 0 AND p_size % 10 > 0 AND p_size > 3 AS valid FROM part")
def metadata_validity(spark, d):
    v = read(spark, d, "part").select(F.col("p_partkey").alias("path"), (F.col("p_size") - 3).alias("width"), F.lit(4).alias("height"), F.col("p_size").alias("frame_count"), (F.col("p_size") % 10).cast("double").alias("fps"), (F.col("p_partkey") % 11).alias("duration"))
    return v.select("path", media.metadata_valid().alias("valid"))


@query("""
WITH v AS (SELECT *, p_partkey % 11 > 0 AND p_size % 10 > 0 AND p_size > 3 AND p_partkey % 13 <> 0 AS ok FROM part)
SELECT count(*) AS files, count(*) FILTER (ok) AS valid, CAST(sum(p_size) FILTER (ok) AS BIGINT) AS frames, CAST(sum(p_partkey % 11) FILTER (ok) AS BIGINT) AS seconds, CAST(sum(p_partkey) FILTER (ok) AS BIGINT) AS bytes, count(DISTINCT p_size - 3) FILTER (ok) AS resolutions FROM v
""")
def scan_totals(spark, d):
    v = read(spark, d, "part").select(F.col("p_partkey").alias("size_bytes"), (F.col("p_size") - 3).alias("width"), F.lit(4).alias("height"), F.col("p_size").alias("frame_count"), (F.col("p_size") % 10).cast("double").alias("fps"), (F.col("p_partkey") % 11).alias("duration"), (F.col("p_partkey") % 13 != 0).alias("decode_valid"))
    return media.scan_summary(v)


@query("SELECT p_brand AS feature, field FROM (SELECT p_brand, unnest(['min', 'max']) AS field, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand) WHERE (field = 'min' AND lo <= 1) OR (field = 'max' AND hi >= 50)")
def stats_missing(spark, d):
    """Stored statistics lack the minimum of brands that reach size 1 and the maximum of those that reach size 50."""
    g = read(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    stored = g.select("feature", F.when(F.col("lo") > 1, F.col("lo")).alias("min"), F.when(F.col("hi") < 50, F.col("hi")).alias("max"))
    return numeric.stats_incomplete(g, stored, ["min", "max"])


@query("SELECT l_partkey AS path, count(DISTINCT l_suppkey) AS n_sizes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def sizes_in_conflict(spark, d):
    return remote.conflicting_sizes(read(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("size_bytes")))


@query("SELECT source, CASE WHEN count(*) = count(n) THEN CAST(sum(n) AS BIGINT) END AS bytes FROM (SELECT source, CASE WHEN lang <> 'fr' THEN n_chars END AS n FROM documents) GROUP BY 1")
def known_sizes(spark, d):
    return read(spark, d, "documents").select("source", F.when(F.col("lang") != "fr", F.col("n_chars")).alias("n")).groupBy("source").agg(media.known_sum("n").alias("bytes"))


# ---------------------------------------------------------------- differences


@query("""
SELECT component, kind, path, class, before, after FROM (
  SELECT 'source' AS component, 'revision_changed' AS kind, '/source/revision' AS path, 'material' AS class, min(n_name) AS before, max(n_name) AS after FROM nation
  UNION ALL SELECT 'format', 'adapter_changed', '/format/adapter', 'breaking', min(r_name), max(r_name) FROM region
  UNION ALL SELECT 'format', 'metadata_changed', '/format/metadata', 'non_breaking', min(p_brand), max(p_brand) FROM part
  UNION ALL SELECT 'coverage', 'changed', '/coverage/' || replace(o_orderpriority, '/', '~1'), 'non_breaking', CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR) FROM orders GROUP BY o_orderpriority HAVING count(*) <> count(*) FILTER (o_orderstatus = 'F')) WHERE before <> after
""")
def fact_changes(spark, d):
    fact = lambda t, c, component, name, f: read(spark, d, t).agg(f(c).alias("value")).select(F.lit(component).alias("component"), F.lit(name).alias("name"), "value")
    cover = lambda rows: rows.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("coverage").alias("component"), "name", "value")
    side = lambda f, orders: fact("nation", "n_name", "source", "revision", f).unionByName(fact("region", "r_name", "format", "adapter", f)).unionByName(fact("part", "p_brand", "format", "metadata", f)).unionByName(cover(orders))
    o = read(spark, d, "orders")
    return diff.facts(side(F.min, o), side(F.max, o.withColumn("o", F.col("o_orderstatus") == "F").where("o")))


@query("SELECT 'features' AS component, 'removed' AS kind, '/features/' || p_partkey AS path, 'breaking' AS class FROM part WHERE p_size = 50 UNION ALL SELECT 'format', 'adapter_changed', '/format/adapter', 'breaking'")
def merge_regressions(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("feature"), "p_brand", "p_size")
    changes = diff.keyed(p, p.where("p_size <> 50").withColumn("p_brand", F.when(F.col("p_size") == 1, "other").otherwise(F.col("p_brand"))), "features", "feature", [("metadata_changed", ["p_brand"])])
    fact = lambda v: spark.createDataFrame([("format", "adapter", v), ("source", "revision", v)], "component string, name string, value string")
    return diff.regressions(changes.unionByName(diff.facts(fact("a"), fact("b")))).select("component", "kind", "path", "class")


@query("SELECT class, component, path, kind FROM (SELECT 'material' AS class, 'episodes' AS component, '/episodes/' || o_orderkey AS path, 'removed' AS kind FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'breaking', 'features', '/features/' || n_nationkey, 'removed' FROM nation WHERE n_regionkey = 1) ORDER BY CASE class WHEN 'breaking' THEN 0 ELSE 1 END, component, path, kind LIMIT 30")
def changes_in_order(spark, d):
    """The first 30 changes of a report; the limit is the report's."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    n = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    e = diff.keyed(o, o.where("o_orderstatus <> 'P'"), "episodes", "o_orderkey", [("content_changed", ["o_custkey"])])
    return diff.ordered(e.unionByName(diff.keyed(n, n.where("n_regionkey <> 1"), "features", "n_nationkey", [("names_changed", ["n_name"])]))).limit(30).select("class", "component", "path", "kind")


# ---------------------------------------------------------------- merges


@query("SELECT 'format_and_version' AS \"check\", CASE WHEN count(*) FILTER (n_nationkey % 6 NOT IN (2, 3)) > 0 THEN 'incompatible' WHEN count(DISTINCT n_nationkey % 6) > 1 THEN 'transform_required' ELSE 'direct' END AS status, n_regionkey AS region FROM nation GROUP BY n_regionkey")
def merge_formats(spark, d):
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("source"), (F.col("n_nationkey") % 6).alias("major"))
    out = None
    for r in n.select("region").distinct().collect():  # regions are five
        part = merge.format_check(n.where(F.col("region") == r["region"])).withColumn("region", F.lit(r["region"]))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT c_mktsegment AS feature, CAST(c_nationkey % 3 AS VARCHAR) AS key, CASE WHEN count(DISTINCT round(c_acctbal / 4000)) > 1 THEN 'incompatible' WHEN count(DISTINCT CASE WHEN c_acctbal IS NOT NULL THEN c_nationkey END) < (SELECT count(DISTINCT c_nationkey) FROM customer) THEN 'unknown' ELSE 'direct' END AS status FROM customer GROUP BY ALL")
def merge_coordinates(spark, d):
    return merge.coordinates_check(read(spark, d, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("feature"), (F.col("c_nationkey") % 3).cast("string").alias("key"), F.round(F.col("c_acctbal") / 4000).alias("value")))


TIMING = """
WITH s AS (SELECT n_regionkey AS source, s_nationkey AS camera, CASE WHEN s_suppkey % 40 <> 0 THEN 30 + CASE WHEN s_nationkey % 5 = 0 THEN s_suppkey % 2 ELSE 0 END END AS fps, s_nationkey % 2 * (s_suppkey % 2) AS resolution, s_suppkey % 2 AS codec FROM supplier JOIN nation ON n_nationkey = s_nationkey),
g AS (SELECT camera, count(DISTINCT source) AS n, count(DISTINCT fps) AS f, count(DISTINCT resolution) AS r, count(DISTINCT codec) AS c, count(*) FILTER (fps IS NULL OR resolution IS NULL) AS lost FROM s GROUP BY 1)
SELECT camera, CASE WHEN n < w OR f > 1 THEN 'incompatible' WHEN lost > 0 THEN 'unknown' WHEN r > 1 OR c > 1 THEN 'transform_required' ELSE 'direct' END AS status, CASE WHEN n < w THEN 'missing' WHEN f > 1 THEN 'fps' WHEN lost > 0 THEN 'unknown' WHEN r > 1 THEN 'resolution' WHEN c > 1 THEN 'codec' ELSE 'same' END AS reason
FROM g, (SELECT count(DISTINCT source) AS w FROM (SELECT DISTINCT source % 1 AS source FROM s))
"""


@query(TIMING)
def merge_timing(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    fps = F.when(k % 40 != 0, F.lit(30) + F.when(F.col("s_nationkey") % 5 == 0, k % 2).otherwise(0))
    # one input, so that no camera is missing from another
    return merge.timing_check(s.select((F.col("n_regionkey") % 1).alias("source"), F.col("s_nationkey").alias("camera"), fps.alias("fps"), (F.col("s_nationkey") % 2 * (k % 2)).alias("resolution"), (k % 2).alias("codec")))


@query("""
SELECT source, task, reason FROM (
  SELECT p_brand AS source, p_type AS task, 'duplicate_text' AS reason FROM part GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT p_brand, min(p_type), 'duplicate_index' FROM part GROUP BY p_brand, p_size HAVING count(*) > 1
  UNION ALL SELECT DISTINCT p_brand, 'task of ' || p_size, 'undeclared' FROM part WHERE p_size > 45)
""")
def merge_tasks(spark, d):
    p = read(spark, d, "part")
    tasks = p.select(F.col("p_brand").alias("source"), F.col("p_size").alias("task_index"), F.col("p_type").alias("task"))
    refs = tasks.select("source", "task").unionByName(p.where("p_size > 45").select(F.col("p_brand").alias("source"), F.concat(F.lit("task of "), "p_size").alias("task")))
    return merge.task_check(tasks, refs)


@query("SELECT c_mktsegment AS key, CASE WHEN count(DISTINCT c_nationkey // 30) > 1 THEN 'incompatible' WHEN count(*) FILTER (c_custkey % 500 = 0) > 0 THEN 'unknown' ELSE 'direct' END AS status FROM customer GROUP BY 1")
def merge_embodiment(spark, d):
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.when(F.col("c_custkey") % 500 != 0, F.floor(F.col("c_nationkey") / 30)).alias("value"))
    return merge.agreement(c, "key", "value")


@query("""
SELECT p_type AS feature, CASE WHEN n < w OR f > 1 OR s > 1 THEN 'incompatible' WHEN d > 1 THEN 'transform_required' ELSE 'direct' END AS status, CASE WHEN n < w THEN 'missing' WHEN f > 1 THEN 'dtype_family' WHEN s > 1 THEN 'shape' WHEN d > 1 THEN 'dtype' ELSE 'same' END AS reason
FROM (SELECT p_type, count(DISTINCT p_partkey % 2) AS n, count(DISTINCT CASE WHEN p_size = 50 THEN 'int' ELSE 'float' END) AS f, count(DISTINCT CASE WHEN p_size = 49 THEN 3 ELSE 2 END) AS s, count(DISTINCT CASE WHEN p_size = 50 THEN 'i' WHEN p_size > 46 THEN 'f8' ELSE 'f4' END) AS d FROM part GROUP BY 1), (SELECT count(DISTINCT p_partkey % 2) AS w FROM part)
""")
def merge_feature_tables(spark, d):
    """Parts as features of two inputs, by type; some sizes have another type or shape."""
    size = F.col("p_size")
    rows = read(spark, d, "part").select((F.col("p_partkey") % 2).alias("source"), F.col("p_type").alias("feature"), F.when(size == 50, "int64").when(size > 46, "float64").otherwise("float32").alias("dtype"), F.array(F.when(size == 49, 3).otherwise(2)).alias("shape"))
    return merge.feature_check(rows)


@query("SELECT c_mktsegment AS segment, CASE max(c_nationkey % 4) WHEN 0 THEN 'direct' WHEN 1 THEN 'transform_required' WHEN 2 THEN 'unknown' ELSE 'incompatible' END AS decision, count(*) AS checks FROM customer WHERE c_nationkey % 4 < 2 + length(c_mktsegment) % 3 GROUP BY 1")
def merge_decisions(spark, d):
    """One decision for each market segment, over checks whose status follows the nation."""
    c = read(spark, d, "customer").where("c_nationkey % 4 < 2 + length(c_mktsegment) % 3").select("c_mktsegment", F.element_at(F.array(*map(F.lit, merge.RANK)), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("status"))
    out = None
    for r in c.select("c_mktsegment").distinct().collect():  # segments are five
        one = merge.decision(c.where(F.col("c_mktsegment") == r[0])).select(F.lit(r[0]).alias("segment"), "decision", "checks")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id AS source, CASE WHEN trim(coalesce(l, '')) = '' THEN 'unknown' WHEN contains(lower(l), 'nc') OR contains(lower(l), 'nd') THEN 'incompatible' ELSE 'direct' END AS status FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CC-BY-NC-4.0' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE 'apache-2.0 ' || source END AS l FROM documents)")
def merge_licenses(spark, d):
    k = F.col("doc_id")
    rows = read(spark, d, "documents").select(k.alias("source"), F.when(k % 4 == 0, "CC-BY-NC-4.0").when(k % 4 == 1, "  ").when(k % 4 == 3, F.concat(F.lit("apache-2.0 "), "source")).alias("license"))
    return merge.license_check(rows, ["nc", "nd"])


@query("SELECT CAST(o_custkey AS VARCHAR) AS identity, CASE WHEN count(*) > 1 THEN 'incompatible' WHEN o_orderstatus <> 'F' THEN 'unknown' ELSE 'direct' END AS status FROM orders GROUP BY o_custkey, o_orderstatus")
def merge_lineage(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("identity"), F.when(F.col("o_orderstatus") == "F", F.sha1(F.lit("pinned"))).otherwise(F.col("o_orderstatus")).alias("revision"))
    return merge.lineage_check(o)


@query("SELECT p_type AS task, CAST(count(*) AS BIGINT) AS to_index FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 48) GROUP BY 1")
def remap_unknown(spark, d):
    p = read(spark, d, "part")
    remap = p.groupBy(F.col("p_type").alias("task")).agg(F.count(F.lit(1)).alias("to_index"))
    return merge.unknown_remap_keys(remap, p.where("p_size > 48").select(F.col("p_type").alias("task")))


CHECKS = """
SELECT 'premerge_compatibility' AS "check", 'passed' AS status, 'direct' AS detail UNION ALL SELECT 'post_snapshot', 'passed', '0'
UNION ALL SELECT 'full_audit', 'failed', CAST(count(*) AS VARCHAR) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'full_audit', 'passed', '0' FROM (SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) WHERE n = 0
UNION ALL SELECT 'loader_smoke', 'unverified', NULL
UNION ALL SELECT 'lineage', 'unverified', CAST(count(*) AS VARCHAR) FROM nation
UNION ALL SELECT 'semantic_reconciliation', 'failed', CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderkey % 100 = 0
UNION ALL SELECT 'semantic_diffs', 'passed', '0'
"""


def _post_merge(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    audit = model.findings(keys.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "LEROBOT_FRAME_INDEX_DUPLICATE", episode_index=F.col("l_orderkey"))
    lineage = merge.lineage_check(read(spark, d, "nation").select(F.col("n_name").alias("identity"), F.lit("main").alias("revision")))
    reconciled = merge.reconcile(o, o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 == 0, -1).otherwise(F.col("o_custkey"))), "o_orderkey", ["o_custkey"])
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    regressions = diff.regressions(diff.keyed(n, n, "features", "n_nationkey", [("names_changed", ["n_name"])]))
    same = snapshot.fingerprints(_components(spark, d))
    fingerprint = same.select(F.col("component").alias("name"), F.col("fingerprint").alias("wanted"), F.col("fingerprint").alias("found"))
    decision = merge.decision(spark.createDataFrame([("direct",)], "status string"))
    return receipts.post_merge_checks(decision, audit, receipts.run(spark, d, "loader", None), lineage, reconciled, regressions, fingerprint)


@query(CHECKS)
def post_merge_checks(spark, d):
    return _post_merge(spark, d)


@query(f'SELECT \'unverified\' AS status, count(*) FILTER (status = \'passed\') AS passed, count(*) FILTER (status = \'failed\') AS failed, count(*) FILTER (status = \'unverified\') AS unverified, 64 AS fingerprint FROM ({CHECKS})')
def merge_receipt(spark, d):
    r = receipts.receipt(_post_merge(spark, d), ["a", "b"], "merged")
    return spark.createDataFrame([(r["status"], r["summary"]["passed"], r["summary"]["failed"], r["summary"]["unverified"], len(r["fingerprint"]))], "status string, passed long, failed long, unverified long, fingerprint int")


@query("SELECT CASE WHEN count(*) FILTER (p_size > 49) > 0 THEN 'failed' ELSE 'passed' END AS status, count(*) AS n, count(*) FILTER (p_size > 49) AS bad FROM part")
def verification_status(spark, d):
    return merge.verification(read(spark, d, "part").select(F.col("p_name").alias("check"), F.when(F.col("p_size") > 49, "unverified").otherwise("passed").alias("status")))


# ---------------------------------------------------------------- repairs


PLAN = "(SELECT ['/total_episodes', '/total_frames', '/total_tasks', '/total_videos', '/fps'][p_partkey % 5 + 1] || CASE WHEN p_partkey > 20 THEN '/' || p_partkey ELSE '' END AS pointer, p_size AS before, CASE WHEN p_size % 9 = 0 THEN -1 WHEN p_size % 9 = 1 THEN NULL ELSE p_size + 1 END AS after FROM part)"


def _plan(spark, d):
    k = F.col("p_partkey")
    place = F.element_at(F.array(*map(F.lit, [*repair.POINTERS, "/fps"])), (k % 5 + 1).cast("int"))
    size = F.col("p_size")
    return read(spark, d, "part").select(F.concat(place, F.when(k > 20, F.concat(F.lit("/"), k)).otherwise("")).alias("pointer"), size.alias("before"), F.when(size % 9 == 0, -1).when(size % 9 == 1, F.lit(None)).otherwise(size + 1).alias("after"))


@query(f"SELECT pointer, before, after, reason FROM (SELECT *, CASE WHEN pointer NOT IN ('/total_episodes', '/total_frames', '/total_tasks', '/total_videos') THEN 'pointer' WHEN count(*) OVER (PARTITION BY pointer) > 1 THEN 'repeated' WHEN coalesce(after, -1) < 0 THEN 'value' END AS reason FROM {PLAN}) WHERE reason IS NOT NULL")
def repair_refused(spark, d):
    return repair.refused(_plan(spark, d))


@query("SELECT '/' || s_suppkey AS pointer, s_nationkey AS before, s_nationkey + 1 AS after, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 5 END AS now FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 7 = 0")
def repair_stale(spark, d):
    s = read(spark, d, "supplier")
    p = s.select(F.concat(F.lit("/"), "s_suppkey").alias("pointer"), F.col("s_nationkey").alias("before"), (F.col("s_nationkey") + 1).alias("after"))
    now = s.where("s_suppkey % 7 <> 0 OR s_suppkey % 3 = 0").select(F.concat(F.lit("/"), "s_suppkey").alias("pointer"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") + 5).otherwise(F.col("s_nationkey")).alias("declared"))
    return repair.stale(p, now)


@query("SELECT CAST(l_orderkey AS BIGINT) AS episode_index, 'high' AS risk FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT o_orderkey, 'low' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT n_nationkey, 'medium' FROM nation")
def repair_unresolved(spark, d):
    a = model.findings(keys.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "LEROBOT_FRAME_INDEX_DUPLICATE", episode_index=F.col("l_orderkey"))
    b = model.findings(read(spark, d, "orders").where("o_orderstatus = 'P'"), "ADVISORY_SHORT_EPISODE", episode_index=F.col("o_orderkey"))
    c = model.findings(read(spark, d, "nation"), "LEROBOT_TASK_COUNT_MISMATCH", episode_index=F.col("n_nationkey"))
    return repair.unresolved(a.unionByName(b).unionByName(c)).select("episode_index", "risk")


# ---------------------------------------------------------------- remote plans


@query("""
SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 'o' || page_id END AS owner, CASE WHEN page_id % 4 < 2 THEN 'set.' || page_id END AS name, CASE page_id % 4 WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN sha1(CAST(page_id AS VARCHAR)) ELSE 'main' END END AS revision, page_id % 4 = 1 AND page_id % 3 = 0 AS pinned FROM pages
""")
def hub_sources(spark, d):
    k = F.col("page_id")
    base = F.concat(F.lit("hf://datasets/o"), k, F.lit("/set."), k)
    s = F.when(k % 4 == 0, base).when(k % 4 == 1, F.concat(base, F.lit("@"), F.when(k % 3 == 0, F.sha1(k.cast("string"))).otherwise("main"))).when(k % 4 == 2, F.concat(base, F.lit("?x=1"))).otherwise(F.concat(F.lit("https://h/"), k))
    return remote.parse_sources(read(spark, d, "pages").select("page_id", s.alias("source"))).drop("source")


def _hub(spark, d):
    o = read(spark, d, "orders")
    e = o.select(F.col("o_orderkey").alias("episode_index"))
    rel = o.select(F.lit("data").alias("kind"), F.col("o_orderkey").alias("episode_index"), F.concat(F.lit("data/"), F.col("o_orderkey") % 40).alias("path"), F.lit(None).cast("string").alias("feature_key"))
    video = o.select(F.lit("video").alias("kind"), F.col("o_orderkey").alias("episode_index"), F.concat(F.lit("videos/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey") % 10).alias("path"), F.col("o_orderstatus").alias("feature_key"))
    every = rel.unionByName(video)
    inventory = every.select("path").distinct().withColumn("size_bytes", F.lit(10).cast("long"))
    # so many episodes and shards that only the bytes bind
    return remote.payload_plan(every, inventory, e, remote.Budget(bytes=150, shards=1000, episodes=1_000_000, media=1000))


HUB_FILES = "SELECT 'data' AS kind, 'data/' || o_orderkey % 40 AS path, min(o_orderkey) AS first, 0 AS k FROM orders GROUP BY o_orderkey % 40"


@query(f"""
WITH dd AS ({HUB_FILES}), v AS (SELECT 'video' AS kind, 'videos/' || o_orderstatus || '/' || o_orderkey % 10 AS path FROM orders GROUP BY ALL),
r AS (SELECT path, row_number() OVER (ORDER BY first, path) AS n FROM dd)
SELECT kind, path, CAST(10 AS BIGINT) AS size_bytes, CASE WHEN n * 10 <= 150 THEN CAST(n * 10 AS BIGINT) END AS running, CASE WHEN n * 10 <= 150 THEN 'selected' ELSE 'budget' END AS state FROM (SELECT dd.kind, dd.path, n FROM dd JOIN r ON r.path = dd.path UNION ALL SELECT kind, path, 1000 FROM v)
""")
def hub_plan(spark, d):
    return _hub(spark, d).select("kind", "path", "size_bytes", "running", "state")


@query("SELECT 'data' AS kind, least(count(DISTINCT o_orderkey % 40), 15) AS selected, count(DISTINCT o_orderkey % 40) AS total, CASE WHEN count(DISTINCT o_orderkey % 40) > 15 THEN 'partial' ELSE 'complete' END AS status FROM orders UNION ALL SELECT 'video', CAST(0 AS BIGINT), count(DISTINCT o_orderstatus || o_orderkey % 10), 'unavailable' FROM orders")
def hub_coverage(spark, d):
    return remote.coverage(_hub(spark, d))


@query(f"SELECT path, 'data' AS kind, length(path) % 2 = 0 AS there FROM (SELECT path, row_number() OVER (ORDER BY first, path) AS n FROM ({HUB_FILES})) WHERE n <= 15")
def hub_fetched(spark, d):
    plan = _hub(spark, d)
    return remote.fetched(plan, plan.where("length(path) % 2 = 0").select("path"))


@query(f"SELECT path, 'LEROBOT_DATA_MISSING' AS code FROM (SELECT path, row_number() OVER (ORDER BY first, path) AS n FROM ({HUB_FILES})) WHERE n <= 15")
def hub_suppressed(spark, d):
    """Missing-file findings of every planned path, and one over counts: only those of fetched files stay."""
    plan = _hub(spark, d)
    found = model.findings(plan, "LEROBOT_DATA_MISSING", path=F.col("path")).unionByName(model.findings(spark.range(1), "LEROBOT_VIDEO_COUNT_MISMATCH"))
    return remote.suppressed(found, plan).select("path", "code")


@query("SELECT key FROM (SELECT unnest(['license', 'pretty_name', 'tags', 'task_categories']) AS key) WHERE key NOT IN (SELECT CASE r_regionkey WHEN 0 THEN 'license' WHEN 1 THEN 'tags' ELSE r_name END FROM region)")
def publication_missing(spark, d):
    card = read(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, "license").when(F.col("r_regionkey") == 1, "tags").otherwise(F.col("r_name")).alias("key"), F.col("r_name").alias("value"))
    return remote.missing_publication(card)


@query("SELECT name, value, CASE name WHEN 'AMERICA' THEN 'complete' ELSE 'complete' END AS status FROM (SELECT r_name AS name, CAST(r_regionkey AS DOUBLE) AS value FROM region) UNION ALL SELECT 'frames', CAST((SELECT count(*) FROM lineitem) AS DOUBLE), CASE WHEN (SELECT count(DISTINCT o_orderkey % 40) FROM orders) > 15 THEN 'partial' ELSE 'complete' END UNION ALL SELECT 'media_shards', 3.0, 'unavailable'")
def hub_projection(spark, d):
    totals = read(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("double").alias("value"))
    totals = totals.unionByName(read(spark, d, "lineitem").agg(F.lit("frames").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))).unionByName(spark.createDataFrame([("media_shards", 3.0)], "name string, value double"))
    return evidence.hub_projection(totals, remote.coverage(_hub(spark, d)))


# ---------------------------------------------------------------- readiness


@query("""
SELECT feature, code FROM (SELECT p_partkey AS feature, p_partkey % 10 = 0 AS lost, p_size % 5 = 1 AS t, p_size % 4 = 0 AS s, p_size % 6 = 0 AS a, p_size % 7 = 0 AS n, p_size % 8 = 0 AS h, unnest(['READINESS_FEATURE_MISSING', 'READINESS_FEATURE_DTYPE_MISMATCH', 'READINESS_FEATURE_SHAPE_MISMATCH', 'READINESS_ACTION_DIMENSION_MISMATCH', 'READINESS_NORMALIZATION_MISMATCH', 'READINESS_DELTA_HORIZON_MISMATCH']) AS code FROM part)
WHERE CASE code WHEN 'READINESS_FEATURE_MISSING' THEN lost WHEN 'READINESS_FEATURE_DTYPE_MISMATCH' THEN NOT lost AND t WHEN 'READINESS_FEATURE_SHAPE_MISMATCH' THEN NOT lost AND s WHEN 'READINESS_ACTION_DIMENSION_MISMATCH' THEN NOT lost AND a WHEN 'READINESS_NORMALIZATION_MISMATCH' THEN NOT lost AND n ELSE NOT lost AND h END
""")
def gates_of_features(spark, d):
    """Parts as features of shape [2, 7]: every tenth is missing, others miss a requirement by their size."""
    size = F.col("p_size")
    p = read(spark, d, "part").withColumn("feature", F.col("p_partkey").cast("string"))
    features = p.where("p_partkey % 10 <> 0").select("feature", F.when(size % 5 == 1, "int64").otherwise("float32").alias("dtype"), F.array(F.lit(2), F.lit(7)).cast("array<long>").alias("shape"), F.when(size % 7 != 0, "mean_std").alias("normalization"), F.when(size % 8 != 0, F.array(F.lit(0.0), F.lit(0.1))).alias("deltas"))
    need = p.select(
        "feature", F.lit("float32").alias("dtype"), F.when(size % 4 == 0, F.array(F.lit(3), F.lit(7))).otherwise(F.array(F.lit(2), F.lit(7))).cast("array<long>").alias("shape"), F.lit(1).alias("min_rank"), F.lit(9).cast("long").alias("max_last_dim"),
        F.when(size % 6 == 0, 6).otherwise(7).cast("long").alias("action_dim"), F.lit("mean_std").alias("normalization"), F.array(F.lit(0.0), F.lit(0.1)).alias("deltas"),
    )
    return gates.feature_gates(need, features).select(F.col("feature").cast("long").alias("feature"), "code")


@query("SELECT code, count(*) AS n FROM (SELECT 'READINESS_FORMAT_INCOMPATIBLE' AS code FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'READINESS_ADAPTER_INCOMPATIBLE' FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'READINESS_DATASET_VERSION_INCOMPATIBLE' FROM part WHERE p_size % 5 IN (0, 1)) GROUP BY 1")
def gates_of_formats(spark, d):
    size = F.col("p_size")
    facts = read(spark, d, "part").select(F.when(size % 2 == 0, "video").otherwise("lerobot").alias("input_format"), F.when(size % 3 == 0, "other").otherwise("lerobot_v30").alias("adapter"), F.when(size % 5 == 0, "1.0").when(size % 5 != 1, "3.0").alias("version"))
    return gates.format_gates(facts, ["lerobot"], ["lerobot_v30"], ["3.0", "2.1"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS locator, 'READINESS_HUB_REVISION_UNPINNED' AS code FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0")
def gates_of_revisions(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("locator"), F.when(F.col("o_orderstatus") == "O", "hub").otherwise("local").alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, "main").otherwise(F.sha1(F.col("o_orderkey").cast("string"))).alias("resolved_revision"))
    return gates.revision_gate(o).select("locator", "code")


@query("SELECT 'cap' || s_suppkey AS capability, 'sample' AS minimum, CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'complete' ELSE 'partial' END AS status, CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'metadata' ELSE 'full' END AS integrity FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 2 = 1 OR s_suppkey % 3 = 0")
def gates_of_coverage(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").withColumn("capability", F.concat(F.lit("cap"), k))
    cover = s.where("s_suppkey % 9 <> 0").select("capability", F.when(k % 2 == 0, "complete").otherwise("partial").alias("status"), F.when(k % 3 == 0, "metadata").otherwise("full").alias("integrity"))
    return gates.coverage_gaps(s.select("capability", F.lit("sample").alias("minimum")), cover)


@query("SELECT c_mktsegment AS name, c_mktsegment || '.*' AS pattern, CAST(310 AS BIGINT) AS minimum, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) < 310")
def gates_of_groups(spark, d):
    c = read(spark, d, "customer")
    groups = c.select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("name"), F.concat("c_mktsegment", F.lit(".*")).alias("pattern"), F.lit(310).alias("minimum"))
    return gates.feature_groups(groups, c.select(F.concat("c_mktsegment", F.lit("."), "c_custkey").alias("feature")))


@query("SELECT 'READINESS_METADATA_MISSING' AS code, 'key' || n_nationkey AS key, CASE WHEN n_regionkey = 0 THEN 'error' ELSE 'warning' END AS severity FROM nation WHERE n_nationkey % 3 <> 0")
def gates_of_metadata(spark, d):
    n = read(spark, d, "nation").withColumn("key", F.concat(F.lit("key"), "n_nationkey"))
    return gates.metadata_gates(n.select("key", F.when(F.col("n_regionkey") == 0, "error").otherwise("warning").alias("severity")), n.select("key", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, " ").alias("value")))


@query("SELECT count(*) FILTER (p_size = 50) AS blockers, count(*) FILTER (p_size = 49) AS gaps, CASE WHEN count(*) FILTER (p_size = 50) > 0 THEN 'BLOCKED' WHEN count(*) FILTER (p_size = 49) > 0 THEN 'PARTIAL' ELSE 'READY' END AS status FROM part")
def readiness_of_parts(spark, d):
    p = read(spark, d, "part")
    return gates.status(p.where("p_size = 50"), p.where("p_size = 49"))


