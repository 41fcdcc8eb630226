"""Operators on small frames: the cases in which near misses differ."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from framewright import model
from framewright.functions import text
from framewright.operators import findings, gates, keys, media, merge, numeric, repair, sequence, signals


def one(df):
    return [tuple(r) for r in df.collect()]


def test_registry_has_every_code_once():
    codes = [c for c, *_ in model.rules()]
    assert len(codes) == len(set(codes)) == 89
    assert {s for _, s, _, _ in model.rules()} == set(model.SEVERITIES)


def test_ledger_remembers_the_furthest_end_and_adjacent_pairs_do_not(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 2, 3), (3, 5, 6), (4, 12, 14), (5, 13, 13), (6, None, 9)], "ep long, a long, b long").withColumn("g", F.lit(1))
    assert sorted((r["ep"], r["kind"], r["furthest"]) for r in sequence.ledger(df, ["g"], "a", "b", ["ep"]).collect()) == [(2, "overlap", 10), (3, "overlap", 10), (4, "gap", 10)]
    assert [r["ep"] for r in sequence.adjacent_collisions(df.where("a < b"), ["g"], "a", "b", ["ep"]).collect()] == [2]
    late = spark.createDataFrame([(1, 5, 6)], "ep long, a long, b long").withColumn("g", F.lit(1))
    assert [r["kind"] for r in sequence.ledger(late, ["g"], "a", "b", ["ep"]).collect()] == ["gap"]


def test_gaps_and_contiguity(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (1, 3), (2, 1), (3, 0), (3, 7)], "g long, i long")
    assert sorted(one(keys.gaps(df, ["g"], "i"))) == [(1, 1, 2, 2), (2, 0, 0, 1), (3, 1, 6, 6)]
    expected = spark.createDataFrame([(1, 4), (2, 2), (3, None)], "g long, length long")
    got = {r["g"]: (r["expected"], r["n_missing"], r["n_unexpected"]) for r in keys.contiguity(df, ["g"], "i", expected).collect()}
    assert got == {1: (4, 2, 0), 2: (2, 1, 0), 3: (2, 1, 1)}


def test_orphans_count_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "k long")
    ref = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    assert sorted(one(keys.orphans(df, ref, "k")), key=str) == [(9,), (None,)]
    assert one(keys.absent(ref, df, "k")) == [(2,)]


def test_static_spans_need_consecutive_frames(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 3, "a"), (1, 4, None), (1, 5, None)], "g long, i long, v string")
    assert sorted((r["first"], r["last"], r["length"]) for r in sequence.static_spans(df, ["g"], ["i"], "v", "i").collect()) == [(0, 1, 2), (4, 5, 2)]
    assert sorted((r["first"], r["last"]) for r in sequence.static_spans(df, ["g"], ["i"], "v").collect()) == [(0, 3), (4, 5)]


def test_two_kinds_of_samples_differ(spark):
    assert sequence.even_places(4, 3) == [0, 2, 3] and sequence.even_places(2, 5) == [0, 1] and sequence.even_places(0, 3) == []
    df = spark.range(4).withColumn("g", F.lit(1))
    assert sorted(r["id"] for r in sequence.sample_ends(df, ["id"], ["g"]).collect()) == [0, 1, 3]
    assert sorted(r["id"] for r in sequence.sample_ends(df, ["id"]).collect()) == [0, 1, 3]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ordinals_and_budgets_over_many_partitions(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    df = spark.range(1000).repartition(7)
    got = sequence.ordinal(df, ["id"]).collect()
    assert all(r["id"] == r["ordinal"] for r in got) and len(got) == 1000
    sizes = df.withColumn("size", F.when(F.col("id") == 40, F.lit(None)).otherwise(F.lit(1)))
    assert sequence.budget_prefix(sizes, ["id"], "size", 500).count() == 40
    assert sequence.budget_prefix(df.withColumn("size", F.lit(7)), ["id"], "size", 70).count() == 10
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_moments_drop_rows_with_any_odd_element(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, math.nan],), ([3.0, 4.0],), ([None, 1.0],), (None,)], "v array<double>")
    assert sorted((r["dim"], r["n"], r["mean"], r["var"]) for r in numeric.moments(df, "v").collect()) == [(0, 2, 2.0, 1.0), (1, 2, 3.0, 1.0)]
    assert sorted((r["dim"],) for r in numeric.non_finite(df.withColumn("k", F.lit(1)), ["k"], "v").collect()) == [(0,), (1,)]


def test_tolerances(spark):
    a = spark.createDataFrame([(0, 1.0, 1.0, 100.0, 1.0)], "dim int, min double, max double, mean double, std double")
    b = spark.createDataFrame([(0, 1.0 + 9e-7, 1.0 + 2e-5, 100.0009, 1.0)], "dim int, min double, max double, mean double, std double")
    assert [r["field"] for r in numeric.stats_mismatch(a, b).collect()] == ["max"]


def test_enrichment_takes_the_registry_layer_and_refuses_other_severities(spark):
    found = spark.createDataFrame([("LEROBOT_FRAME_COUNT_MISMATCH", "error", "metadata"), ("OWN", "info", "data")], "code string, severity string, layer string")
    assert sorted((r["code"], r["layer"]) for r in findings.enrich(found, model.registry(spark)).collect()) == [("LEROBOT_FRAME_COUNT_MISMATCH", "alignment"), ("OWN", "data")]
    with pytest.raises(Exception, match="contradicts"):
        findings.enrich(found.withColumn("severity", F.lit("info")), model.registry(spark)).collect()
    with pytest.raises(Exception, match="unknown code"):
        findings.enrich(found, model.registry(spark), "error").collect()


def test_coverage_and_gating(spark):
    rows = spark.createDataFrame([(0, 0), (0, 5), (3, 5), (5, 5), (3, None)], "c long, t long")
    assert [r[0] for r in rows.select(findings.coverage_status(F.col("c"), F.col("t"))).collect()] == ["not_applicable", "unavailable", "partial", "complete", "partial"]


def test_triage_precedence(spark):
    rows = spark.createDataFrame([("error", 1, "f", "c", "p"), ("warning", None, "f", "c", "p"), ("info", None, None, "c", "p"), ("error", None, None, None, "p"), ("info", None, None, None, None)], "severity string, episode_index long, feature_key string, camera string, path string")
    assert sorted((r["kind"], r["errors"], r["warnings"], r["advisories"]) for r in findings.triage(rows).collect()) == [("camera", 0, 0, 1), ("dataset", 0, 0, 1), ("episode", 1, 0, 0), ("feature", 0, 1, 0), ("shard", 1, 0, 0)]


def test_gates_and_status(spark):
    none = spark.createDataFrame([], "code string")
    some = spark.createDataFrame([("X",)], "code string")
    assert [gates.status(a, b).first()["status"] for a, b in ((none, none), (none, some), (some, none))] == ["READY", "PARTIAL", "BLOCKED"]
    facts = spark.createDataFrame([("video", "x", "9")], "input_format string, adapter string, version string")
    assert len(one(gates.format_gates(facts, ["lerobot"], ["v30"], ["3.0"]))) == 3 and len(one(gates.format_gates(facts, ["video"], ["x"], []))) == 0
    src = spark.createDataFrame([("hub", "main"), ("hub", "a" * 40), ("local", None)], "kind string, resolved_revision string")
    assert gates.revision_gate(src).count() == 1


def test_signals(spark):
    eps = spark.createDataFrame([(1, 5), (2, 50)], "e long, n long")
    fps = spark.createDataFrame([(10.0,), (20.0,)], "fps double")
    assert signals.short_episodes(eps, fps, "n", 1.0).count() == 0
    assert [r["e"] for r in signals.short_episodes(eps, fps.limit(1), "n", 1.0).collect()] == [1]
    assert signals.imbalance(spark.createDataFrame([("a",), ("a",)], "t string"), "t").count() == 0


def test_merge_and_repair(spark):
    assert merge.decision(spark.createDataFrame([], "status string")).first()["decision"] == "unknown"
    assert merge.decision(spark.createDataFrame([("direct",), ("transform_required",)], "status string")).first()["decision"] == "transform_required"
    lic = spark.createDataFrame([("a", "CC-BY-NC"), ("b", None), ("c", "mit")], "source string, license string")
    assert sorted(one(merge.license_check(lic, ["nc", "proprietary"]))) == [("a", "incompatible"), ("b", "unknown"), ("c", "direct")]
    eps = spark.createDataFrame([(0, 3), (0, None)], "episode_index long, length long")
    tasks = spark.createDataFrame([(0, "a"), (1, "a")], "task_index long, task string")
    derived = {r["pointer"]: r["derived"] for r in repair.derived_totals(eps, None, tasks, None).collect()}
    assert derived == {"/total_episodes": None, "/total_frames": None, "/total_tasks": None}
    done = spark.createDataFrame([("/total_tasks", 2)], "pointer string, declared long")
    want = spark.createDataFrame([("/total_tasks", 2)], "pointer string, after long")
    assert repair.receipt(want, done).first()["status"] == "verified" and repair.receipt(want, done.limit(0)).first()["status"] == "failed"


def test_video_problems(spark):
    rows = spark.createDataFrame([("a", None, 30.0, 1.0, 4, 4, 10, True), ("b", "x", 0.0, 0.0, 0, 0, 0, None), ("c", None, 0.0, 1.0, 4, 0, 10, False)], "path string, error string, fps double, duration double, width int, height int, frame_count int, decode_valid boolean")
    got = sorted((r["path"], r["code"]) for r in media.video_problems(rows).collect())
    assert got == [("b", "VIDEO_UNREADABLE"), ("c", "VIDEO_INVALID_DIMENSIONS"), ("c", "VIDEO_INVALID_FPS"), ("c", "VIDEO_PREVIEW_DECODE_FAILED")]
    assert [r[0] for r in rows.select(media.metadata_valid()).collect()] == [True, False, False]


def test_text_functions(spark):
    f = lambda value, fn: spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]
    assert f("https://u:p@h.org/a?q#f", text.public_locator) == "https://h.org/a" and f("/etc/x", text.public_locator) is None
    assert f("videos/chunk-000/cam/file-0.mp4", text.stream_of_path) == "cam" and f("a/b.mp4", text.stream_of_path) == "a" and f("b.mp4", text.stream_of_path) == "default"
    assert f("2024-05-01T12:00:00+02:00", text.utc_seconds) == "2024-05-01T10:00:00Z" and f("2024-05-01T12:00:00", text.utc_seconds) is None
    assert [f(x, text.relative_path_valid) for x in ("a/b", "/a", "a/../b", "a//b", "C:/a", "a\\b")] == [True, False, False, False, False, False]
    assert f("Bearer abc.def and hf_abcdefghij in /home/me/x", text.redacted) == "Bearer [redacted] and [redacted] in [private]/x"
    assert f("123456", lambda c: text.template_path("e_{i:03d}%", i=c.cast("long"))) == "e_123456%"
    assert f("observation.images.top", lambda c: c.rlike(text.glob_regex("observation.images.*"))) and not f("observationXimages", lambda c: c.rlike(text.glob_regex("observation.i*")))
    with pytest.raises(ValueError):
        text.template_path("{a}", b=F.lit(1))


def test_ranges_carry_over_what_came_before(spark):
    import random

    from pyspark.sql import Window

    from framewright.operators import keys

    r = random.Random(3)
    rows = [(None if r.random() < 0.02 else r.choice("aaaaaab"), r.randrange(500), k, None if r.random() < 0.05 else r.randrange(520)) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, start long, id long, finish long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for group in (["g"], []):
            w = Window.partitionBy(*group).orderBy("start", "finish", "id")
            past = w.rowsBetween(Window.unboundedPreceding, -1)
            want = df.withColumn("_seen", F.max("finish").over(past)).withColumn("_previous", F.lag("finish").over(w)).withColumn("_rank", (F.row_number().over(w) - 1).cast("long"))
            got = sequence._behind(df, group, ["start", "finish", "id"], "finish").select(want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            held = df.where("g IS NOT NULL")
            assert sorted(map(str, sequence.holes(held, group, "start").collect())) == sorted(map(str, keys.gaps(held.withColumn("one", F.lit(1)), group or ["one"], "start").drop("one").collect()))
            places = {x["place"] for x in sequence.sample_ends(df, ["start", "id"], group).collect()}
            n = [x[0] for x in df.groupBy(*group).count().select("count").collect()]
            assert places == {p for k in n for p in (0, (k - 1) // 2, k - 1)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
