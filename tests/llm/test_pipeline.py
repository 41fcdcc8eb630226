"""The pipeline over the smallest tables, stage by stage against plain versions."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from framewright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_stages_keep_columns_and_lose_only_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = {r["doc_id"] for r in out.collect()}
        assert after <= kept
        if name == "exact_dedup":
            best = {}
            for d in kept:
                key = "".join(c for c in rows[d] or "" if c not in " \t\n\x0b\x0c\r")
                best[key] = min(best.get(key, d), d, key=lambda x: (-len(rows[x] or ""), x))
            assert after == set(best.values())
        docs, kept = docs.where(docs["doc_id"].isin(sorted(after))), after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == kept
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept


def test_clean_documents_stay_in_the_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, SF).count() >= 0.99 * docs.count()


def test_dedup_stages_keep_one_row_of_equal_texts_whatever_their_ids(spark):
    words = [f"w{k}" for k in range(60)]
    near, far = " ".join(words), " ".join(reversed(words))
    rows = [(1, far), (1, far), (1, near), (2, near), (None, near + " end"), (None, "a b c"), (None, "a b c"), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(str, corpus_pipeline.exact(spark, docs, SF).collect()))
    assert kept == sorted(map(str, spark.createDataFrame([(1, far), (1, near), (None, near + " end"), (None, "a b c"), (3, "x y z")], docs.schema).collect()))
    kept = sorted(map(str, corpus_pipeline.near(spark, docs, SF).collect()))
    assert kept == sorted(map(str, spark.createDataFrame([(1, far), (1, near), (None, "a b c"), (3, "x y z")], docs.schema).collect()))


def test_every_query_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))


#: Names that the operators use inside.
CLASHING = "hash, check, cls, n, doc, d1, d2, seed, salt, block, kept, digest, place, stays, _row_key, _dropped_key, drops, label, rep"


def small_corpus(spark, tmp_path):
    """Documents with copies, near copies and benchmark items among them, odd bytes, nulls and columns of any name; and a folder with the benchmark."""
    from tests.llm.test_operators import words

    r = random.Random(31)
    items = [(k, " ".join(words(14, 400 + k))) for k in range(5)]
    texts: list[str | None] = [None, None, "", " \n", "x"]
    for k in range(40):
        w = words(r.randint(20, 60), 100 + k)
        if k % 4 == 0:
            w[5:5] = [x if r.random() > 0.1 else "zz" for x in r.choice(items)[1].split()]
        texts.append(" ".join(w))
        if k % 3 == 0:
            texts += [" ".join(w).replace(" ", "\n"), " ".join([*w[:-1], "end"]), " ".join(w)]
    texts.append(" ".join(words(5000, 9)))
    order = list(range(len(texts)))
    r.shuffle(order)
    columns = ["doc_id", "text", "lang", *CLASHING.split(", ")]
    rows = [(i, texts[i], "aa", *["q"] * (len(columns) - 3)) for i in order]
    schema = ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in columns)
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return spark.createDataFrame(rows, schema).repartition(3), texts, dict(items)


def test_stages_against_brute_force(spark, tmp_path):
    from tests.llm.test_operators import SPACE, brute_components, held_by, shingles

    docs, texts, items = small_corpus(spark, tmp_path)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    norm = [SPACE.sub("", t or "") for t in texts]
    stay = {min((k for k in range(len(texts)) if norm[k] == n), key=lambda k: (-len(texts[k] or ""), k)) for n in set(norm)}
    after = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert after.columns == docs.columns and ids(after) == stay
    left = sorted(stay)
    sets = [shingles(texts[k]) for k in left]
    component = brute_components(len(left), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    stay = {k for j, k in enumerate(left) if component[j] == j}
    docs = docs.where(docs["doc_id"].isin(left))
    after = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert after.columns == docs.columns and ids(after) == stay
    docs = docs.where(docs["doc_id"].isin(sorted(stay)))
    after = corpus_pipeline.clean_of_benchmark(spark, docs, str(tmp_path))
    assert after.columns == docs.columns and ids(after) == {k for k in stay if not any(held_by(texts[k] or "", t) for t in items.values())}
    assert 0 < after.count() < len(stay)


def test_stages_take_empty_tables_and_odd_bytes(spark, tmp_path):
    docs, texts, _ = small_corpus(spark, tmp_path)
    odd = docs.selectExpr("doc_id", "CAST(concat(CAST(text AS BINARY), unhex('ff')) AS STRING) AS text", *[f"`{c}`" for c in docs.columns[2:]])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        n = stage(spark, odd, str(tmp_path)).count()
        assert n == len(texts) if name == "byte_bpe" else 0 < n <= len(texts), name
