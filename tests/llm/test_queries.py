"""The registered queries over the smallest tables: columns, one row per input row, SQL where there is some, brute force where there is none."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib

import pytest

from framewright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")

COLUMNS = {
    "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op3_html_text": ["page_id", "url", "text", "n_chars"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: q(spark, SF).toPandas() for name, q in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "pages")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_shape(results, tables, name):
    table = "pages" if name in ("op1_warc", "op3_html_text") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    assert list(results[name].columns)[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    assert sorted(results[name][key]) == sorted(tables[table][key])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(results, tables, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = ", ".join(results[name].columns)
    # pandas holds longs with nulls as floats
    whole = lambda x: None if x != x else int(x) if isinstance(x, float) else x
    want = sorted(map(repr, con.sql(f"SELECT {columns} FROM ({queries.SQL[name]})").fetchall()))
    assert sorted(repr(tuple(map(whole, r))) for r in results[name].itertuples(index=False)) == want


def test_warc(results, tables):
    first: dict[bytes, int] = {}
    pages = {p: (h or "").encode() for p, h in zip(tables["pages"]["page_id"], tables["pages"]["html"], strict=True)}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    for r in results["op1_warc"].itertuples():
        data = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.record_type == ("response" if first[data] == r.page_id else "revisit")


def test_held_out_rows(results):
    for name, n, k in (("op4_toxicity", 5, 0), ("op7_language_id", 4, 2)):
        for r in results[name].itertuples():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k)
            assert 0 <= r.score <= 1


def test_round_trip(results, tables):
    texts = dict(zip(tables["documents"]["doc_id"], tables["documents"]["text"], strict=True))
    for r in results["op5_byte_bpe"].itertuples():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_removals_leave_other_texts_alone(results, tables):
    texts = dict(zip(tables["documents"]["doc_id"], tables["documents"]["text"], strict=True))
    for name in ("op2_line_chunks", "op10_substring_dedup"):
        for r in results[name].itertuples():
            if r.n_removed == 0:
                assert r.text == (texts[r.doc_id] or "")
            else:
                assert len(r.text) < len(texts[r.doc_id])
