"""Each operator against brute force on small fixtures with nulls, empties, long texts, ties, repeats, clashing names and empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import uuid
from collections import defaultdict

import numpy as np
import pytest

from framewright.llm import op1_warc, op2_line_chunks, op3_html_text, op4_toxicity, op5_byte_bpe, op6_decontaminate, op7_language_id, op8_jaccard_join, op9_exact_dedup, op10_substring_dedup
from framewright.llm.common import chained, shared_dir, words_of
from framewright.llm.components import components

SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Extra columns whose names the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, hash long, doc long, label string, n int"


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7))) for _ in range(n)]


def fixture_texts() -> list[str | None]:
    r = random.Random(7)
    base = [" ".join(words(r.randint(5, 120), k)) for k in range(30)]
    out: list[str | None] = [None, "", " \n\t", None, "a", "a", "A b", "a  b\n"]
    for b in base:
        out.append(b)
        w = b.split()
        for _ in range(r.randint(0, 4)):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = "zz"
            out.append(" ".join(v))
        if r.random() < 0.4:
            out += [b, b.replace(" ", "\n"), b.upper()]
    out.append(" ".join(words(30_000, 99)))
    out.append("x" * 200_000)
    return out


def frame(spark, texts, ids=None, lang=None):
    ids = list(range(len(texts))) if ids is None else ids
    lang = lang or [None] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", 1, "d", 2, 3, "l", 4) for i, t, g in zip(ids, texts, lang, strict=True)], DOCS).repartition(5)


def brute_components(n: int, linked) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def shingles(text: str | None) -> frozenset:
    w = [x for x in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 4 else frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3))


def test_words_and_chains_do_not_depend_on_batches():
    texts = [b"one two  three", b"", b"\n", b"four one two"]
    h, e = words_of(texts)
    assert e.tolist() == [0, 3, 3, 3, 6]
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4
    assert chained(h, 2)[0] == chained(h, 2)[4]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (5, 5)], "a long, b long")
    got = {r["v"]: r["label"] for r in components(links).collect()}
    assert all(got[k] == 0 for k in range(41)) and {got[k] for k in (100, 101, 102)} == {100}


def test_warc_round_trip_with_magic_inside(spark):
    magic = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    html = [None, "", "<p>a</p>", "<p>a</p>", magic, "é" * 10, magic * 40, "", "a\r\n\r\nb", "WARC/1.1\r\nContent-Length: 1\r\n\r\n", "z" * 300_000]
    rows = [(k, None if k == 2 else f"http://e.org/{k}\r\nX: y", h, "f", 1) for k, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, at long").repartition(3)
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    op1_warc.write_archives(pages, path)
    got = {r["page_id"]: r for r in op1_warc.read_archives(spark, path, block=64).collect()}
    first = {}
    for k, h in enumerate(html):
        first.setdefault(h or "", k)
    assert len(got) == len(html)
    for k, h in enumerate(html):
        data, f = (h or "").encode(), first[h or ""]
        assert got[k]["payload_bytes"] == len(data)
        assert got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if f == k else ("revisit", f))


def test_warc_odd_rows_large_pages_and_a_cut_archive(spark, monkeypatch):
    monkeypatch.setattr(op1_warc, "RECORDS_PER_FILE", ((100, 2000), (1000, 3), (1 << 62, 1)))
    sizes = [5, 5, 99, 100, 500, 500, 999, 1000, 5000, 70_000]
    rows = [(None, None, "null page"), (None, "u", "null page"), (7, "u", "twice"), (7, "v", "twice"), (9, "u", "twice"), *((100 + k, "u", chr(97 + k) * n) for k, n in enumerate(sizes))]
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    op1_warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    found = op1_warc.read_archives(spark, path, block=256).collect()
    # a file system that gives whole files only gives the same
    monkeypatch.setattr(op1_warc, "by_range", lambda c: c.isNull())
    assert sorted(map(str, op1_warc.read_archives(spark, path, block=256).collect())) == sorted(map(str, found))
    monkeypatch.undo()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found)
    want = [("None", 9, "response", None)] * 2 + [("7", 5, "response", None)] * 2 + [("9", 5, "revisit", 7)] + [(str(100 + k), n, "response", None) for k, n in enumerate(sizes)]
    assert got == sorted(want, key=str)
    # an archive that is cut in its last record gives what stands before that
    whole = op1_warc.record(1, "u", 1, 3, "D", b"abc") + op1_warc.END
    cut = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    spark.createDataFrame([((whole * 2 + whole[:-5]).decode(),)], "value string").coalesce(1).write.option("lineSep", "x").text(cut)
    assert [r["at"] for r in op1_warc.read_archives(spark, cut).orderBy("at").collect()] == [0, len(whole)]


def test_warc_chain_exits_and_broken_chain():
    assert op1_warc.exits([(0, 10), (10, 20), (5, 7), (20, 40)], 30) == {0: 40, 10: 40, 20: 40, 5: -1}
    assert op1_warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n", 0) is None


def test_warc_heads_longer_than_a_read():
    url = "http://e.org/" + "x" * 20_000
    data = op1_warc.record(1, url, 1, 3, "D", b"abc") + op1_warc.END
    r = op1_warc.parse(data, 0)
    assert r["url"] == url and r["next"] == len(data)
    assert op1_warc.parse(data[:5000], 0) is None and op1_warc.parse(data[:-1], 0) is None
    source = op1_warc.Source(op1_warc.pa.BufferReader(b"HTTP/1.1 200 OK\r\nX: " + b"y" * 9000 + b"\r\n\r\nbody"))
    assert op1_warc.payload(source, 0, source.size, "response", None) == (4, op1_warc.sha1_base32(b"body"))


def test_warc_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    op1_warc.write_archives(empty, path)
    assert op1_warc.read_archives(spark, path).count() == 0


def test_line_chunks_against_brute_force(spark):
    r = random.Random(3)
    lines = [" ".join(words(4, k)) for k in range(60)]
    texts: list[str | None] = [None, "", "\n\n", "\n\n", *("\n".join(lines[(s := r.randrange(50)) : s + r.randrange(1, 12)] * r.randrange(1, 3)) for _ in range(60)), "\n".join(lines * 300)]
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in op2_line_chunks.drop_repeated_chunks(frame(spark, texts)).collect()}
    seen: set[bytes] = set()
    for d, t in enumerate(texts):
        chunks = op2_line_chunks.Chunks([(t or "").encode()])
        kept, removed, own = [], 0, set()
        for k in range(len(chunks.lines)):
            content, many = chunks.content(k), chunks.lines[k] >= op2_line_chunks.LEAST
            if many and (content in seen or content in own):
                removed += int(chunks.lines[k])
                continue
            own |= {content} if many else set()
            kept.append(content)
        seen |= own
        assert got[d] == (b"\n".join(kept).decode(), removed), d


def runs_of_lines_gone(texts):
    """Kept lines of each text, by comparing neighbouring lines themselves: what stood in an earlier text, or two lines earlier in its own, goes."""
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        pairs, first, gone = list(zip(lines, lines[1:], strict=False)), {}, set()
        for k, p in enumerate(pairs):
            if p in seen or k - first.setdefault(p, k) >= 2:
                gone |= {k, k + 1}
        seen |= set(pairs)
        out.append(([x for k, x in enumerate(lines) if k not in gone], len(gone)))
    return out


def test_repeated_runs_of_lines_against_brute_force(spark):
    r = random.Random(3)
    lines = [" ".join(words(4, k)) for k in range(60)]
    texts: list[str | None] = [None, "", "\n\n", "\n\n", "a\na\na\na", *("\n".join([f"own {k}", *lines[(s := r.randrange(50)) : s + r.randrange(1, 12)] * r.randrange(1, 3), f"end {k}"]) for k in range(60)), "\n".join(lines * 300)]
    got = {x["doc_id"]: (x["text"].split("\n"), x["n_removed"], x["n_lines"]) for x in op2_line_chunks.drop_repeated_runs(frame(spark, texts)).collect()}
    for d, (kept, n) in enumerate(runs_of_lines_gone(texts)):
        assert got[d] == (kept or [""], n, (texts[d] or "").count("\n") + 1), d
    passage = "\n".join(lines[:3])
    rows = [("x\n" + passage + "\ny", 2), ("z\n" + passage, 2), ("q\n" + passage + "\nw", None), (passage, 5)]
    got = sorted((x["doc_id"] or 99, x["text"]) for x in op2_line_chunks.drop_repeated_runs(frame(spark, *map(list, zip(*rows, strict=True)))).collect())
    assert got == [(2, rows[0][0]), (2, rows[1][0]), (5, ""), (99, "q\nw")]
    assert op2_line_chunks.drop_repeated_runs(frame(spark, [])).count() == 0


def test_chunk_boundaries_move_with_the_text():
    lines = [" ".join(words(4, k)).encode() for k in range(200)]
    of = lambda x: {c.content(k) for c in [op2_line_chunks.Chunks([b"\n".join(x)])] for k in range(len(c.lines))}
    a, b = of(lines), of([b"new line", *lines[:100], b"another", *lines[100:]])
    assert len(a & b) > 0.8 * len(a)
    assert max(op2_line_chunks.Chunks([b"\n".join([b"same"] * 100)]).lines) <= op2_line_chunks.MOST


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("<p>a<p>b", "a\nb"),
        ("<nav>menu</nav><article><h1>A &amp; B</h1><p>x&nbsp; y\n z</p><section class='comments'><p>no</p></section><aside>no</aside></article><footer>no</footer>", "A & B\nx y z"),
        ("<div class='sidebar'>no</div><div id='content'><p>Some longer text with many words in it.</p><p>More.</p></div><form>no</form><script>if(a<b){'</p>'}</script>", "Some longer text with many words in it.\nMore."),
        ("<article><p>cut <b>off", "cut off"),
        ("<article><header><h2>Title</h2></header><p>Body</p><div class='cookie-notice'>no</div><style>p{}</style></article>", "Title\nBody"),
    ],
)
def test_main_text(html, text):
    assert op3_html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<main><h1>T</h1><section><p>" + "long text " * 20 + "</p></section></main>", "T\n" + ("long text " * 20).strip()),
        ("<article><h1>T</h1><section><h2>A</h2><p>" + "first part " * 20 + "</p><section><h3>B</h3><p>short</p></section></section></article>", "T\nA\n" + ("first part " * 20).strip() + "\nB\nshort"),
        ("<main><h1>T</h1><section><p>" + "long text " * 20 + "</p></section><section><a href='/1'>one</a> <a href='/2'>two</a></section></main>", "T\n" + ("long text " * 20).strip()),
    ],
)
def test_sections_below_a_heading_belong_to_their_article(html, text):
    assert op3_html_text.main_text(html) == text


LONG = ("long text " * 20).strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><h1>T</h1><h2 id='related-work'>Related work</h2><p>{LONG}</p></article>", f"T\nRelated work\n{LONG}"),
        (f"<article><h1>T</h1><section id='privacy-and-security'><p>{LONG}</p></section><p class='ad-hoc'>{LONG}</p></article>", f"T\n{LONG}\n{LONG}"),
        (f"<div class='content-sidebar-wrap'><div class='has-sidebar'><main><p>{LONG}</p></main></div><div class='sidebar'>no</div></div><div>no</div>", LONG),
        (f"<div class='no-ads-wrap'><article><p>{LONG}</p></article></div>", LONG),
        (f"<article><p>{LONG}</p></article><div class='comments-area'><article>no no no</article></div>", LONG),
        (f"<div hidden><main>no</main></div><div class='widget-page'><p>{LONG}</p></div>", LONG),
    ],
)
def test_compound_names_leave_the_main_text(html, text):
    assert op3_html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p class='notice'>x<p>text<p>text</article>", "text\ntext"),
        ("<article><ul><li class='ad'>x<li>text<li class='ad'><p>x<li>more</ul></article>", "text\nmore"),
        ("<article><table><tr class='ad'><td>x<tr><td>text</table></article>", "text"),
        ("<article><p>text <button><div>x</div>y</button> more</p></article>", "text\nmore"),
        ("<article><p class='ad'>x<nav><p>y<p>z</nav><p>text</article>", "text"),
    ],
)
def test_implied_end_tags_end_a_dropped_element(html, text):
    assert op3_html_text.main_text(html) == text


def test_extract_text_edges(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<article><p>" + "w " * 50_000 + "</p></article>", "x"), (3, "u", "<p>é</p>", "x")]
    got = sorted((r["page_id"], r["n_chars"], r["url"]) for r in op3_html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [(1, 0, None), (2, 0, "u"), (3, 1, "u"), (3, 99_999, "u")]
    assert op3_html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def toxic_corpus(n: int):
    r = random.Random(5)
    vocabulary = words(400, 1)
    texts, labels = [], []
    for k in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(10, 60))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(["grobbelnix", "vilewretch", "stinkomat"]) + r.choice(["", "s", "er"])
        texts.append(" ".join(w))
        labels.append((k, int(toxic)))
    return texts, labels


def test_toxicity_held_out_accuracy(spark):
    texts, labels = toxic_corpus(600)
    docs = frame(spark, [*texts, None, "", "x" * 100_000], [*range(600), 600, 601, 601])
    marked = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = op4_toxicity.train(docs, marked.where("doc_id IS NULL OR doc_id < 400"))
    got = defaultdict(list)
    for r in op4_toxicity.toxicity(docs, model).collect():
        got[r["doc_id"]].append((r["score"], r["predicted"]))
    wrong = sum(got[k][0][1] != t for k, t in labels if k >= 400)
    assert wrong <= 6
    assert got[600][0][1] == 0 and all(0 <= s <= 1 for v in got.values() for s, _ in v) and len(got[601]) == 2
    assert op4_toxicity.toxicity(docs, op4_toxicity.train(docs, marked.where("toxic = 1"))).agg({"score": "max"}).first()[0] == 0


def test_toxicity_keeps_words_that_an_ordinary_text_quotes(spark):
    texts, labels = toxic_corpus(600)
    quoted = [a + b for a in ("grobbelnix", "vilewretch", "stinkomat") for b in ("", "s", "er")]
    for k, word in zip([k for k, t in labels if not t], quoted, strict=False):
        texts[k] += " " + word
    docs = frame(spark, texts)
    model = op4_toxicity.train(docs, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in op4_toxicity.toxicity(docs, model).collect()}
    assert sum(got[k] != t for k, t in labels if k >= 400) <= 6


def bpe():
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def test_bpe_equals_the_rank_encoder_and_decodes(spark):
    import tiktoken

    path, pattern = bpe()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = [None, "", "é一😀 don't  \n\n x<|endoftext|>", "a" * 20_000, " " * 5000, "՘࢏1\U000323b0", *("".join(chr(r.choice([r.randrange(32, 0x500), r.randrange(0x2000, 0xD7FF), r.randrange(0x10000, 0x20000)])) for _ in range(40)) for _ in range(200))]
    got = {x["doc_id"]: x for x in op5_byte_bpe.round_trip(frame(spark, texts), path, pattern).collect()}
    for k, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(ids) and got[k]["exact"]
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_offsets_are_bytes():
    tool = op5_byte_bpe.encoder(*bpe())
    text = "Thé 一😀 x"
    out = tool.encode_offsets(text)
    assert out[0][1] == 0 and out[-1][2] == len(text.encode()) and all(a[2] == b[1] for a, b in zip(out, out[1:], strict=False))
    assert tool.decode(np.array([i for i, _, _ in out], np.int32).tobytes()) == text.encode()


def test_decontamination_tolerates_substitutions(spark):
    r = random.Random(2)
    items = [(k, " ".join(words(r.randint(12, 40), 1000 + k))) for k in range(30)] + [(30, None), (31, ""), (32, "tiny one here"), (3, " ".join(words(20, 1003)))]
    texts, expected = [None, "", "x " * 30_000], [False, False, False]
    for k in range(120):
        w = words(60, 5000 + k)
        if k % 2:
            own = (items[k % 30][1] or "").split()
            own[len(own) // 2] = "changed"
            w[20:20] = own
        texts.append(" ".join(w))
        expected.append(bool(k % 2))
    texts.append("a TINY one\nhere b")
    expected.append(True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    got = {x["doc_id"]: x for x in op6_decontaminate.contamination(docs, bench).collect()}
    assert [got[k]["contaminated"] for k in range(len(texts))] == expected
    assert got[4]["item_id"] == 1 and 0.5 <= got[4]["overlap"] < 1
    assert op6_decontaminate.without_contaminated(docs, bench).count() == expected.count(False)
    assert op6_decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def held_by(text: str, item: str) -> float:
    """The best overlap of an item over all ways to lay it over a text that share a seed, by comparing words; 0 if none holds."""
    w, own = text.lower().split(), item.lower().split()
    best, n = 0.0, len(own)
    for lies in range(-n + 1, len(w)):
        same = [0 <= lies + k < len(w) and w[lies + k] == own[k] for k in range(n)]
        masks = [m for m in op6_decontaminate.MASKS if len(m) <= n] if n >= 8 else ["1" * n]
        if not any(all(same[o + k] for k, c in enumerate(m) if c == "1") and 0 <= lies + o and lies + o + len(m) <= len(w) for m in masks for o in range(n - len(m) + 1)):
            continue
        score = start = 0
        stretches = []
        low, high = max(0, -lies), min(n, len(w) - lies)
        for start in range(low, high):
            score = 0
            for end in range(start, high):
                score += 1 if same[end] else -1
                stretches.append((score, start, -end, sum(same[start : end + 1])))
        top = max(s[0] for s in stretches)
        matches = max(s[3] for s in stretches if s[0] == top)
        if matches >= min(8, n) and 2 * matches >= n:
            best = max(best, matches / n)
    return best


def test_decontamination_against_brute_force(spark):
    r = random.Random(21)
    items = [(k, " ".join(words(r.randint(1, 22), 700 + k))) for k in range(14)]
    texts = []
    for k in range(60):
        w = words(r.randint(5, 30), 9000 + k)
        for _ in range(r.randint(0, 2)):
            own = r.choice(items)[1].split()
            own = [x if r.random() > 0.15 else "zz" for x in own[r.randrange(3) :]]
            at = r.randrange(len(w))
            w[at:at] = own
        texts.append(" ".join(w))
    got = {x["doc_id"]: x for x in op6_decontaminate.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, t in enumerate(texts):
        held = {i: held_by(t, item) for i, item in items}
        n = sum(x > 0 for x in held.values())
        assert (got[k]["n_items"], got[k]["contaminated"]) == (n, n > 0), k
        assert n == 0 or abs(got[k]["overlap"] - max(held.values())) < 1e-9 and held[got[k]["item_id"]] == max(held.values())


def test_decontamination_rows_blocks_and_clashing_names(spark, monkeypatch):
    bench = spark.createDataFrame([*((k, " ".join(words(20, 1000 + k))) for k in range(20)), (None, " ".join(words(20, 1001)))], "item_id long, text string")
    texts = [" ".join(words(9, k) + (words(20, 1000 + k) + words(20, 1001 + k) if k % 2 else [])) for k in range(15)]
    docs = frame(spark, [*texts, texts[1], None], [None if k % 3 == 0 else k // 4 for k in range(17)]).withColumnRenamed("hash", "d1").withColumnRenamed("doc", "_d1").withColumnRenamed("n", "salt")
    rows = lambda: sorted(map(str, op6_decontaminate.contamination(docs, bench).collect()))
    whole = rows()
    assert len(whole) == 17 and sum("contaminated=True" in x for x in whole) == 8
    left = op6_decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 9
    monkeypatch.setattr(op6_decontaminate, "BLOCK", 1)
    monkeypatch.setattr(op6_decontaminate, "REMEMBERED", 0)
    assert rows() == whole


def test_decontamination_of_repetitive_texts():
    import tracemalloc

    text = op6_decontaminate.Text(b"word " * 40_000)
    own = words_of([b"word " * 400])[0]
    tracemalloc.start()
    assert text.held(own, 0.5, 8) == (1.0, 0, 399)
    other = words_of([b"word " * 399 + b"end"])[0]
    assert text.held(other, 0.5, 8) == (399 / 400, 0, 398)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_language_held_out_accuracy_and_edges(spark):
    r = random.Random(4)
    alphabets = {"aa": "abcdeaeiou", "bb": "vwxyzaeiou", "cc": "абвгдежзик"}
    texts, lang = [], []
    for _ in range(300):
        g = r.choice(sorted(alphabets))
        texts.append(" ".join("".join(r.choice(alphabets[g]) for _ in range(r.randint(2, 8))) for _ in range(r.randint(3, 60))))
        lang.append(g)
    texts += [None, "", "123 !?", "漢字仮名交じり文" * 20]
    lang += ["aa", "aa", None, None]
    docs = frame(spark, texts, None, lang)
    model, seen = op7_language_id.train(docs.where("doc_id % 3 <> 0"), 1000)
    assert sorted(seen) == ["aa", "bb", "cc"]
    got = {x["doc_id"]: x for x in op7_language_id.identify(docs, model).collect()}
    assert sum(got[k]["lang_pred"] != lang[k] for k in range(300) if k % 3 == 0) <= 2
    assert not any(got[k]["rejected"] for k in range(300))
    assert [got[k]["lang_pred"] for k in (300, 301, 302)] == ["und"] * 3 and all(got[k]["score"] == 0 for k in (300, 301, 302))
    assert got[303]["rejected"] and got[303]["lang_pred"] in seen
    assert op7_language_id.without_rejected(docs, model).count() == 300
    none, _ = op7_language_id.train(docs.limit(0))
    assert {x["lang_pred"] for x in op7_language_id.identify(docs, none).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    texts = ["abracadabra banana", "cab bad bab"]
    grams, n = np.unique(op7_language_id.codes(*op7_language_id.symbols(texts)), return_counts=True)
    model = op7_language_id.build_model(["x"], np.zeros(len(grams), int), grams, n)
    letters = np.unique(op7_language_id.symbols(texts)[0]).astype(np.uint64)
    for context in (0x061062072061, 0x020020020020):
        gram = (np.uint64(context) << np.uint64(12)) | letters
        total = float(np.exp(model.look(gram).astype(float)).sum())
        assert 0.8 < total <= 1.0001  # the rest is for unseen symbols


def test_jaccard_components_against_brute_force(spark):
    texts = fixture_texts()
    sets = [shingles(t) for t in texts]
    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    want = brute_components(len(texts), linked)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in op8_jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in range(len(texts))}


def test_jaccard_many_variants_of_one_text(spark):
    r = random.Random(11)
    base = words(70, 1)
    texts = [" ".join(base)]
    for _ in range(150):
        v = list(base)
        for _ in range(r.randint(0, 3)):
            v[r.randrange(len(v))] = r.choice("pqrs") * 3
        texts.append(" ".join(v))
    sets = [shingles(t) for t in texts]
    want = brute_components(len(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {x["doc_id"]: x["component_id"] for x in op8_jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_jaccard_repeated_rows_and_empty_table(spark):
    docs = frame(spark, ["a b c d e", "a b c d e", "q r s t u", None], [4, 4, 9, None])
    got = sorted((x["doc_id"] is None, x["doc_id"], x["n_shingles"], x["component_id"]) for x in op8_jaccard_join.jaccard_components(docs).collect())
    assert got == [(False, 4, 2, 4), (False, 4, 2, 4), (False, 9, 2, 9), (True, None, 0, None)]
    assert op8_jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_divide_skip_equals_counting():
    r = np.random.default_rng(1)
    for _ in range(200):
        query = np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64))
        sets = [np.unique(np.concatenate([r.choice(query, r.integers(0, len(query) + 1)), r.integers(0, 60, r.integers(1, 12)).astype(np.uint64)])) for _ in range(9)]
        want = [100 * len(np.intersect1d(query, s)) >= 85 * len(np.union1d(query, s)) for s in sets]
        assert op8_jaccard_join.divide_skip(query, sets).tolist() == want


def test_exact_dedup_against_brute_force(spark):
    texts = [*fixture_texts(), "a b", "ab", " a b ", "é b", "éb", " ", None]
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[SPACE.sub("", t or "")].append(k)
    got = {x["doc_id"]: x for x in op9_exact_dedup.exact_dedup(frame(spark, texts), salts=3).collect()}
    for norm, members in groups.items():
        keep = min(members, key=lambda k: (-len(texts[k] or ""), k))
        for k in members:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) == (keep, len(members), k == keep)
            assert bytes(got[k]["digest"]) == hashlib.sha256(norm.encode()).digest()


def test_exact_dedup_repeats_nulls_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(op9_exact_dedup, "HELD_BYTES", 1)
    docs = frame(spark, ["x", "x", " x", "y", "y", "z"], [3, 3, -7, None, 5, None])
    got = sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in op9_exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(3, -7, 3, False), (3, -7, 3, False), (-7, -7, 3, True), (None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True)], key=str)
    assert op9_exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(9)
    sentences = [" ".join(words(r.randint(4, 14), k)) + "." for k in range(80)]
    texts: list[str | None] = [None, "", "\n"]
    for _ in range(60):
        s = r.randrange(70)
        texts.append(" ".join([" ".join(words(5, r.randrange(10**6))) + ".", *sentences[s : s + r.randrange(1, 10)], "Tail " + str(r.randrange(10**6)) + "."]))
    texts.append(" ".join(words(70, 4)))  # one sentence of 70 words
    texts.append("Before it. " + " ".join(words(70, 4)) + " and after")
    got = {x["doc_id"]: x for x in op10_substring_dedup.drop_repeated_spans(frame(spark, texts)).collect()}
    seen: set[tuple[int, int]] = set()
    for d, t in enumerate(texts):
        runs = op10_substring_dedup.Runs([(t or "").encode()])
        drop = np.array([h in seen for h in zip(runs.hash.tolist(), runs.check.tolist(), strict=True)], bool) | ~runs.first_in_text()
        gone = runs.covered(drop)
        seen |= set(zip(runs.hash.tolist(), runs.check.tolist(), strict=True))
        assert got[d]["n_removed"] == int(gone.sum()) and got[d]["text"] == runs.without(gone, 0).decode(), d
    assert got[len(texts) - 1]["n_removed"] > 0


def sentences_gone(texts, run=2, least=20):
    """For each text, a list of sentences, which of them lie in a run of enough sentences and words that an earlier text holds."""
    seen, out = set(), []
    for t in texts:
        runs = [(i, j) for i in range(len(t)) for j in range(i + run, len(t) + 1) if sum(len(x.split()) for x in t[i:j]) >= least]
        out.append({k for i, j in runs if tuple(t[i:j]) in seen for k in range(i, j)})
        seen |= {tuple(t[i:j]) for i, j in runs}
    return out


def test_substring_dedup_covers_every_sentence_of_a_passage(spark):
    r = random.Random(12)
    sentences = [" ".join(words(r.randint(2, 14), 300 + k)) + "." for k in range(60)]
    own = lambda: " ".join(words(r.randint(2, 14), r.randrange(10**6, 10**9))) + "."
    texts = [[own(), *sentences[(s := r.randrange(50)) : s + r.randrange(1, 10)], own(), own()] for _ in range(80)]
    got = {x["doc_id"]: x["text"] for x in op10_substring_dedup.drop_repeated_spans(frame(spark, [" ".join(t) for t in texts])).collect()}
    for d, gone in enumerate(sentences_gone(texts)):
        assert got[d] == " ".join(x for k, x in enumerate(texts[d]) if k not in gone), d


def test_substring_dedup_keeps_unique_text_and_rows_of_one_document(spark):
    text = "  First of all.  Then " + " ".join(words(40, 1)) + ".\n End "
    docs = frame(spark, [text, text, "Other. " + text], [1, 1, 2])
    got = sorted((x["doc_id"], x["text"]) for x in op10_substring_dedup.drop_repeated_spans(docs).collect())
    assert got[0] == got[1] == (1, text) and len(got[2][1]) < len(text)
    assert op10_substring_dedup.drop_repeated_spans(docs.limit(0)).count() == 0


def thue_morse(n: int) -> tuple[str, str]:
    """A word and its complement, which every polynomial hash modulo a power of two confuses."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_structured_words_and_lines_stay_apart(spark):
    x, y = thue_morse(1024)
    docs = frame(spark, [x, y])
    assert sorted(r["component_id"] for r in op8_jaccard_join.jaccard_components(docs).collect()) == [0, 1]
    docs = frame(spark, [f"{x}\n{x}", f"{x}\n{x}", f"{y}\n{y}"])
    for drop in (op2_line_chunks.drop_repeated_runs, op2_line_chunks.drop_repeated_chunks):
        assert {r["doc_id"]: r["n_removed"] for r in drop(docs).collect()} == {0: 0, 1: 2, 2: 0}
    texts = [f"{x} a. {x} b.", f"{y} a. {y} b."]
    assert [r["n_removed"] for r in op10_substring_dedup.drop_repeated_spans(frame(spark, texts)).collect()] == [0, 0]


def test_short_texts_that_repeat_go_whole(spark):
    got = {r["doc_id"]: r["text"] for r in op10_substring_dedup.drop_repeated_spans(frame(spark, ["Thank you.", "THANK  you.", "Thank you. Bye.", "Thank you. Bye."])).collect()}
    assert got == {0: "Thank you.", 1: "", 2: "Thank you. Bye.", 3: ""}


def test_bytes_that_are_no_utf8(spark):
    docs = frame(spark, ["6162ff63", "6162FF6320", "e9", "c3a9"]).selectExpr("doc_id", "CAST(unhex(text) AS STRING) AS text")
    exact = {r["doc_id"]: (r["keep_id"], r["n_chars"]) for r in op9_exact_dedup.exact_dedup(docs).collect()}
    assert exact == {0: (1, 4), 1: (1, 5), 2: (2, 1), 3: (3, 1)}
    assert {r["doc_id"]: r["component_id"] for r in op8_jaccard_join.jaccard_components(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r["doc_id"]: r["text"] for r in op10_substring_dedup.drop_repeated_spans(docs).collect()} == {0: "ab�c", 1: "", 2: "�", 3: "é"}
    assert [r["text"] for r in op2_line_chunks.drop_repeated_runs(docs).orderBy("doc_id").collect()] == ["ab�c", "ab�c ", "�", "é"]
    path, pattern = bpe()
    assert [r["exact"] for r in op5_byte_bpe.round_trip(docs, path, pattern).collect()] == [True] * 4
    assert op7_language_id.identify(docs, None).count() == op4_toxicity.toxicity(docs, op4_toxicity.Model()).count() == 4


def test_one_row_of_equal_texts_is_kept(spark):
    rows = [("a b", 1), ("ab", 1), ("ab", 2), ("same text", 5), ("same text", 5), ("x", None), ("x", None)]
    for hot in (100, 0):
        op9_exact_dedup.HOT_ROWS, before = hot, op9_exact_dedup.HOT_ROWS
        try:
            found = op9_exact_dedup.exact_dedup(frame(spark, *map(list, zip(*rows, strict=True)))).collect()
        finally:
            op9_exact_dedup.HOT_ROWS = before
        kept = sorted(((r["doc_id"], r["n_chars"], r["group_size"]) for r in found if r["kept"]), key=str)
        assert kept == sorted([(1, 3, 3), (5, 9, 2), (None, 1, 2)], key=str) and len(found) == len(rows)


def test_language_of_a_text_does_not_depend_on_its_neighbours():
    texts = ["abc, déf!", "", "123 - x", "über uns", " .a", "z" * 50, "!?"]
    alone = [op7_language_id.codes(*op7_language_id.symbols([t])).tolist() for t in texts]
    assert op7_language_id.codes(*op7_language_id.symbols(texts)).tolist() == [c for a in alone for c in a]
    sym, edges = op7_language_id.symbols(texts)
    grams, n = np.unique(op7_language_id.codes(sym, edges), return_counts=True)
    model = op7_language_id.build_model(["x", "y"], np.arange(len(grams)) % 2, grams, n)
    together, back = model.means(texts)[0], model.means(texts[::-1])[0]
    assert (together == back[::-1]).all()
    assert all((together[k] == model.means([t])[0][0]).all() for k, t in enumerate(texts))


NAV = "".join(f"<div><span>entry {k}</span> <b>go</b></div>" for k in range(12))
PARAGRAPHS = [("long words of a story " * 12).strip() + f" {k}" for k in range(6)]
STORY = "<div><h2>Head</h2>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "<p>Short end.</p></div>"
STORY_TEXT = "\n".join(["Head", *PARAGRAPHS, "Short end."])


@pytest.mark.parametrize("name", ["content has-sidebar", "post comments-open", "main-content with-ads", "related-work", "social-science"])
def test_pages_without_article_give_their_text(name):
    page = f"<body><h1>Title</h1><div>{NAV}</div><div class='{name}'>{STORY}</div><div class='footer'>no</div><div>{NAV}</div></body>"
    assert op3_html_text.main_text(page) == f"Title\n{STORY_TEXT}"
    assert op3_html_text.main_text(f"<body><form id='f'><input>{page}</form></body>") == f"Title\n{STORY_TEXT}"


def test_clustering_decides_where_no_element_does(monkeypatch):
    # entries outweigh the story together, but their ratio of text to tags is low
    many = NAV * 16
    page = f"<div><div>{many}</div>{STORY}</div>"
    assert op3_html_text.main_text(page) == STORY_TEXT
    monkeypatch.setattr(op3_html_text, "two_means", lambda values: -1.0)
    assert op3_html_text.main_text(page) != STORY_TEXT


@pytest.mark.parametrize(
    "unit",
    ['<a b="', "<a ", "<!--", "</", "<!", "<?x", "<div class=x>", "<b>", "<main>", "<a b='\"", "<button>", "<![CDATA[", "<script>", "<p><i><p>", "<div class=ads-x><main>", "&lt", "<form>x", '<a b="x" c=\'y" '],
)
def test_reading_takes_time_in_proportion(unit):
    import time

    began = time.time()
    op3_html_text.main_text(unit * (1_000_000 // len(unit)))
    op3_html_text.main_text(unit * (300_000 // len(unit)) + "</i><p></p>" * 50_000)
    assert time.time() - began < 60


def test_what_never_ends_is_text():
    assert op3_html_text.calm("<p class='x'>a <b c=\"d>e</b> f") == "<p class='x'>a &lt;b c=\"d>e</b> f"
    assert op3_html_text.calm("<script>a<b='</script><p>x") == "<script>a<b='</script><p>x"
    assert op3_html_text.calm("<!-- a < b --><p>1 < 2 <!-- c") == "<!-- a < b --><p>1 < 2 &lt;!-- c"
    for page in ("", "<p>x", "<a href='x'>y</a>", "<!DOCTYPE html><p>a", "<p>1 < 2</p>"):
        assert op3_html_text.calm(page) == page


def test_spread_join_equals_a_join(spark, monkeypatch):
    from framewright.llm import common

    r = random.Random(8)
    rows = spark.createDataFrame([(None if k % 50 == 0 else r.choice([1, 1, 1, 2, 3, 4]), k) for k in range(400)], "key long, row long")
    of_key = rows.where("key < 4").groupBy("key").count().selectExpr("key", "key * 10 AS value", "count AS n")
    want = sorted(map(tuple, rows.join(of_key.drop("n"), "key").select("key", "row", "value").collect()))
    for hot, keys in ((100, 1000), (0, 3), (10**6, 1000)):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        got = common.spread_join(rows, of_key, ["key"], "row")
        assert got.columns == ["key", "row", "value"] and sorted(map(tuple, got.collect())) == want
    assert common.spread_join(rows, of_key.limit(0), ["key"], "row").count() == 0


def test_filters_err_towards_yes(spark):
    from framewright.llm import common

    ids = spark.createDataFrame([(k, k * 7) for k in range(-50, 1000)], "a long, b long")
    one, two = common.filter_of(ids.select("a")), common.filter_of(ids)
    a = np.arange(-50, 1000)
    assert common.maybe(one, a).all() and common.maybe(two, common.paired(a, a * 7)).all()
    assert common.maybe(one, np.arange(10_000, 20_000)).mean() < 0.2
    docs = spark.createDataFrame([(5, "in"), (None, "null"), (10**9, "out")], "doc_id long, text string")
    split = [sorted(str(r["text"]) for r in docs.mapInArrow(common.by_filter(one, k), docs.schema).collect()) for k in (True, False)]
    assert "in" in split[0] and sorted(split[0] + split[1]) == ["in", "null", "out"]


def test_workers_give_back_what_another_operator_kept():
    from framewright.llm import common

    path, pattern = bpe()
    rows = common.pa.record_batch([common.pa.array([1]), common.pa.array(["a b"])], names=["doc_id", "text"])
    code = common.lean(lambda batches: ([op5_byte_bpe.encoder(path, pattern).encode(t) for b in batches for t in b.column(1).to_pylist()], None)[1:])
    code.__closure__[0].cell_contents.__module__ = op5_byte_bpe.__name__
    list(code(iter([rows])))
    assert op5_byte_bpe._encoders
    list(code(iter([rows])))
    assert op5_byte_bpe._encoders
    list(common.lean(lambda batches: batches)(iter([rows])))
    assert not op5_byte_bpe._encoders
