"""WARC archives: writing, and reading back by boundary-chain verification.

Writing: one record per page, `response` for the smallest page_id of each payload, `revisit` for the others. A payload that no other
row has is written where it is read; the others meet the group's smallest page_id in a join. Of
rows with one payload that a task sees, only the one with the smallest page_id carries the payload into the join
so that a payload which a third of all pages share moves once per task. Spark's text
writer puts the records down with CR LF CR LF as line separator, which is the end of a WARC record; so
any file system that Spark writes to will do.

Reading: each task reads one byte range of an archive, scans it for the magic and emits a candidate for each place that parses as a record
head, with the offset that its Content-Length says the next record has. Magic inside a payload makes false
candidates. Within a range the task follows each candidate to the first offset behind the range; pointer
jumping from offset 0 over those exits, which doubles the distance each round, finds the entries of all ranges, and a walk inside
each range from its entry keeps the records that are reachable from the file's start. Only their payloads are read again, block by block, for their
digests. File systems that Arrow cannot open by range give archives whole, to one task each.

A null payload is empty; empty payloads form a group like any other. A null page_id or URL is written as such and read back
as null. Rows that repeat page_id and payload are all written, and those with the group's smallest page_id are all
responses. Empty tables give no archives and an empty result. A record that breaks the chain (truncated file) ends it: what stands before it is kept.
Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import as_bytes, filter_of, lean, maybe, shared_dir, stash, table
from framewright.sources.files import by_range, opened

END = b"\r\n\r\n"
#: Records of one archive at most by the bytes of a payload (below the first number), so that an archive, which Spark reads as one row, stays
#: within about 512 MB, or is one record; and the bytes of a range.
RECORDS_PER_FILE, RANGE = ((1 << 18, 2000), (1 << 24, 32), (1 << 62, 1)), 1 << 23
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2000-01-01T00:00:00Z"

PAYLOAD = "page_id long, url string, n long, digest string, check long, packed binary"
CANDIDATE = "file string, block int, at long, next long, exit long, start long, end long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, stated string"
#: Bytes that are read of a head at first.
HEAD = 2048


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _checks(texts: list[bytes]) -> np.ndarray:
    """64 bits of another family than the digest, which go with it wherever payloads meet."""
    return np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in texts]), np.int64)


def _payloads(shared):
    """Of the rows whose payload may be repeated: digests of every row, and the compressed payload unless the task has seen it with a smaller page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=6).compress
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            every = as_bytes(batch.column(2))
            rows = np.flatnonzero(maybe(shared, _checks(every))) if every else np.empty(0, np.int64)
            batch, texts = batch.take(pa.array(rows)), [every[k] for k in rows.tolist()]
            ids, checks, digests = batch.column(0).to_pylist(), _checks(texts).tolist(), list(map(sha1_base32, texts))
            names = list(zip(digests, checks, strict=True))
            carried = []
            least: dict[tuple[str, int], int] = {}
            for i, c in zip(ids, names, strict=True):
                if i is not None:
                    least[c] = min(i, least.get(c, i))
            for i, c, t in zip(ids, names, texts, strict=True):
                best = min((x for x in (least.get(c), seen.get(c)) if x is not None), default=None)
                carried.append(pack(t) if i == best else None)
            for c, i in least.items():
                seen[c] = min(i, seen.get(c, i))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string()), pa.array(checks, pa.int64()), pa.array(carried, pa.binary())],
                names=[x.split()[0] for x in PAYLOAD.split(", ")],
            )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each payload of a batch, with its smallest page_id and its number of rows."""
    for batch in batches:
        found: dict[bytes, list] = {}
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            own = found.setdefault(t, [i, 0])
            own[1] += 1
            if i is not None and (own[0] is None or i < own[0]):
                own[0] = i
        texts = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([sha1_base32(t) for t in texts], pa.string()), pa.array(_checks(texts)), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
            names=["digest", "check", "page_id", "n"],
        )


def _alone(shared):
    """The records of the rows whose payload no other row has, where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            rows = np.flatnonzero(~maybe(shared, _checks(texts))).tolist() if texts else []
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([record(ids[k], urls[k], ids[k], len(texts[k]), sha1_base32(texts[k]), texts[k]) for k in rows], pa.binary())], names=["value"])

    return run


def _named(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else str(page_id).encode())


def record(page_id: int | None, url: str | None, first: int | None, n: int, digest: str, payload: bytes) -> bytes:
    """A WARC record without its closing CR LF CR LF; a revisit if `first` is another page."""
    revisit = page_id != first
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + (b"" if revisit else payload)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _named(page_id), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\r\n]+", b" ", url.encode("utf-8", "surrogatepass")))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if revisit:
        head += [b"WARC-Refers-To: " + _named(first), b"WARC-Profile: " + PROFILE]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + END + block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([record(i, u, f, n, d, unpack(p) if p is not None and i == f else b"") for i, u, f, n, d, p in rows], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row of `pages` into WARC files below `path`."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    largest = base.agg(F.coalesce(F.max(size), F.lit(0))).first()[0]
    low = 0
    for high, records in RECORDS_PER_FILE:  # equal payloads are of one size, so groups stay together
        if low <= largest:
            _write(base.where((size >= low) & (size < high)) if low or largest >= high else base, f"{path}/below-{high}", records)
        low = high


def _write(base: DataFrame, path: str, records: int) -> None:
    found = base.select("page_id", "html").mapInArrow(lean(_digests), "digest string, check long, page_id long, n long")
    repeated = found.groupBy("digest", "check").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("n")).where("n > 1").drop("n")
    repeated = stash(repeated.withColumn("known", F.lit(True)), "repeated-payloads")
    shared = filter_of(repeated.select("check"))
    # a row that the filter took for a repeated one is its own first
    rows = base.mapInArrow(lean(_payloads(shared)), PAYLOAD).join(repeated, ["digest", "check"], "left")
    first = F.when(F.col("known"), F.col("first_id")).otherwise(F.col("page_id")).alias("first_id")
    lines = rows.select("page_id", "url", first, "n", "digest", "packed").mapInArrow(lean(_records), "value binary")
    lines = base.mapInArrow(lean(_alone(shared)), "value binary").unionByName(lines)
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", records).text(path)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")
_PAGE = re.compile(rb"<urn:page:(-?\d+|null)>")


def _page(value: bytes | None) -> int | None:
    m = _PAGE.fullmatch(value or b"")
    return None if m is None or m[1] == b"null" else int(m[1])


class Source:
    """An open archive read by ranges; what was read last is kept."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.low, self.kept = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from `at`, fewer at the end."""
        if not (self.low <= at and at + n <= self.low + len(self.kept)):
            self.file.seek(at)
            self.low, self.kept = at, self.file.read(max(0, min(n, self.size - at)))
        return self.kept[at - self.low : at - self.low + n]


def parse(source: Source | bytes, at: int) -> dict | None:
    """The record that begins at `at`, or None if no record head stands there; `next` is where its successor should begin, start and end are those of its block."""
    if isinstance(source, bytes):
        source = Source(pa.BufferReader(source))
    n = HEAD
    while True:
        data = source.read(at, n)
        m = MAGIC.match(data)
        if m is None:
            return None
        head, pos = {}, m.end()
        while (f := _FIELD.match(data, pos)) is not None:
            head[f[1].lower()] = f[2].strip()
            pos = f.end()
        if data[pos : pos + 2] == b"\r\n":
            break
        if b"\r\n" in data[pos:] or len(data) < n:
            return None
        n *= 4  # the head goes on behind what was read
    length = head.get(b"content-length", b"")
    if not length.isdigit():
        return None
    start, end = at + pos + 2, at + pos + 2 + int(length)
    if end + 4 > source.size or source.read(end, 4) != END:
        return None
    url, digest = head.get(b"warc-target-uri"), head.get(b"warc-payload-digest")
    return {
        "at": at, "next": end + 4, "start": start, "end": end, "page_id": _page(head.get(b"warc-record-id")), "record_type": head.get(b"warc-type", b"").decode("latin-1"),
        "refers_to": _page(head.get(b"warc-refers-to")), "url": None if url is None else url.decode("utf-8", "replace"), "stated": None if digest is None else digest.decode("latin-1").removeprefix("sha1:"),
    }


def payload(source: Source, start: int, end: int, kind: str, stated: str | None) -> tuple[int, str]:
    """Bytes and digest of the payload of the block [start, end): of a response what stands behind the HTTP head, of a revisit what its head says of the payload it leaves out."""
    n = HEAD
    while (split := (data := source.read(start, min(n, end - start))).find(END)) < 0 and len(data) < end - start:
        n *= 4
    if kind == "revisit":
        m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", data)
        return int(m[1]) if m else 0, stated or ""
    at = start + split + 4 if split >= 0 else end
    total = hashlib.sha1()
    for low in range(at, end, RANGE):
        total.update(source.read(low, min(RANGE, end - low)))
    return end - at, base64.b32encode(total.digest()).decode()


def exits(found: list[tuple[int, int]], end: int) -> dict[int, int]:
    """For candidates (at, next) of a range that ends at `end`: where the chain from each leaves the range; -1 if it breaks inside."""
    out: dict[int, int] = {}
    for at, after in sorted(found, reverse=True):
        out[at] = after if after >= end else out.get(after, -1)
    return out


_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (x.split() for x in CANDIDATE.split(", "))])


def _in_range(source: Source, file: str, k: int, block: int) -> list[dict]:
    """The candidates of the k-th range, with where the chain from each leaves it."""
    low, high = k * block, min((k + 1) * block, source.size)
    # the magic may straddle the end of the range
    data = source.read(low, high - low + 9)
    places = [low + m.start() for m in MAGIC.finditer(data) if low + m.start() < high]
    rows = [r for at in places if (r := parse(source, at)) is not None]
    out = exits([(r["at"], r["next"]) for r in rows], high)
    return [r | {"file": file, "block": k, "exit": out[r["at"]]} for r in rows]


def _ranges(block: int):
    """Candidates of rows (file, range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(file) as f:
                    rows = _in_range(Source(f), file, k, block)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def _wholes(block: int):
    """Candidates of rows (file, content), with their payloads at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = Source(pa.BufferReader(data.as_buffer()))
                for k in range(-(-source.size // block)):
                    rows = [r | dict(zip(("payload_bytes", "payload_digest"), payload(source, r["start"], r["end"], r["record_type"], r["stated"]), strict=True)) for r in _in_range(source, file, k, block)]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def _payloads_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CANDIDATE with the payloads that they lack; a file stays open as long as its rows come."""
    name, handle, source = None, None, None
    try:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["payload_digest"] is None:
                    if r["file"] != name:
                        if handle is not None:
                            handle.close()
                        name, handle = r["file"], opened(r["file"])
                        source = Source(handle)
                    r["payload_bytes"], r["payload_digest"] = payload(source, r["start"], r["end"], r["record_type"], r["stated"])
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
    finally:
        if handle is not None:
            handle.close()


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one range on the chain from its entry."""
    after = dict(zip(rows["at"], rows["next"], strict=True))
    on, at = set(), rows.loc[rows["entry"], "at"].min() if rows["entry"].any() else None
    while at in after:
        on.add(at)
        at = after[at]
    return rows[rows["at"].isin(on)].drop(columns=["entry"])


def read_archives(spark: SparkSession, path: str, block: int = RANGE) -> DataFrame:
    """The records of all archives below `path` that are reachable from their file's start, in the columns of CANDIDATE."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length", "content")
    ranged = by_range(F.col("file"))
    listed = files.where(ranged).select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block).cast("int"))).alias("block"))
    found = listed.repartition("file", "block").mapInArrow(lean(_ranges(block)), CANDIDATE)
    # contents are read only where a file has to be taken whole
    if not files.select("file").where(~ranged).isEmpty():
        found = found.unionByName(files.where(~ranged).select("file", "content").mapInArrow(lean(_wholes(block)), CANDIDATE))
    candidates = stash(found, "warc-candidates")
    starts = candidates.where("at = 0").select("file", F.lit(0).cast("long").alias("at"))
    targets = candidates.where("exit >= 0").select("file", F.col("exit").alias("at")).distinct()
    # only what some chain leaves a range for can be an entry
    jumps = stash(candidates.select("file", "at", "exit").join(targets.unionByName(starts).distinct(), ["file", "at"]), "warc-jumps")
    reached = starts
    for _ in range(max(1, int(candidates.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]).bit_length() + 1)):
        ahead = reached.join(jumps, ["file", "at"]).where("exit >= 0").select("file", F.col("exit").alias("at"))
        reached = stash(reached.unionByName(ahead).distinct(), "warc-reached")
        jumps = stash(jumps.alias("a").join(jumps.alias("b"), F.expr("a.file = b.file AND a.exit = b.at"), "left").selectExpr("a.file", "a.at", "coalesce(b.exit, -1) AS exit"), "warc-jumps")
    marked = candidates.join(reached.withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    kept = marked.select(*names, "entry").groupBy("file", "block").applyInPandas(_walk, CANDIDATE)
    return kept.mapInArrow(lean(_payloads_read), CANDIDATE)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
