"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives the vocabulary; each split of a token into two tokens is a merge, in the order of the
merged token's rank, which is how a rank-driven encoder merges. Text is cut into pieces by the published
pattern, each piece is written through the byte-to-character table, tokenised by the library's BPE model,
and kept in a bounded per-task table, as pieces repeat. Offsets of the model's tokens are in characters of
the mapped piece, one for each byte, so they are byte offsets of the text; `encode_offsets` returns them.
Decoding reverses the table: a token is a run of bytes, and a character whose bytes lie in several tokens
comes back when the bytes are joined.

Null and empty texts encode to no ids. Ties cannot arise: each text is encoded on its own, repeated rows get equal
results. An empty table gives an empty result. Only the two named columns are read. Bytes that are no UTF-8 are read as U+FFFD. Texts are
coded in runs of about 400 KB; a longer one by itself, for which its pieces, ids, their decimal text and the decoded bytes
are held at once, some 30 times its size. A long piece is encoded in O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import as_bytes, as_text, at_leave, in_batches, lean, table

#: Pieces that a task keeps encoded.
KEPT_PIECES = 500_000

# Code points that the pattern library counts as letters or numbers and the reference
# encoder's older Unicode tables do not.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)


def _newer() -> str:
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in NEWER.split())


def _pattern(source: str, newer: str):
    """The published pattern with the newer code points moved from its letter and number classes to the others."""
    import regex

    others = "[^\\s\\p{L}\\p{N}]"
    parts = source.split(others)
    parts = [x.replace("\\p{L}", f"[\\p{{L}}--[{newer}]]").replace("\\p{N}", f"[\\p{{N}}--[{newer}]]") for x in parts]
    return regex.compile(f"(?:{others}|[{newer}])".join(parts), regex.V1)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is one, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    found, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in found:
            found[b] = chr(spare)
            spare += 1
    return [found[b] for b in range(256)]


class ByteBpe:
    """An encoder for one rank file; made once in each Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        from tokenizers import models

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.chars = byte_characters()
        self.bytes_of = {c: b for b, c in enumerate(self.chars)}
        self.mapping = {b: c for b, c in enumerate(self.chars)}
        mapped = lambda t: t.decode("latin-1").translate(self.mapping)
        merges = [(mapped(t[:k]), mapped(t[k:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.model = models.BPE(vocab={mapped(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.token_bytes = {r: bytes(self.bytes_of[c] for c in mapped(t)) for t, r in ranks.items()}
        self.plain = regex.compile(pattern).findall
        self.careful = _pattern(pattern, _newer()).findall
        self.is_newer = regex.compile(f"[{_newer()}]").search
        self.pieces: dict[str, tuple[str, bytes, int]] = {}

    def find(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or not self.is_newer(text) else self.careful(text)

    def mapped(self, piece: str) -> str:
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.mapping)

    def _piece(self, piece: str) -> tuple[str, bytes, int]:
        """Decimal ids with a space after each, the ids as 32-bit integers, and their count."""
        ids = [t.id for t in self.model.tokenize(self.mapped(piece))]
        if len(self.pieces) >= KEPT_PIECES:
            self.pieces.clear()
        self.pieces[piece] = made = (" ".join(map(str, ids)) + " ", np.array(ids, np.int32).tobytes(), len(ids))
        return made

    def encode(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by one space, and the ids as 32-bit integers."""
        known, make = self.pieces.get, self._piece
        found = [known(p) or make(p) for p in self.find(text)]
        return "".join([x[0] for x in found])[:-1], b"".join([x[1] for x in found])

    def encode_offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, byte after the last) of each token, in bytes of the text's UTF-8."""
        out, at = [], 0
        for piece in self.find(text):
            tokens = self.model.tokenize(self.mapped(piece))
            size = 0
            for t in tokens:
                n = len(t.value)
                out.append((t.id, at + size, at + size + n))
                size += n
            at += size
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, np.int32).tolist()))


_encoders: dict[tuple[str, str], ByteBpe] = {}
at_leave(__name__, _encoders.clear)


def encoder(ranks_path: str, pattern: str) -> ByteBpe:
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = ByteBpe(ranks_path, pattern)
    return _encoders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit, packed as binary), ids_text (decimal, joined by one space), n_tokens, decoded (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, text, ids, decimal, decoded in _coded(batches, ranks_path, pattern):
            yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.binary()), pa.array(decimal, pa.string()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "ids_text", "n_tokens", "decoded"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(run), "doc_id long, ids binary, ids_text string, n_tokens long, decoded binary")


def _coded(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str):
    tool = encoder(ranks_path, pattern)
    for batch in batches:
        for at, part in in_batches(as_bytes(batch.column(1))):
            texts = [as_text(t) for t in part]
            pairs = [tool.encode(t) for t in texts]
            ids = [p[1] for p in pairs]
            yield batch.column(0).slice(at, len(part)), texts, ids, [p[0] for p in pairs], [tool.decode(x) for x in ids]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact: the digests are taken where the ids are made, so ids and bytes never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, texts, ids, decimal, decoded in _coded(batches, ranks_path, pattern):
            yield pa.RecordBatch.from_arrays(
                [
                    doc,
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decimal], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    pa.array([x == t.encode("utf-8", "surrogatepass") for x, t in zip(decoded, texts, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
