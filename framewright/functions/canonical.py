"""Canonical encodings that need Python: typed trees and tree digests."""

from __future__ import annotations

import hashlib
import json
import math
import os
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags of the typed form, and the largest integer that every reader of JSON holds exactly.
TAGS = {"nothing": '["null"]', "yes": '["bool","true"]', "no": '["bool","false"]', "text": '["string",%s]', "whole": '["number","integer","%d"]', "real": '["number","float64","%s"]'}
LIST, RECORD = ('["array",[', "]]"), ('["object",[', "]]")
SAFE = (1 << 53) - 1


class _Piece(str):
    """Text that is written as it is."""


def _text(value: str) -> str:
    value.encode("utf-8")  # a lone surrogate is no text: UnicodeEncodeError is a ValueError
    return json.dumps(value, ensure_ascii=False)


def _number(value: int | float) -> str:
    if not math.isfinite(value):
        raise ValueError("number is not finite")
    if value != math.floor(value):
        return TAGS["real"] % struct.pack(">d", value).hex()
    if not -SAFE <= value <= SAFE:
        raise ValueError("integer beyond 2**53 - 1")
    return TAGS["whole"] % int(value)


def _members(value: dict) -> list:
    if not all(isinstance(k, str) for k in value):
        raise ValueError("keys are texts")
    return [(_Piece(f"[{_text(k)},"), value[k], _Piece("]")) for k in sorted(value, key=str.encode)]


_SCALARS = {
    type(None): lambda _: TAGS["nothing"],
    bool: lambda v: TAGS["yes" if v else "no"],
    int: _number,
    float: _number,
    str: lambda v: TAGS["text"] % _text(v),
}


def typed_text(value) -> str:
    """A JSON value in the typed form as compact JSON text: every scalar says what it is, whole numbers are integers whatever they were written as,
    others the hex of their big-endian bits; members are in the order of their keys' UTF-8 bytes. Written piece by piece from a stack, so depth is no limit."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Piece):
            out.append(v)
        elif (scalar := _SCALARS.get(type(v))) is not None:
            out.append(scalar(v))
        elif isinstance(v, list | tuple | dict):
            edges = RECORD if isinstance(v, dict) else LIST
            parts = _members(v) if isinstance(v, dict) else [(x,) for x in v]
            row = [x for k, p in enumerate(parts) for x in ((_Piece(","), *p) if k else p)]
            todo += [_Piece(edges[1]), *reversed(row), _Piece(edges[0])]
        else:
            raise ValueError(f"no JSON value: {type(v).__name__}")
    return "".join(out)


def typed_digest(value) -> str:
    return hashlib.sha256(typed_text(value).encode()).hexdigest()


def typed_digests(text: Column) -> Column:
    """The digest of each JSON text's typed form, null where the text is no JSON or holds what the form has no place for."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_digest_of)

    return run(text)


def _digest_of(text: str | None) -> str | None:
    try:
        return typed_digest(json.loads(text))
    except (TypeError, ValueError):
        return None


def plain_json(value) -> str:
    """Sorted keys, no spaces, NaN and infinities as strings."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return value


def same_json(a, b) -> bool:
    """Equal in type and value: true is not 1, and 1 is not 1.0; nothing equals what is no JSON."""
    try:
        one, two = (json.dumps(x, sort_keys=True, allow_nan=False) for x in (a, b))
    except (TypeError, ValueError):
        return False
    return one == two


def tree_digest(root: str) -> str:
    """One digest of a local tree: every folder, file and link as a record with its type, name and content, each field with its length before it."""
    total = hashlib.sha256()

    def add(*fields: bytes) -> None:
        for f in fields:
            total.update(struct.pack(">Q", len(f)))
            total.update(f)

    for folder, names, files in os.walk(root):
        names.sort()
        for name in sorted([*(n for n in names if os.path.islink(os.path.join(folder, n))), *files]):
            full = os.path.join(folder, name)
            relative = os.fsencode(os.path.relpath(full, root))
            if os.path.islink(full):
                add(b"link", relative, os.fsencode(os.readlink(full)))
                continue
            own = hashlib.sha256()
            with open(full, "rb") as f:
                while block := f.read(1 << 20):
                    own.update(block)
            add(b"file", relative, own.digest())
        add(b"folder", os.fsencode(os.path.relpath(folder, root)))
    return total.hexdigest()
