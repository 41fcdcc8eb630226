"""JSON schemas of the artifacts, derived from the column lists that the engine itself uses."""

from __future__ import annotations

import re

from framewright import model
from framewright.operators import diff, media
from framewright.plans import receipts
from framewright.sources import files, lerobot

_KINDS = {"string": "string", "long": "integer", "int": "integer", "double": "number", "boolean": "boolean"}


def _column(kind: str) -> dict:
    inner = re.fullmatch(r"array<(.*)>", kind.strip())
    if inner:
        return {"type": ["array", "null"], "items": _column(inner[1])}
    if kind.startswith("struct<"):
        return {"type": ["object", "null"]}
    return {"type": [_KINDS[kind.strip()], "null"]}


def _split(ddl: str) -> list[str]:
    """The columns of a DDL text; commas inside <> part nothing."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _rows(ddl: str) -> dict:
    columns = dict(x.split(" ", 1) for x in _split(ddl))
    return {"type": "array", "items": {"type": "object", "properties": {n: _column(k) for n, k in columns.items()}, "additionalProperties": False}}


TABLES = {"finding": model.FINDING, "change": diff.CHANGE, "footer": files.FOOTER, "episode": lerobot.EPISODE, "relation": lerobot.RELATION, "video": media.PROBE, "check": receipts.CHECK}


def names() -> list[str]:
    return sorted([*TABLES, "audit", "readiness"])


def schema(name: str) -> dict:
    """The schema of a table's rows or of an artifact; an unknown name is a ValueError."""
    head = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name}
    if name in TABLES:
        return head | _rows(TABLES[name])
    count = {"type": "integer", "minimum": 0}
    if name == "audit":
        summary = {"type": "object", "properties": dict.fromkeys(model.SEVERITIES, count), "required": list(model.SEVERITIES)}
        return head | {"type": "object", "properties": {"summary": summary, "accepted": {"type": "boolean"}, "findings": _rows(model.FINDING)}, "required": ["summary", "accepted", "findings"]}
    if name == "readiness":
        return head | {"type": "object", "properties": {"status": {"enum": ["READY", "PARTIAL", "BLOCKED"]}, "blockers": {"type": "array"}, "gaps": {"type": "array"}}, "required": ["status", "blockers", "gaps"]}
    raise ValueError(f"unknown schema {name}; there are {', '.join(names())}")
