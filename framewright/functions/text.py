"""Scalar functions on paths, patterns, versions, locators and numbers, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression for *, ? and [...], where * also crosses slashes."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def relative_path_valid(c: Column) -> Column:
    """Portable and relative: no root, drive, backslash, empty, . or .. part."""
    parts = F.split(c, "/")
    return c.isNotNull() & ~c.contains("\\") & ~c.rlike("^[A-Za-z]:") & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def stream_of_path(c: Column) -> Column:
    """The camera of a video path: below videos/ the first part that is no chunk or file part, else the parent folder, else default."""
    parts = F.split(c, "/")
    at = F.array_position(parts, "videos")
    behind = F.filter(F.slice(parts, F.greatest(at + 1, F.lit(1)).cast("int"), F.greatest(F.size(parts) - at - 1, F.lit(0)).cast("int")), lambda p: ~(p.startswith("chunk-") | p.startswith("file-")))
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    return F.coalesce(F.when(at > 0, F.get(behind, F.lit(0))), parent, F.lit("default"))


def public_locator(c: Column) -> Column:
    """A URL without credentials, query and fragment; null for anything without a scheme and a host."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+"), bare)


def redacted(c: Column) -> Column:
    """Tokens, bearer headers and private paths replaced."""
    out = F.regexp_replace(c, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    out = F.regexp_replace(out, r"\b(?:hf_|ghp_|sk-)[A-Za-z0-9]{8,}", "[redacted]")
    return F.regexp_replace(out, r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)[^/\\\s]+", "[private]")


def secret_like(c: Column) -> Column:
    """Looks like a credential."""
    return c.rlike(r"(?i)(?:^|[^a-z])(?:token|secret|password|api[_-]?key)\s*[=:]|\b(?:hf_|ghp_|sk-)[A-Za-z0-9]{8,}|bearer\s+\S+")


def version_parts(c: Column) -> Column:
    """major, minor, patch of v?M.m[.p]; null where the text is no version."""
    form = r"^v?(\d+)\.(\d+)(?:\.(\d+))?$"
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(F.trim(c), form, k), F.lit("")), F.lit("999999999")).cast("long")
    return F.when(F.trim(c).rlike(form), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def version_state(c: Column, supported: dict[int, int]) -> Column:
    """missing, invalid, exact, unknown_minor or unsupported_major against {major: minor}."""
    v = version_parts(c)
    out = F.lit("unsupported_major")
    for major, minor in supported.items():
        same = (v["major"] == major) & (v["minor"] == minor) & (F.coalesce(v["patch"], F.lit(0)) == 0)
        out = F.when(same, "exact").when(v["major"] == major, "unknown_minor").otherwise(out)
    return F.when(c.isNull() | (F.trim(c) == ""), "missing").when(v.isNull(), "invalid").otherwise(out)


def template_path(template: str, **columns: Column) -> Column:
    """A path template with {name} and {name:0Nd} filled in; an unknown placeholder is an error. Wider numbers are never cut."""
    parts, args, at = "", [], 0
    for m in re.finditer(r"\{(\w+)(?::0?(\d+)d)?\}", template):
        if m[1] not in columns:
            raise ValueError(f"unknown placeholder {m[1]}")
        parts += template[at : m.start()].replace("%", "%%") + (f"%0{m[2]}d" if m[2] else "%s")
        args.append(columns[m[1]].cast("long") if m[2] else columns[m[1]].cast("string"))
        at = m.end()
    rest = template[at:]
    if "{" in rest or "}" in rest:
        raise ValueError("unbalanced template")
    return F.format_string(parts + rest.replace("%", "%%"), *args)


def utc_seconds(c: Column) -> Column:
    """RFC 3339 text with a mandatory zone as UTC, to the second, with Z; null otherwise."""
    ok = c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$")
    return F.when(ok, F.date_format(F.to_utc_timestamp(F.try_to_timestamp(F.upper(c)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def non_negative_integer(c: Column) -> Column:
    """A text that is a non-negative integer as long, else null; true and false are no integers."""
    return F.when(c.rlike(r"^\s*\d{1,18}\s*$"), F.trim(c).cast("long"))


def half_even(c: Column, digits: int) -> Column:
    """Rounding half to even on the decimal value."""
    return F.bround(c, digits)
