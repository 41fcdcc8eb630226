"""Applies a repair plan to a copy of a data set: the source stays as it is, the copy appears whole or not at all.

The copy is made beside its destination, checked against the digest that the plan saw, changed in `meta/info.json` only, checked against the planned
values, and renamed; a destination that exists, or lies inside the source, is refused. Local file systems only, as others have no atomic rename of folders.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from framewright.functions.canonical import tree_digest
from framewright.operators.repair import POINTERS

INFO = os.path.join("meta", "info.json")


class Refused(ValueError):
    """Why a plan is not applied."""


def read_totals(root: str) -> dict[str, object]:
    """The declared value at each place that a repair may write to; a place that is not there is left out."""
    with open(os.path.join(root, INFO), encoding="utf-8") as f:
        info = json.load(f)
    if not isinstance(info, dict):
        raise Refused("meta/info.json is no object")
    return {p: info[p[1:]] for p in POINTERS if p[1:] in info}


def plan(root: str, steps: list[dict]) -> dict:
    """A plan from steps (pointer, before, after) as `repair.steps` gives them, bound to the source as it is now."""
    _check_steps(steps)
    return {"source_digest": tree_digest(root), "steps": [{k: s[k] for k in ("pointer", "before", "after")} for s in steps]}


def _check_steps(steps: list[dict]) -> None:
    places = [s["pointer"] for s in steps]
    if not steps:
        raise Refused("the plan has no steps")
    for s in steps:
        if s["pointer"] not in POINTERS:
            raise Refused(f"{s['pointer']} is no place that a repair may write to")
        if isinstance(s["after"], bool) or not isinstance(s["after"], int) or s["after"] < 0:
            raise Refused(f"{s['pointer']} gets no count")
    if len(set(places)) < len(places):
        raise Refused("two steps for one place")


def _same(a, b) -> bool:
    return type(a) is type(b) and a == b


def check_destination(source: str, destination: str) -> None:
    """A destination must be new, and neither of the two folders inside the other."""
    if os.path.lexists(destination):
        raise Refused("the destination exists")
    a, b = os.path.realpath(source), os.path.realpath(destination)
    if os.path.commonpath([a, b]) in (a, b):
        raise Refused("source and destination lie inside one another")


def apply(root: str, made: dict, destination: str) -> dict:
    """Applies `made` (see `plan`) and gives (status, source_digest, result_digest, values)."""
    steps = made["steps"]
    _check_steps(steps)
    check_destination(root, destination)
    if tree_digest(root) != made["source_digest"]:
        raise Refused("the source changed since the plan was made")
    stale = [s["pointer"] for s in steps if not _same(read_totals(root).get(s["pointer"]), s["before"])]
    if stale:
        raise Refused(f"{stale[0]} no longer holds what the plan saw")
    parent = os.path.dirname(os.path.abspath(destination))
    os.makedirs(parent, exist_ok=True)
    staging = tempfile.mkdtemp(prefix=f".{os.path.basename(destination)}.", dir=parent)
    try:
        copy = os.path.join(staging, "copy")
        shutil.copytree(root, copy, symlinks=True)
        if tree_digest(copy) != made["source_digest"]:
            raise Refused("the copy differs from the source")
        _write(copy, steps)
        if tree_digest(root) != made["source_digest"]:
            raise Refused("the source changed while it was copied")
        digest = tree_digest(copy)
        # an empty folder in its place would be replaced by a rename, so the name is taken first
        os.mkdir(destination)
        os.rename(copy, destination)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    values = read_totals(destination)
    matched = all(_same(values.get(s["pointer"]), s["after"]) for s in steps)
    return {"status": "verified" if matched and tree_digest(destination) == digest else "failed", "source_digest": made["source_digest"], "result_digest": digest, "values": values}


def _write(root: str, steps: list[dict]) -> None:
    path = os.path.join(root, INFO)
    with open(path, encoding="utf-8") as f:
        info = json.load(f)
    info |= {s["pointer"][1:]: s["after"] for s in steps}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(info, f, indent=4, ensure_ascii=False)
        f.write("\n")
