"""Commands, repairs on a copy, receipts and schemas."""

from __future__ import annotations

import json
import os
import shutil

import pytest

from framewright import cli
from framewright.operators import evidence
from framewright.plans import apply, receipts, schemas
from tests.test_sources import clean as clean_pair  # noqa: F401
from tests.test_sources import v21, v30  # noqa: F401


@pytest.fixture
def clean(clean_pair):  # noqa: F811
    return clean_pair[0]


def run(out, *args) -> tuple[int, object]:
    code = cli.main([*map(str, args), "--output", str(out)])
    with open(out, encoding="utf-8") as f:
        text = f.read()
    return code, json.loads(text) if not str(out).endswith(".csv") else text


def declare(root, **totals):
    path = os.path.join(root, "meta/info.json")
    with open(path) as f:
        info = json.load(f)
    with open(path, "w") as f:
        json.dump(info | totals, f)


def test_describing_commands(spark, v30, v21, tmp_path):  # noqa: F811
    out = tmp_path / "out.json"
    code, found = run(out, "scan", v30)
    assert code == 0 and found["format"] == "lerobot" and sum(r["files"] for r in found["files"]) >= 3
    code, found = run(out, "inspect", v30)
    assert code == 0 and found["version"] == "3" and found["totals"]["episodes"] > 0
    code, rows = run(out, "catalog", v30, v21)
    assert code == 0 and [r["version"] for r in rows] == ["3", "2"]
    code, text = run(tmp_path / "out.csv", "catalog", v30)
    assert code == 0 and text.splitlines()[0].startswith("data_shards,")
    code, found = run(out, "catalog-evidence", v30)
    assert code == 0 and len(found["digest"]) == 64 and "score" not in found
    _, one = run(out, "snapshot", v30)
    copy = str(tmp_path / "copy")
    shutil.copytree(v30, copy)
    _, two = run(out, "snapshot", copy)
    assert one["fingerprints"] == two["fingerprints"] and "snapshot" in one["fingerprints"]
    assert run(out, "version")[0] == 0
    assert run(out, "schema", "finding")[1]["items"]["properties"]["code"] == {"type": ["string", "null"]}
    with pytest.raises(ValueError):
        cli.main(["schema", "nothing", "--output", str(out)])
    with pytest.raises(SystemExit):
        cli.main(["repair-apply", v30, "--output", str(out)])


def test_repair_on_a_copy(spark, clean, tmp_path):  # noqa: F811
    out, plan, fixed = tmp_path / "out.json", str(tmp_path / "plan.json"), str(tmp_path / "fixed")
    good = apply.read_totals(clean)["/total_frames"]
    declare(clean, total_frames=999)
    assert run(plan, "repair-plan", clean)[1]["steps"] == [{"pointer": "/total_frames", "before": 999, "after": good}]
    code, result = run(out, "repair-apply", clean, "--plan", plan, "--to", fixed)
    assert code == 0 and result["status"] == "verified" and apply.read_totals(fixed)["/total_frames"] == good and apply.read_totals(clean)["/total_frames"] == 999
    assert run(out, "verify", clean, fixed)[0] == 0
    assert run(out, "verify", clean, clean)[0] == 2
    assert run(plan, "repair-plan", fixed)[1] == {"steps": []}
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".")]


def test_repairs_that_are_refused(clean, tmp_path):  # noqa: F811
    declare(clean, total_frames=999)
    made = apply.plan(clean, [{"pointer": "/total_frames", "before": 999, "after": 4}])
    free = str(tmp_path / "free")
    for steps in ([], [{"pointer": "/fps", "before": 1, "after": 2}], [{"pointer": "/total_frames", "before": 1, "after": True}], [{"pointer": "/total_frames", "before": 1, "after": -1}], made["steps"] * 2, [made["steps"][0] | {"before": 999.0}]):
        with pytest.raises(apply.Refused):
            apply.apply(clean, made | {"steps": steps}, free)
    os.mkdir(tmp_path / "there")
    for place in (str(tmp_path / "there"), os.path.join(clean, "inside"), os.path.dirname(clean.rstrip("/"))):
        with pytest.raises(apply.Refused):
            apply.apply(clean, made, place)
    with open(os.path.join(clean, "meta/more"), "w") as f:
        f.write("x")
    with pytest.raises(apply.Refused):
        apply.apply(clean, made, free)
    assert not os.path.exists(free)


def test_merge_commands(spark, clean, v21, tmp_path):  # noqa: F811
    out, other, merged = tmp_path / "out.json", str(tmp_path / "other"), str(tmp_path / "merged")
    shutil.copytree(clean, other)
    code, found = run(out, "merge-check", clean, other)
    assert (code, found["decision"]) == (2, "incompatible") and {c["check"] for c in found["checks"] if c["status"] == "incompatible"} == {"duplicates"}
    declare(other, robot_type="another")
    code, found = run(out, "merge-check", clean, other)
    assert (code, found["decision"]) == (0, "direct")
    shutil.copytree(clean, merged)
    code, found = run(out, "verify-merge", merged, clean, other)
    status = {c["check"]: c["status"] for c in found["checks"]}
    assert code == 2 and found["status"] == "unverified" and status["premerge_compatibility"] == "passed" and status["semantic_reconciliation"] == status["post_snapshot"] == "failed" and status["loader_smoke"] == "unverified"


def test_runners_and_receipts(spark):
    frame = spark.createDataFrame([("x", "passed")], "name string, status string")
    one = lambda r: receipts.run(spark, "m", "loader", r)

    def broken(_):
        raise RuntimeError

    assert one(None) is None and one(lambda _: frame) is frame
    assert [one(r).first()["status"] for r in (lambda _: True, lambda _: False, lambda _: None, lambda _: "?", broken)] == ["passed", "failed", "unverified", "failed", "failed"]
    checks = spark.createDataFrame([("a", "passed", "0"), ("b", "passed", None)], receipts.CHECK)
    r = receipts.receipt(checks, ["y", "x"], "m")
    assert r["status"] == "verified" and r["inputs"] == ["x", "y"] and r["fingerprint"] == receipts.receipt(checks.orderBy("check"), ["x", "y"], "m")["fingerprint"]
    assert receipts.receipt(checks.limit(0), [], "m")["status"] == "unverified"


def test_reuse_of_prepared_records(spark):
    of = lambda **v: spark.createDataFrame(list(v.items()), "name string, value string")
    have = of(root="/d", input_format="lerobot", checksum=None, integrity="sample", follow_symlinks="false")
    bad = lambda want: sorted(r["name"] for r in evidence.reusable(have, want).collect())
    assert bad(of(root="/d", input_format="auto", checksum=None, integrity="metadata", follow_symlinks="false")) == []
    assert bad(of(root="/e", input_format="video", checksum="sha256", integrity="full", follow_symlinks="true")) == ["checksum", "follow_symlinks", "input_format", "integrity", "root"]
    assert bad(of(other="1")) == ["other"]


def test_schemas():
    assert set(schemas.TABLES) < set(schemas.names())
    assert schemas.schema("footer")["items"]["properties"]["columns"] == {"type": ["array", "null"], "items": {"type": ["object", "null"]}}
    assert schemas.schema("audit")["required"] == ["summary", "accepted", "findings"]
