"""Split manifests, eligibility and large files against plain Python."""

from __future__ import annotations

import hashlib
import json

import pytest

from sievelight.operators import aggregates, manifests
from sievelight.operators.splits import HOLDOUT, TRAINED
from sievelight.sources import files

ROWS = [("a\"b", "a\"b", TRAINED, 0), ("c\n\x1f", "a\"b", TRAINED, 0), ("é\\", "é\\", TRAINED, 1), ("z", "z", HOLDOUT, None), ("日本", "日本", TRAINED, 1)]


def compact(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha(x):
    return hashlib.sha256(compact(x).encode()).hexdigest()


def manifest(rows, fraction=0.1):
    rows = sorted(rows)
    out = {"version": "v", "seed": 3, "n_folds": 2, "holdout_fraction": fraction, "algorithm": "α", "source_groups_sha256": sha([[r[0], r[1]] for r in rows]), "assignments": [dict(zip(("record_id", "group_id", "partition", "fold"), r, strict=True)) for r in rows]}
    out["sha256"] = sha(out)
    parts, folds = [(TRAINED, [r for r in rows if r[2] == TRAINED]), (HOLDOUT, [r for r in rows if r[2] == HOLDOUT])], [(str(f), [r for r in rows if r[3] == f]) for f in range(2)]
    out["actual_counts"] = {f"{kind}_{what}": {k: len(own) if what == "records" else len({r[1] for r in own}) for k, own in cells} for kind, cells in (("partition", parts), ("fold", folds)) for what in ("records", "groups")}
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_split_identity(spark, parts):
    split = spark.createDataFrame(ROWS, manifests.ASSIGNMENT).repartition(parts)
    want = manifest(ROWS, 1e-7)
    assert tuple(manifests.split_identity(split, "v", 3, 2, 1e-7, "α").first()) == (5, want["source_groups_sha256"], want["sha256"])
    assert manifests.split_identity(split.limit(0), "v", 3, 2, 0.5, "α").count() == 0


def read(spark, tmp_path, text, key=None):
    (tmp_path / "m.json").write_text(text)
    split, issues = manifests.read_split(spark, str(tmp_path / "m.json"), key)
    return sorted(map(tuple, split.collect())), sorted(r[0] for r in issues.collect())


def test_read_split(spark, tmp_path):
    whole = manifest(ROWS)
    assert read(spark, tmp_path, json.dumps(whole, indent=2)) == (sorted(ROWS), [])
    assert read(spark, tmp_path, json.dumps({"split": whole, "other": [1]}), "split") == (sorted(ROWS), [])
    assert read(spark, tmp_path, json.dumps(whole), "split")[1] == ["key_set"]
    assert read(spark, tmp_path, json.dumps(whole)[:-1] + ',"seed":3}')[1] == ["repeated_key"]
    assert read(spark, tmp_path, json.dumps({k: v for k, v in whole.items() if k != "seed"}))[1] == ["key_set"]
    assert read(spark, tmp_path, json.dumps({**whole, "sha256": "0" * 64}))[1] == ["sha256"]
    assert read(spark, tmp_path, json.dumps({**whole, "actual_counts": {**whole["actual_counts"], "fold_records": {"0": 1, "1": 2}}}))[1] == ["actual_counts"]
    late = {**whole, "assignments": whole["assignments"][::-1]}
    assert read(spark, tmp_path, json.dumps(late))[1] == ["order"]
    other = json.loads(json.dumps(whole))
    other["assignments"][0]["group_id"] = "q"
    assert read(spark, tmp_path, json.dumps(other))[1] == ["actual_counts", "sha256", "source_groups_sha256"]
    other["assignments"][0]["partition"] = "open"
    assert "assignment" in read(spark, tmp_path, json.dumps(other))[1]


def test_eligibility(spark):
    split = spark.createDataFrame(ROWS, manifests.ASSIGNMENT)
    out = spark.createDataFrame([("c\n\x1f",), ("nobody",), (None,), ("c\n\x1f",)], "record_id string")
    got = {(r.part, r.fold): (r.n, r.ids_sha256) for r in manifests.eligibility_report(split, out, 2).collect()}
    ids = lambda *x: (len(x), sha(sorted(x)))
    assert got == {("direct", None): ids("c\n\x1f"), ("expanded", None): ids("a\"b", "c\n\x1f"), ("eligible", None): (3, None), ("training", 0): ids("é\\", "日本"), ("validation", 0): ids(), ("training", 1): ids(), ("validation", 1): ids("é\\", "日本")}


def test_split_diff_is_null_safe(spark):
    a = spark.createDataFrame(ROWS, manifests.ASSIGNMENT)
    b = spark.createDataFrame([(*ROWS[0][:3], None), *ROWS[2:], ("new", "new", TRAINED, 1)], manifests.ASSIGNMENT)
    assert sorted(map(tuple, manifests.split_diff(a, b).collect())) == [("a\"b", "fold"), ("c\n\x1f", "row"), ("new", "row")]


def test_preflight_coverage(spark):
    rows = [(0, "training", "a", 9, 1), (1, "validation", "a", 9, 1), (0, "validation", "b", 9, 2), (1, "training", "b", 9, 2), (0, "training", "c", 3, 1)]
    df = spark.createDataFrame(rows, "fold long, role string, id string, sequence_tokens int, response_tokens int")
    assert tuple(aggregates.preflight_coverage(df).first()) == (3, 2, 1, 9, "b", 0, "validation")
    assert tuple(aggregates.preflight_coverage(df.limit(0)).first()) == (0, 0, 0, None, None, None, None)
    assert {(r.fold, r.role): r.over_limit for r in aggregates.preflight(df, 8).collect()} == {(0, "training"): 1, (1, "validation"): 1, (0, "validation"): 1, (1, "training"): 1}


def test_files_of_any_size(spark, tmp_path, monkeypatch):
    (tmp_path / "small file.bin").write_bytes(b"12")
    with open(tmp_path / "large.bin", "wb") as f:  # sparse
        f.truncate((3 << 30) + 5)
    want = hashlib.sha256()
    for _ in range(3 << 7):
        want.update(bytes(8 << 20))
    want.update(bytes(5))
    got = {r.path: (r.size_bytes, r.sha256) for r in files.file_manifest(spark, str(tmp_path)).collect()}
    assert got == {"small file.bin": (2, hashlib.sha256(b"12").hexdigest()), "large.bin": ((3 << 30) + 5, want.hexdigest())}
    monkeypatch.setattr(files, "ONE_ROW", 1)
    (tmp_path / "large.bin").unlink()
    assert [tuple(r) for r in files.file_manifest(spark, str(tmp_path)).collect()] == [("small file.bin", 2, hashlib.sha256(b"12").hexdigest())]
