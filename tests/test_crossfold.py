"""Out-of-fold comparison and qualification: draws against plain resampling, refusals, empty and odd tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import crossfold


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    split, gold, runs = [], [], []
    for i in range(400):
        fold = int(rng.integers(3)) if i % 13 else None
        split.append((f"p{i}", f"g{i // 2 if i % 4 < 2 else i}-{fold}", fold))
        gold.append((f"p{i}", str(i)))
        for label, right, said in (("base", 0.6, 0.9), ("tuned", 0.75, 0.8), ("small", 0.3, 1.0)):
            if fold is not None:
                runs.append((label, fold, f"p{i}", (str(i) if rng.random() < right else str(-i - 1)) if rng.random() < said else None))
    return spark.createDataFrame(split, "id string, group_id string, fold int"), spark.createDataFrame(gold, "id string, gold string"), spark.createDataFrame(runs, "label string, fold int, id string, prediction string")


def test_stratified_intervals_equal_plain_resampling(tables):
    split, gold, runs = tables
    out = {r.hypothesis: r for r in crossfold.compare_out_of_fold(gold, runs, split, "base", ["tuned", "small"], samples=20_000, seed=4).collect()}
    assert len(out) == 2 + 6
    want, said = {r.id: r.gold for r in gold.collect()}, {(r.label, r.id): r.prediction for r in runs.collect()}
    groups: dict = {}
    for r in split.where("fold IS NOT NULL").collect():
        groups.setdefault(r.fold, {}).setdefault(r.group_id, []).append(r.id)
    ok = lambda x, i: x is not None and x == want[i]
    for name, a, b in (("candidate:tuned", "base", "tuned"), ("fallback_on_invalid:tuned->small", "tuned", None)):
        second = lambda i, a=a, b=b: said[b, i] if b else said[a, i] if said[a, i] is not None else said["small", i]
        rng, deltas = np.random.default_rng(8), []
        tables_ = [[(sum(ok(second(i), i) - ok(said[a, i], i) for i in ids), len(ids)) for ids in own.values()] for own in groups.values()]
        for _ in range(6_000):
            total = size = 0
            for own in tables_:
                pick = np.array(own)[rng.integers(len(own), size=len(own))]
                total, size = total + pick[:, 0].sum(), size + pick[:, 1].sum()
            deltas.append(total / size)
        low, high = np.quantile(deltas, (0.025, 0.975))
        assert abs(out[name].ci_low - low) < 0.006 and abs(out[name].ci_high - high) < 0.006
        assert out[name].ci_low <= out[name].delta <= out[name].ci_high
    ids = [i for own in groups.values() for x in own.values() for i in x]
    mute = [i for i in ids if said["tuned", i] is None]
    row = out["fallback_on_invalid:tuned->base"]
    assert (row.total, row.n_asked, row.n_answered) == (len(ids), len(mute), sum(said["base", i] is not None for i in mute)) and row.n_asked == row.n_answered + row.n_unanswered


def test_hypotheses_share_their_draws(tables):
    """A run and its copy move alike in every resample, whatever the partitions."""
    split, gold, runs = tables
    copied = runs.unionByName(runs.where("label = 'tuned'").withColumn("label", F.lit("twin")))
    rows = crossfold.pooled(gold, copied, crossfold.eligible(split), ["base", "tuned", "twin"], "base")
    names = [c["hypothesis"] for c in rows.first()["cases"]]
    one, two = (crossfold.stratified_deltas(crossfold.stratified_profile(rows.repartition(n)), 300, 9, 100).orderBy("sample").collect() for n in (1, 7))
    assert one == two and len(one) == 300
    a, b = names.index("candidate:tuned"), names.index("candidate:twin")
    assert all(r.deltas[a] == r.deltas[b] for r in one) and len({r.deltas[a] for r in one}) > 20


def test_refusals(spark, tables):
    split, gold, runs = tables
    for bad in (runs.where("id <> 'p1'"), runs.unionByName(runs.limit(1)), runs.withColumn("fold", F.when(F.col("id") == "p1", 9).otherwise(F.col("fold"))), runs.where("label <> 'small'")):
        with pytest.raises(ValueError, match="cover"):
            crossfold.compare_out_of_fold(gold, bad, split, "base", ["tuned", "small"], samples=10)
    for labels in ([], ["base"], ["tuned", "tuned"]):
        with pytest.raises(ValueError, match="label"):
            crossfold.compare_out_of_fold(gold, runs, split, "base", labels, samples=10)
    with pytest.raises(Exception, match="more than one fold"):
        crossfold.compare_out_of_fold(gold, runs, split.withColumn("group_id", F.lit("g")), "base", ["tuned", "small"], samples=10).collect()
    with pytest.raises(Exception, match="no gold"):
        crossfold.compare_out_of_fold(gold.where("id <> 'p1'"), runs, split, "base", ["tuned", "small"], samples=10).collect()
    with pytest.raises(ValueError, match="nothing"):
        crossfold.compare_out_of_fold(gold, runs.limit(0), split.limit(0), "base", ["tuned"], samples=10)


def test_evidence_of_odd_tables(spark):
    schema = "label string, fold int, run_sha256 string, manifest_sha256 string, fingerprint string, adapter_sha256 string, provenance_sha256 string"
    none = spark.createDataFrame([], schema)
    assert {tuple(r) for r in crossfold.evidence_issues(none, ["a"], "a", 2).collect()} == {("a", 0, "missing_run"), ("a", 1, "missing_run")}
    odd = spark.createDataFrame([("a", 0, "r", "m", None, None, None), ("a", 0, "r", "m", None, None, None), (None, None, None, None, None, "x", None)], schema)
    assert {tuple(r) for r in crossfold.evidence_issues(odd, ["a"], "a", 1).collect()} == {("a", 0, "duplicate_run"), ("a", None, "mixed_fingerprints"), (None, None, "undeclared_label"), (None, None, "mixed_fingerprints")}
    rows, split, gold = spark.createDataFrame([], "label string, fold int, id string, prediction string"), spark.createDataFrame([], "id string, group_id string, fold int"), spark.createDataFrame([], "id string, gold string")
    assert crossfold.qualify_base(gold, rows, none, split, "f").collect() == []
    (got,) = crossfold.qualify_base(gold, rows, odd.where("label = 'a'"), split, "f").collect()
    assert not got.qualified and not got.exact_fold_coverage and got.accuracy is None
