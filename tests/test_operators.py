from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import aggregates, clusters, evaluation, joins, ledger, ranking, splits, validation, voting


def rank(ns, seed, version, value):
    return hashlib.sha256(f"{ns}\0{seed}\0{version}\0{value}".encode()).hexdigest()


def sequential_split(sizes: dict[str, int], fraction, k, seed, version):
    """Holdout and folds, one group after another."""
    total = sum(sizes.values())
    target, size, held = total * fraction, 0, set()
    for g in sorted(sizes, key=lambda g: (rank("holdout", seed, version, g), g)):
        if abs(size + sizes[g] - target) < abs(size - target):
            held.add(g)
            size += sizes[g]
    if not held:
        held = {min(sizes, key=lambda g: (abs(sizes[g] - target), rank("holdout-fallback", seed, version, g)))}
        size = sum(sizes[g] for g in held)
    while len(sizes) - len(held) < k:
        out = min(held, key=lambda g: (abs(size - sizes[g] - target), rank("holdout-trim", seed, version, g)))
        held.remove(out)
        size -= sizes[out]
    full, n, fold = [0] * k, [0] * k, {}
    for g in sorted(set(sizes) - held, key=lambda g: (-sizes[g], rank("cv-group", seed, version, g), g)):
        f = min(range(k), key=lambda f: (full[f], n[f], rank("fold", seed, version, str(f))))
        fold[g] = f
        full[f] += sizes[g]
        n[f] += 1
    return {g: fold.get(g) for g in sizes}


CASES = [([1] * 14, 0.1, 5), ([5, 4, 4, 3, 3, 2, 2, 2, 1, 1, 1, 1, 1, 1], 0.2, 4), ([2] * 50 + [1] * 50, 0.1, 5), ([40, 1, 1, 1, 1, 1, 1], 0.3, 3), ([9, 9, 9, 9], 0.01, 3), ([30, 20, 5, 1], 0.5, 3)]


@pytest.mark.parametrize("case", range(len(CASES) + 6))
def test_split_equals_sequential(spark, case):
    rng = random.Random(case)
    sizes, fraction, k = CASES[case] if case < len(CASES) else ([rng.choice((1, 1, 1, 2, 3, rng.randint(1, 30))) for _ in range(rng.randint(8, 120))], rng.choice((0.05, 0.1, 0.33)), rng.randint(2, 6))
    groups = {f"g{i:03d}": s for i, s in enumerate(sizes)}
    rows = spark.createDataFrame([(f"{g}-{i}", g) for g, s in groups.items() for i in range(s)], "record_id string, group_id string")
    split = splits.make_split(rows, k, fraction, case, "v1")
    got = {r.group_id: (r.partition, r.fold) for r in split.collect()}
    want = sequential_split(groups, fraction, k, case, "v1")
    assert got == {g: (splits.HOLDOUT if f is None else splits.TRAINED, f) for g, f in want.items()}
    assert split.count() == sum(sizes)


def test_slot_segments_equal_greedy():
    rng = random.Random(3)
    for _ in range(400):
        k = rng.randint(1, 6)
        sizes = sorted((rng.randint(1, rng.choice((2, 5, 40))) for _ in range(rng.randint(1, 60))), reverse=True)
        ties = [rank("fold", rng.randint(0, 9), "v", str(f)) for f in range(k)]
        full, n, want = [0] * k, [0] * k, []
        for s in sizes:
            f = min(range(k), key=lambda f: (full[f], n[f], ties[f]))
            want.append(f)
            full[f] += s
            n[f] += 1
        found: dict = {}
        for s, lo, hi, turn in splits.slot_segments(list(collections.Counter(sizes).items()), k, ties):
            for i in range(lo, hi):
                found[s, i] = turn[(i - lo) % len(turn)]
        seen: collections.Counter = collections.Counter()
        for s, f in zip(sizes, want, strict=True):
            assert found[s, seen[s]] == f
            seen[s] += 1


def test_split_issues_and_scopes(spark):
    good = spark.createDataFrame([(str(i), str(i), splits.TRAINED, i % 3) for i in range(9)] + [("h", "h", splits.HOLDOUT, None)], "record_id string, group_id string, partition string, fold int")
    assert splits.split_issues(good, 3).count() == 0
    assert {r.record_id for r in splits.scope(good, "fold-validation", 1).collect()} == {"1", "4", "7"}
    assert splits.scope(good, "fold-training", 1).count() == 6 and splits.scope(good, "all").count() == 10 and splits.scope(good, "cv-only").count() == 9 and splits.holdout_ids(good).count() == 1
    with pytest.raises(ValueError):
        splits.scope(good, "fold-training")
    bad = good.unionByName(spark.createDataFrame([("1", "1", splits.HOLDOUT, None), ("z", "z", splits.TRAINED, 7)], good.schema))
    assert {r.code for r in splits.split_issues(bad, 3).collect()} == {"duplicate_record", "split_group", "bad_fold"}
    assert {r.code for r in splits.split_issues(good, 4).collect()} == {"empty_part"}
    with pytest.raises(ValueError):
        splits.make_split(good.select("record_id", "group_id").limit(2), 5)


def test_clusters(spark):
    ids = spark.createDataFrame([(x,) for x in "abcdefgh"], "id string")
    pairs = spark.createDataFrame([("c", "b"), ("b", "a"), ("h", "h")], "a string, b string")
    labels = spark.createDataFrame([("d", "l1"), ("e", "l1"), ("e", "l2"), ("f", "l2"), ("g", None)], "id string, label string")
    got = {r.id: r.group_id for r in clusters.build_clusters(ids, pairs, labels).collect()}
    assert got == dict(zip("abcdefgh", "aaadddgh", strict=True))
    with pytest.raises(ValueError):
        clusters.build_clusters(ids, spark.createDataFrame([("a", "zz")], "a string, b string"))
    assert clusters.components(pairs.limit(0)).count() == 0


def test_ranking(spark):
    df = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") % 3).alias("k"))
    got = {(r.k, r.h): r.rn for r in ranking.numbered(df, ["h"], ["k"]).collect()}
    want = {}
    for k in range(3):
        for i, h in enumerate(sorted(r.h for r in df.where(df.k == k).collect()), 1):
            want[k, h] = i
    assert got == want
    rows = ledger.in_order(spark.range(1000).repartition(7), "id").collect()
    assert all(r.rn == r.id + 1 for r in rows) and len(rows) == 1000


def candidate(problem, ord_, text, route="cot", greedy=False, verifier=None, seed=None, index=None):
    return (problem, ord_, text, ord_ if seed is None else seed, route, greedy, verifier, index, None, None, None)


CANDIDATE = "problem_id string, ord int, completion string, seed int, route string, greedy boolean, verifier_passed boolean, sample_index int, prompt_sha256 string, checkpoint_sha256 string, generation_config_sha256 string"


def test_voting(spark):
    rows = [
        candidate("major", 0, "x\nFinal answer: 5"), candidate("major", 1, "y\nFinal answer: 5"), candidate("major", 2, "Final answer: 6"), candidate("trace", 0, "Final answer: 1"), candidate("trace", 1, " Final answer: 1 "), candidate("trace", 2, "q\nFinal answer: 2", verifier=True),
        candidate("tie", 0, "a\nFinal answer: 1"), candidate("tie", 1, "b\nFinal answer: 2"), candidate("none", 0, "nothing here"), candidate("ident", 0, "Final answer: 4", seed=7), candidate("ident", 1, "w\nFinal answer: 4", seed=7), candidate("ident", 2, "Final answer: 3", verifier=False),
        *(candidate("exact", i, f"{i}\nFinal answer: {a}", route=r) for i, (a, r) in enumerate([(1, "a"), (1, "b"), (2, "c"), (2, "c2")])),
    ]
    df = spark.createDataFrame(rows, CANDIDATE)
    out = {r.problem_id: r for r in voting.aggregate_candidates(df, {"a": 0.1, "b": 0.2, "c": 0.15, "c2": 0.15}).collect()}
    assert (out["major"].status, out["major"].selected_answer, round(out["major"].share, 6)) == ("selected", "5", round(2 / 3, 6))
    assert (out["trace"].status, out["trace"].selected_answer) == ("selected", "2")
    assert (out["tie"].status, out["tie"].selected_answer, out["tie"].share) == ("tie", None, 0.5)
    assert (out["none"].status, out["none"].share) == ("no_valid_answer", 0.0)
    assert out["exact"].status == "tie"  # 0.1 + 0.2 is 0.15 + 0.15
    excluded = {(r.problem_id, r.ord): r.exclusion for r in voting.evaluate_candidates(df).collect() if r.exclusion}
    assert excluded == {("trace", 1): "duplicate_trace", ("none", 0): "parser_invalid", ("ident", 1): "duplicate_generation_identity"}
    assert {r.problem_id for r in voting.identity_conflicts(df).collect()} == {"ident"}
    assert voting.incomplete_provenance(df).count() == len(rows)
    steps = {r.problem_id: (r.should_stop, r.next_budget) for r in voting.with_budget(voting.aggregate_candidates(df), need_verified=False).collect()}
    assert steps["none"] == (False, 4) and steps["ident"] == (False, 4)
    for bad in ({"a": 0.0}, {"a": float("nan")}, {"a": 2e6}, {"a": 1e-12}):
        with pytest.raises(ValueError):
            voting.integer_weights(bad, 0.25)
    with pytest.raises(ValueError):
        voting.with_budget(df, budgets=(4, 1))


def test_statistics(spark):
    for a, b in ((0, 0), (3, 5), (1, 30), (400, 420), (2000, 2600)):
        n, k = a + b, min(a, b)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert evaluation.mcnemar_p(a, b) == pytest.approx(want, rel=1e-12)
    big = evaluation.mcnemar_p(2600, 2700)
    assert big == pytest.approx(min(1.0, 2 * sum(math.comb(5300, i) for i in range(2601)) / 2**5300), rel=1e-9)
    p = spark.createDataFrame([("b", 0.03), ("a", 0.01), ("c", 0.04)], "hypothesis string, p_value double")
    got = {r.hypothesis: (round(r.adjusted_p, 9), r.reject) for r in evaluation.holm(p).collect()}
    assert got == {"a": (0.03, True), "b": (0.06, False), "c": (0.06, False)}


def test_bootstrap(spark):
    rows = spark.createDataFrame([(str(i), i % 4 == 0, i % 3 == 0) for i in range(900)], "id string, a_ok boolean, b_ok boolean")
    groups = rows.select("id", F.concat(F.lit("g"), (F.col("id").cast("int") % 211).cast("string")).alias("group_id"))
    profile = evaluation.group_profile(rows, groups)
    deltas = evaluation.bootstrap_deltas(profile, 4000, seed=5)
    x = np.sort([r.delta for r in deltas.collect()])
    assert len(x) == 4000 and np.array_equal(x, np.sort([r.delta for r in evaluation.bootstrap_deltas(profile, 4000, seed=5).collect()]))
    data = rows.join(groups, "id").toPandas()
    by = data.assign(d=data.b_ok.astype(int) - data.a_ok.astype(int)).groupby("group_id").d.agg(["sum", "size"]).to_numpy()
    rng = np.random.default_rng(1)
    at = rng.integers(0, len(by), (4000, len(by)))
    plain = np.sort(by[at, 0].sum(1) / by[at, 1].sum(1))
    for q in (0.025, 0.5, 0.975):
        assert np.quantile(x, q) == pytest.approx(np.quantile(plain, q), abs=0.008)
    ci = evaluation.bootstrap_ci(deltas).first()
    assert ci.ci_low == pytest.approx(np.quantile(x, 0.025)) and ci.ci_high == pytest.approx(np.quantile(x, 0.975))
    two = spark.createDataFrame([("a", False, True), ("b", False, True), ("c", True, False), ("d", True, False)], "id string, a_ok boolean, b_ok boolean")
    pair = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "id string, group_id string")
    assert tuple(evaluation.bootstrap_ci(evaluation.bootstrap_deltas(evaluation.group_profile(two, pair), 1000)).first()) == (-1.0, 1.0)
    with pytest.raises(Exception, match="no group"):
        evaluation.group_profile(two, pair.limit(1)).collect()


def test_exact_match(spark):
    gold = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "id string, gold string")
    pred = spark.createDataFrame([("a", "1"), ("b", "02"), ("c", "5"), ("x", "1")], "id string, prediction string")
    rows = evaluation.graded(gold, pred)
    assert {r.id: r.outcome for r in rows.collect()} == {"a": "correct", "b": "invalid", "c": "wrong", "d": "missing", "x": "extra"}
    r = evaluation.exact_match(rows).first()
    assert (r.total, r.correct, r.incorrect, r.accuracy) == (4, 1, 3, 0.25)


def test_submissions(spark):
    expected = spark.createDataFrame([(0, "p1"), (1, "p2"), (2, "p3")], "ord long, id string")
    check = lambda rows: {(r.id, r.code) for r in validation.submission_issues(spark.createDataFrame(rows, "ord long, id string, answer string"), expected).collect()}
    assert check([(0, "p1", "1"), (1, "p2", "-2"), (2, "p3", "0")]) == set()
    assert check([(0, "p2", "1"), (1, "p1", "2"), (2, "p3", "3")]) == {(None, "id_order")}
    assert check([(0, "p1", "01"), (1, "p1", "1"), (2, "zz", None), (3, None, "1")]) == {("p1", "noncanonical_answer"), ("zz", "noncanonical_answer"), ("p1", "duplicate_ids"), ("p2", "missing_ids"), ("p3", "missing_ids"), ("zz", "extra_ids"), (None, "null_id"), (None, "row_count")}
    # Rows without an id don't shift the places of the others: no id_order beside a row too many.
    assert check([(0, None, "1"), (1, "p1", "1"), (2, "p2", "2"), (3, "p3", "3")]) == {(None, "null_id"), (None, "row_count")}
    assert check([(0, "", "1"), (1, "p2", "1"), (2, "p1", "2"), (3, "p3", "3")]) == {("", "null_id"), (None, "row_count"), (None, "id_order")}
    pred = spark.createDataFrame([("p1", "5"), ("p2", "x")], "id string, prediction string")
    assert {r.id: (r.answer, r.provenance, r.reason) for r in validation.resolve(pred, expected, fallback="0").collect()} == {"p1": ("5", "prediction", None), "p2": ("0", "emergency_fallback", "invalid_prediction"), "p3": ("0", "emergency_fallback", "missing_prediction")}
    assert {r.answer for r in validation.resolve(pred, expected, resolver=lambda i, p, why: F.length(i).cast("string")).collect()} == {"5", "2"}
    with pytest.raises(Exception, match="unresolved"):
        validation.resolve(pred, expected).collect()
    with pytest.raises(ValueError):
        validation.resolve(pred, expected, fallback="0", resolver=lambda *a: a[0])
    with pytest.raises(ValueError):
        validation.resolve(spark.createDataFrame([("q", "1")], pred.schema), expected, fallback="0")


@pytest.mark.parametrize("places", [1, 2, 65_536])
def test_submission_lines(spark, monkeypatch, places):
    monkeypatch.setattr(validation, "PLACES", places)
    expected = spark.createDataFrame([(0, "p1"), (1, "p2"), (2, "p3")], "ord long, id string")

    def check(*lines):
        rows = spark.createDataFrame(list(enumerate(lines)), "ord long, raw string")
        return sorted((r.id or "", r.code, r.row_number or 0) for r in validation.submission_line_issues(rows, expected).collect())

    line = '{{"id":"{}","answer":{}}}'.format
    assert check(line("p1", 1), line("p2", "-0"), line("p3", '"-12"')) == []
    assert check(line("p1", "1" * 45), line("p3", 1), line("p2", 1)) == [("", "id_order", 3)]
    assert check("[1]", line("p1", 1), line("p3", 1), line("p2", 1), None) == [("", "id_order", 3), ("", "row_count", 0), ("", "row_type", 2), ("", "row_type", 6)]
    assert check('{"id":"p1","id":"p1","answer":1}', "no", line("p3", "true")) == [("", "row_type", 2), ("", "row_type", 3), ("p1", "missing_ids", 0), ("p2", "missing_ids", 0), ("p3", "noncanonical_answer", 4)]
    assert check('{"answer":1,"id":"p1"}', '{"id":"p2"}', '{"id":5,"answer":"05"}') == [("", "id_type", 4), ("p1", "row_schema", 2), ("p2", "noncanonical_answer", 3), ("p2", "row_schema", 3), ("p3", "missing_ids", 0)]
    assert check('{"id":"","answer":1}', line("p1", "1.0"), line("p1", "null")) == [("", "null_id", 2), ("p1", "duplicate_ids", 0), ("p1", "noncanonical_answer", 3), ("p1", "noncanonical_answer", 4), ("p2", "missing_ids", 0), ("p3", "missing_ids", 0)]
    none = spark.createDataFrame([], "ord long, raw string")
    assert {r.code for r in validation.submission_line_issues(none, expected).collect()} == {"missing_ids", "row_count"}


def test_workflow_status(spark):
    schema = "k string, stage string, ledger_state string, completed long, total long, contract_sha256 string, completion_sha256 string"
    a, b = "a" * 64, "b" * 64
    rows = [("1", "development_generation", "interrupted", 3, 9, a, b), ("2", "fold_training", "complete", 0, 0, a, b), ("3", "fold_training", "terminal_failed", 5, 9, a, None)]
    got = {r.k: r for r in ledger.workflow_status(spark.createDataFrame(rows, schema)).collect()}
    assert (got["1"].state, got["1"].completed_count, got["1"].total_count, got["1"].artifact_sha256, got["1"].next_action) == ("retryable", 3, 9, a, "resume_development")
    assert (got["2"].terminal, got["2"].completed_count, got["2"].total_count, got["2"].artifact_sha256) == (True, 1, 1, b)
    assert (got["3"].blockers, got["3"].completed_count, got["3"].artifact_sha256) == (["no_complete_resume_checkpoint"], 0, a)
    for stage, state in (("fold_training", "planned"), ("other", "ready"), ("fold_training", None)):
        with pytest.raises(Exception, match="unsupported state"):
            ledger.workflow_status(spark.createDataFrame([("1", stage, state, 1, 1, a, b)], schema)).collect()
    sound = ledger.workflow_status(spark.createDataFrame(rows, schema))
    assert ledger.workflow_issues(sound, "k").count() == 0
    odd = sound.where("k = '1'").withColumns({"stage": F.lit(None).cast("string"), "state": F.lit("done"), "next_action": F.lit(" x"), "terminal": F.lit(None).cast("boolean"), "completed_count": F.lit(10), "blockers": F.array(F.lit(None).cast("string")), "artifact_sha256": F.lit("A" * 64)})
    assert {r.code for r in ledger.workflow_issues(odd, "k").collect()} == {"stage", "state", "next_action", "flags", "counts", "blockers", "artifact_sha256"}


def test_joins(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", None)], "id string, fp string")
    assert joins.duplicate_summary(a, "fp").first().asDict() == {"group_count": 1, "row_count": 2, "max_group_size": 2}
    assert joins.duplicate_summary(a.limit(0), "fp").first().asDict() == {"group_count": 0, "row_count": 0, "max_group_size": 1}
    runs = spark.createDataFrame([("p", "1", "5", 0), ("q", "1", None, 0), ("p", "2", None, 1), ("q", "2", "6", 1)], "label string, id string, prediction string, fold int")
    got = {(r.a, r.b, r.id): (r.prediction, r.used) for r in joins.all_routes(runs).collect()}
    assert got == {("p", "q", "1"): ("5", "primary"), ("q", "p", "1"): ("5", "fallback"), ("p", "q", "2"): ("6", "fallback"), ("q", "p", "2"): ("6", "primary")}
    assert joins.ordered_pairs(["a", "b"]) == [("a", "b"), ("b", "a")]
    assert {tuple(r) for r in joins.missing_cells(runs, ["p", "z"], 2).collect()} == {("z", 0), ("z", 1)}
    with pytest.raises(Exception, match="more than one fold"):
        joins.pool([runs, runs.limit(1)]).collect()
    rows, issues = joins.bank_subset([a.withColumnRenamed("id", "problem_id")] * 2, spark.createDataFrame([("1",), ("9",)], "problem_id string"))
    assert rows.count() == 2 and {tuple(r) for r in issues.collect()} == {("1", "duplicate"), ("2", "duplicate"), ("3", "duplicate"), ("4", "duplicate"), ("9", "missing")}


def test_ledger(spark):
    attempts = spark.createDataFrame([(0, 1, ["a", "b"], "parsed", True, 1.5, {"k": 1}), (0, 2, ["b"], "failed", None, 2.5, {"k": 2, "z": 5}), (1, 1, ["c"], "parsed", False, 1.0, {})], "chunk_index int, attempt_number int, input_ids array<string>, status string, assessed boolean, latency_ms double, usage map<string,bigint>")
    results = spark.createDataFrame([("a", "accepted", 1), ("b", "rejected", 1)], "problem_id string, status string, attempt_number int")
    plan = spark.createDataFrame([(x,) for x in "abcd"], "problem_id string")
    got = {r.problem_id: (r.n_attempts, r.state, r.next_action) for r in ledger.states(plan, attempts, results, 2).collect()}
    assert got == {"a": (1, "accepted", "done"), "b": (2, "exhausted", "review"), "c": (1, "unassessed", "assess"), "d": (0, "pending", "retry")}
    assert {tuple(r) for r in ledger.usage_totals(attempts).collect()} == {("k", 3), ("z", 5)}
    assert ledger.first_pass(attempts, results).first().asDict() == {"n_first": 3, "n_accepted": 1}
    assert ledger.audit_verdict(spark.range(64).select((F.col("id") > 3).alias("consistent"))).first().passed
    assert not ledger.audit_verdict(spark.range(64).select((F.col("id") > 4).alias("consistent"))).first().passed
    assert aggregates.top_answers(spark.createDataFrame([(0, "5"), (0, "3"), (None, "9")], "fold int, answer string"), n=1).collect()[0].answer == 3
    assert validation.leaks(spark.createDataFrame([(1, 2)], "n_rows int, gold_answer int")) == ["gold_answer"]


def test_unreadable_primaries_are_routed(spark):
    runs = spark.createDataFrame([("p", "1", "0123"), ("p", "2", None), ("p", "3", "4"), ("q", "1", "5"), ("q", "2", "+6"), ("q", "3", "8")], "label string, id string, prediction string")
    p, q = (runs.where(f"label = '{x}'") for x in "pq")
    assert {r.id: (r.prediction, r.used) for r in joins.route(p, q).collect()} == {"1": ("5", "fallback"), "2": (None, "none"), "3": ("4", "primary")}
    gold = spark.createDataFrame([("1", "5"), ("2", "6"), ("3", "4"), ("4", "9")], "id string, gold string")
    got = {r.hypothesis: (r.total, r.only_a, r.only_b, r.n_resolved, round(r.adjusted_p, 6)) for r in evaluation.compare_family(gold, runs, "p", ["p", "q"]).collect()}
    assert got == {"candidate:q": (4, 1, 1, 0, 1.0), "fallback_on_invalid:p->q": (4, 0, 1, 1, 1.0), "fallback_on_invalid:q->p": (4, 0, 0, 0, 1.0)}


def test_digests_in_either_case_are_one_identity(spark):
    row = ("p", 0, "Final answer: 3", 1, "r", False, None, 0, "ab" * 32, "cd" * 32, "ef" * 32)
    rows = [row, ("p", 1, "Final answer: 4", *row[3:8], *(x.upper() for x in row[8:]))]
    df = spark.createDataFrame(rows, "problem_id string, ord long, completion string, seed long, route string, greedy boolean, verifier_passed boolean, sample_index int, prompt_sha256 string, checkpoint_sha256 string, generation_config_sha256 string")
    assert [r.exclusion for r in voting.evaluate_candidates(df).orderBy("ord").collect()] == [None, "duplicate_generation_identity"]
    assert voting.identity_conflicts(df).first().n_variants == 2


def test_answers_of_any_length(spark):
    values = ["5", "5", "-3", "0", "9" * 25, "9" * 60, "1" + "0" * 60, "-" + "8" * 60, "-" + "9" * 60, "-" + "1" * 45, "10", "100", "1000", "1000000", "-1000000000000"]
    df = spark.createDataFrame([(0, v) for v in values] + [(0, None)], "fold int, answer string").repartition(3)
    r = aggregates.answer_summary(df, as_text=True).first()
    ints = sorted(map(int, values))
    assert (int(r.minimum), int(r.maximum), int(r.abs_min), int(r.abs_max), r.most_common_answer, r.most_common_count) == (ints[0], ints[-1], 0, max(map(abs, ints)), "5", 2)
    assert (r.unique_count, r.negative_count, r.zero_count, r.positive_count) == (14, 5, 1, 9)
    assert (r.abs_le_10_count, r.abs_le_100_count, r.abs_le_1000_count, r.abs_ge_1e6_count, r.abs_ge_1e12_count) == (5, 6, 7, 8, 7)
    assert aggregates.answer_summary(df).first().minimum is None
    top = [x.answer for x in aggregates.top_answers(df.where("answer IS NOT NULL"), n=20, as_text=True).orderBy("place").collect()]
    assert top == ["5", *(str(i) for i in ints if i != 5)]
    assert aggregates.answer_summary(df.limit(0)).first().unique_count == 0


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_exact_sums_equal_fsum(spark, parts):
    import math

    rng = np.random.default_rng(2)
    x = (rng.standard_normal(3000) * 10.0 ** rng.integers(-300, 300, 3000)).tolist() + [1e308, -1e308, 5e-324, -5e-324, 0.1, 0.2, 0.3, 1e16, 1.0, -1e16, 0.0, -0.0]
    small = rng.random(500).tolist()
    df = spark.createDataFrame([("a", v) for v in x] + [("b", v) for v in small] + [("c", None), ("d", float("inf")), ("d", 1.0), (None, 2.5)], "k string, v double").repartition(parts)
    got = {r.k: r.total for r in aggregates.exact_sum(df, "v", ["k"]).collect()}
    assert got == {"a": math.fsum(x), "b": math.fsum(small), "d": float("inf"), None: 2.5}
    assert aggregates.exact_sum(df.where("k = 'b'"), "v").first().total == math.fsum(small)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_digests_of_sequences(spark, parts):
    import hashlib
    import json

    rows = [(i, i * 7 % 50, None if i % 9 == 0 else f'ü "{i}"\n') for i in range(200)]
    got = aggregates.sequence_sha256(spark.createDataFrame(rows, "i int, seed int, said string").repartition(parts), ["i"], ["seed", "said"]).collect()
    digest = lambda k: hashlib.sha256(json.dumps([r[k] for r in rows], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert [tuple(r) for r in got] == [("seed", 200, digest(1)), ("said", 200, digest(2))]
    assert aggregates.sequence_sha256(spark.createDataFrame([], "i int, seed int"), ["i"], ["seed"]).collect() == []


def test_redaction(spark):
    secrets = spark.createDataFrame([("id", "train-000001"), ("id", "train-000002"), ("answer", "123456"), ("answer", "5"), ("text", "What is this, and why?"), ("text", None), ("id", "train-0")], "kind string, value string")
    said = [("clean 0123456", 1234567, ["train-0000010"], None), ("(train-000001)", 123456, ["a", "train-000002"], 5), ("Q: What is this, and why? A", 7, [], 5), ("train-000001", 8, ["strain-000002"], 5)]
    report = spark.createDataFrame(said, "note string, `n.x` long, list array<string>, five long")
    assert {tuple(r) for r in validation.redaction_issues(report, secrets).collect()} == {("id", "note", 1, 2), ("answer", "n.x", 1, 1), ("id", "list", 1, 1), ("text", "note", 1, 1)}
    assert validation.redaction_issues(report.limit(0), secrets).collect() == [] and validation.redaction_issues(report, secrets.limit(0)).collect() == []
