"""Out-of-fold evidence: checks that runs cover every fold, comparisons over the pooled folds, and the qualification of a base run.

Tables: ``split`` (id, group_id, fold; a null fold is the sealed holdout), ``gold`` (id, gold), ``runs`` (label, fold, id,
prediction), ``evidence`` with a row for each run (label, fold, run_sha256, manifest_sha256, fingerprint, adapter_sha256,
provenance_sha256), ``excluded`` (id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import is_canonical_integer
from sievelight.operators import evaluation
from sievelight.operators.joins import exclude
from sievelight.session import settled, spread


def eligible(split: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(id, group_id, fold) of the rows that some fold validates."""
    rows = split.where("fold IS NOT NULL").select("id", "group_id", F.col("fold").cast("int").alias("fold"))
    return exclude(rows, excluded) if excluded is not None else rows


def coverage_issues(runs: DataFrame, wanted: DataFrame, labels: list[str]) -> DataFrame:
    """(label, id, code): ids that a label misses, repeats, holds without need, or holds in another fold than theirs.

    Rows of undeclared labels are ``undeclared_label``, whatever their ids.
    """
    declared = F.col("label").isin(*labels)
    none = F.lit(None).cast("int")
    rows = spread(runs.select("id", "label", F.col("fold").cast("long").alias("fold")), "id")
    of = {x: F.col("label") == x for x in labels}
    # One row for each id, with what every label holds of it: labels share the grouping and the join.
    held = F.array(*(F.struct(F.lit(x).alias("label"), F.count_if(c).alias("n"), F.min(F.when(c, F.col("fold"))).alias("lo"), F.max(F.when(c, F.col("fold"))).alias("hi")) for x, c in of.items()))
    have = rows.where(declared).groupBy("id").agg(held.alias("held"))
    nothing = F.array(*(F.struct(F.lit(x).alias("label"), F.lit(0).cast("long").alias("n"), none.cast("long").alias("lo"), none.cast("long").alias("hi")) for x in labels))
    met = wanted.select("id", "fold", F.lit(True).alias("wanted")).join(have, "id", "full_outer").select("id", "fold", "wanted", F.explode(F.coalesce("held", nothing)).alias("h")).select("id", "fold", "wanted", "h.*")
    off = ~(F.col("lo").eqNullSafe(F.col("fold")) & F.col("hi").eqNullSafe(F.col("fold")))
    got = F.col("n") > 0
    codes = F.array_compact(F.array(F.when(~got & F.col("wanted"), "missing"), F.when(got & F.col("fold").isNull(), "extra"), F.when(F.col("n") > 1, "duplicate"), F.when(got & F.col("fold").isNotNull() & off, "wrong_fold")))
    out = met.select("label", "id", F.explode(codes).alias("code"))
    return out.unionByName(runs.where(~F.coalesce(declared, F.lit(False))).select("label", "id", F.lit("undeclared_label").alias("code")))


def evidence_issues(evidence: DataFrame, labels: list[str], reference: str, folds: int) -> DataFrame:
    """(label, fold, code) of the runs: every declared label once on every fold, no run or adapter used twice, one method for each label.

    The reference is a fixed base, so it has no adapter; every candidate has one.
    """
    spark = evidence.sparkSession
    cells = spark.createDataFrame([(a, f) for a in labels for f in range(folds)], "label string, fold int").withColumn("want", F.lit(True))
    rows = evidence.withColumn("fold", F.col("fold").cast("int"))
    per = rows.groupBy("label", "fold").agg(F.count("*").alias("n"))
    code = F.when(F.col("n").isNull(), "missing_run").when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "undeclared_label").when(F.col("want").isNull(), "fold_range").when(F.col("n") > 1, "duplicate_run")
    out = cells.join(per, ["label", "fold"], "full_outer").select("label", "fold", code.alias("code"))
    held = F.col("adapter_sha256").isNotNull()
    kind = F.when((F.col("label") == reference) & held, "adapter_unexpected").when((F.col("label") != reference) & ~held, "adapter_missing")
    out = out.unionByName(rows.select("label", "fold", kind.alias("code")))
    for keys, name in ((["run_sha256", "manifest_sha256"], "reused_run"), (["adapter_sha256"], "reused_adapter")):
        twice = rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count_distinct("label", "fold").alias("cells")).where("cells > 1").drop("cells")
        out = out.unionByName(rows.join(twice, keys, "left_semi").select("label", "fold", F.lit(name).alias("code")))
    mixed = rows.groupBy("label").agg(F.count_distinct("fingerprint").alias("n"), F.count_if(F.col("fingerprint").isNull()).alias("none")).where("n > 1 OR none > 0")
    out = out.unionByName(mixed.select("label", F.lit(None).cast("int").alias("fold"), F.lit("mixed_fingerprints").alias("code")))
    return out.where("code IS NOT NULL").distinct()


def _cases(labels: list[str], reference: str) -> dict[str, tuple[Column, Column, Column, Column]]:
    """For each hypothesis: what its first and second method say, whether the fallback was asked, whether it answered."""
    said = {x: F.when(is_canonical_integer(F.col("said")[x]), F.col("said")[x]) for x in labels}
    never = F.lit(False)
    out = {f"candidate:{x}": (said[reference], said[x], never, never) for x in labels if x != reference}
    for x in labels:
        for y in labels:
            if x != y:
                out[f"fallback_on_invalid:{x}->{y}"] = (said[x], F.coalesce(said[x], said[y]), said[x].isNull(), said[x].isNull() & said[y].isNotNull())
    return out


def pooled(gold: DataFrame, runs: DataFrame, wanted: DataFrame, labels: list[str], reference: str) -> DataFrame:
    """(id, group_id, fold, cases): an array with the outcome of each hypothesis for every eligible id; all runs of an id meet once."""
    per_id = runs.where(F.col("label").isin(*labels)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "prediction"))).alias("said"))  # one entry for each label
    rows = wanted.join(gold.select("id", "gold"), "id", "left").join(per_id, "id", "left")
    g = F.when(F.col("gold").isNull(), F.raise_error(F.lit("an eligible id has no gold answer"))).otherwise(F.col("gold"))
    rows = rows.withColumn("gold", g)
    ok = lambda c: F.coalesce(c == F.col("gold"), F.lit(False))
    cases = [F.struct(F.lit(name).alias("hypothesis"), ok(a).alias("a_ok"), ok(b).alias("b_ok"), asked.alias("asked"), got.alias("answered")) for name, (a, b, asked, got) in _cases(labels, reference).items()]
    return rows.select("id", "group_id", "fold", F.array(*cases).alias("cases"))


def stratified_profile(rows: DataFrame) -> DataFrame:
    """(fold, size, sums, n): how many groups of a fold have this size and this sum of differences for each hypothesis.

    A group that lies in two folds raises: the folds wouldn't be independent.
    """
    d = F.transform("cases", lambda c: c["b_ok"].cast("long") - c["a_ok"].cast("long"))
    width = rows.select(F.size("cases").alias("n")).first()
    if width is None:
        raise ValueError("there is nothing to draw from")
    flat = rows.select("group_id", "fold", *(d[i].alias(f"d{i}") for i in range(width[0])))
    groups = flat.groupBy("group_id").agg(F.min("fold").alias("fold"), F.max("fold").alias("other"), F.count("*").alias("size"), F.array(*(F.sum(f"d{i}") for i in range(width[0]))).alias("sums"))
    one = F.when((F.col("fold") != F.col("other")) | F.col("group_id").isNull(), F.raise_error(F.lit("a group lies in more than one fold"))).otherwise(F.col("fold"))
    return groups.select(one.alias("fold"), "size", "sums").groupBy("fold", "size", "sums").agg(F.count("*").alias("n"))


def stratified_deltas(profile: DataFrame, samples: int = 10_000, seed: int = 0, block: int = 500) -> DataFrame:
    """(sample, deltas): resamples of whole groups, each fold by itself, the same draw for every hypothesis.

    Groups of a fold that are alike in all hypotheses are drawn together, so a resample is one multinomial draw for each
    fold over the distinct rows of the profile; a block of samples has a random stream of its own.
    """
    spark = profile.sparkSession
    profile = settled(profile)
    if profile.limit(evaluation.MAX_PROFILE + 1).count() > evaluation.MAX_PROFILE:
        return _parted_deltas(profile, samples, seed)
    kinds = profile.orderBy("fold", "size", "sums").collect()  # at most MAX_PROFILE rows
    if not kinds:
        raise ValueError("there is nothing to draw from")
    by_fold: dict[int, list] = {}
    for k in kinds:
        by_fold.setdefault(k["fold"], []).append(k)
    strata = [(np.array([k["n"] for k in x], np.int64), np.array([k["size"] for k in x], np.int64), np.array([k["sums"] for k in x], np.int64)) for x in by_fold.values()]
    shared = spark.sparkContext.broadcast(strata)  # at most MAX_PROFILE rows
    rows = max(1, min(block, 2_000_000 // len(kinds)))

    def draw(batches):
        for frame in batches:
            for at in frame["id"].tolist():
                rng, k = np.random.default_rng([seed, at]), min(rows, samples - at * rows)
                total, size = 0, 0
                for n, sizes, sums in shared.value:
                    counts = rng.multinomial(int(n.sum()), n / n.sum(), size=k)
                    total, size = total + counts @ sums, size + counts @ sizes
                yield pd.DataFrame({"sample": np.arange(at * rows, at * rows + k), "deltas": list(total / size[:, None])})

    blocks = -(-samples // rows)
    return spark.range(0, blocks, 1, min(blocks, spark.sparkContext.defaultParallelism)).mapInPandas(draw, "sample long, deltas array<double>")


#: Parts of a profile that has too many rows for one task.
PARTS = 128


def _parted_deltas(profile: DataFrame, samples: int, seed: int) -> DataFrame:
    """``stratified_deltas`` of a profile of any size: the same distribution, by draws in two steps.

    A fold's groups first fall to the parts of its profile, then to the rows of each part; a multinomial draw is made of
    such draws exactly. Every task draws the first step over from the streams of (seed, fold), so parts agree without
    meeting, and gives the sums of its part for every sample. The driver and the tasks share the parts' totals alone.
    """
    kinds = profile.withColumn("part", F.pmod(F.xxhash64("fold", "size", "sums"), F.lit(PARTS)).cast("int"))
    totals = {}
    for r in kinds.groupBy("fold", "part").agg(F.sum("n").alias("n")).collect():  # at most PARTS rows a fold
        totals.setdefault(r["fold"], {})[r["part"]] = r["n"]
    shared = {fold: (sorted(x), np.array([x[p] for p in sorted(x)], np.int64)) for fold, x in totals.items()}

    def draw(key, frame):
        fold, part = (int(x) for x in key)
        parts, n = shared[fold]
        own = np.random.default_rng([seed, fold + 1]).multinomial(int(n.sum()), n / n.sum(), size=samples)[:, parts.index(part)]
        frame = frame.assign(k=[tuple(x) for x in frame["sums"]]).sort_values(["size", "k"])
        sums, sizes, rows = np.array(frame["k"].tolist(), np.int64), frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        rng, step, out = np.random.default_rng([seed, fold + 1, part + 1]), max(1, 2_000_000 // len(rows)), []
        for at in range(0, samples, step):
            counts = rng.multinomial(own[at : at + step], rows / rows.sum())
            out.append(np.column_stack([counts @ sizes, counts @ sums]))
        return pd.DataFrame({"sample": np.arange(samples), "s": list(np.concatenate(out))})

    drawn = kinds.groupBy("fold", "part").applyInPandas(draw, "sample long, s array<long>")
    width = profile.select(F.size("sums")).first()[0]
    summed = drawn.groupBy("sample").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width + 1)))
    return summed.select("sample", F.array(*(F.col(f"s{i}") / F.col("s0") for i in range(1, width + 1))).alias("deltas"))


def compare_out_of_fold(gold: DataFrame, runs: DataFrame, split: DataFrame, reference: str, candidates: list[str], excluded: DataFrame | None = None, samples: int = 10_000, confidence: float = 0.95, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """One row for each hypothesis over the union of all folds: cells, accuracies, exact p, Holm's step over the whole family, the interval.

    ``candidate:x`` compares run x with the reference; ``fallback_on_invalid:x->y`` compares run x, helped by y where x
    says nothing that can be read, with x alone (asked, answered and unanswered count those ids). Intervals come from
    ``stratified_deltas``. Incomplete or repeated runs raise: a comparison needs every label on every eligible id.
    """
    labels = [reference, *candidates]
    if len(set(labels)) != len(labels) or not candidates:
        raise ValueError("the reference and at least one candidate need labels of their own")
    wanted = eligible(split, excluded)
    bad = coverage_issues(runs, wanted, labels).limit(5).collect()
    if bad:
        raise ValueError(f"runs must cover every eligible id once, in its fold: {[tuple(r) for r in bad]}")
    rows = settled(pooled(gold, runs, wanted, labels, reference))
    each = rows.select(F.posexplode("cases").alias("place", "h")).select("place", "h.*")
    more = each.groupBy("hypothesis").agg(F.first("place").alias("place"), F.count_if("asked").alias("n_asked"), F.count_if("answered").alias("n_answered"), F.count_if(F.col("asked") & ~F.col("answered")).alias("n_unanswered"))
    tested = evaluation.mcnemar(evaluation.contingency(each, ["hypothesis"])).join(more, "hypothesis")
    tail = (1 - confidence) / 2
    deltas = stratified_deltas(stratified_profile(rows), samples, seed).select(F.posexplode("deltas").alias("place", "delta"))
    ends = deltas.groupBy("place").agg(F.percentile("delta", tail).alias("ci_low"), F.percentile("delta", 1 - tail).alias("ci_high"))
    return evaluation.holm(tested.join(ends, "place").drop("place"), None, alpha)


#: Folds that the qualification of a base run asks for.
BASE_FOLDS = 5


def qualify_base(gold: DataFrame, runs: DataFrame, evidence: DataFrame, split: DataFrame, fingerprint: str, excluded: DataFrame | None = None, by: str = "label") -> DataFrame:
    """One row for each value of ``by`` (a column of runs and evidence): is this a complete, unmixed base run over all folds?

    It is if exactly ``BASE_FOLDS`` runs stand for the folds 0, 1, ... once each, without adapters, from different files,
    all under one execution provenance and the fixed method ``fingerprint``, and if their rows hold every eligible id
    exactly once and in its fold, and nothing else. This is a relational division: ids are counted by what holds for
    them, and the counts are compared with the number of eligible ids, so no set is gathered.
    """
    wanted = eligible(split, excluded).join(gold.select("id", "gold"), "id", "left")
    n_wanted = wanted.agg(F.count("*").alias("n_eligible"), F.max("fold").alias("last"), F.min("fold").alias("first"), F.count_distinct("fold").alias("n_split_folds"))
    per_id = runs.groupBy(by, "id").agg(F.count("*").alias("n"), F.min("fold").alias("lo"), F.max("fold").alias("hi"), F.min("prediction").alias("prediction"))
    met = per_id.join(wanted, "id", "left")
    here = F.col("fold").isNotNull()
    placed = here & (F.col("lo") == F.col("fold")) & (F.col("hi") == F.col("fold"))
    counts = met.groupBy(by).agg(
        F.count_if(here).alias("n_held"), F.count_if(~here).alias("n_extra"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(here & ~F.coalesce(placed, F.lit(False))).alias("n_misplaced"),
        F.count_if(here & (F.col("n") == 1) & evaluation.is_correct(F.col("prediction"), F.col("gold"))).alias("exact_match_count"),
    )
    fold = F.col("fold").cast("int")
    proof = evidence.groupBy(by).agg(
        F.count("*").alias("n_runs"), F.count_distinct(F.when(fold.between(0, BASE_FOLDS - 1), fold)).alias("n_folds"), F.count_distinct("run_sha256", "manifest_sha256").alias("n_files"),
        F.count_distinct("provenance_sha256").alias("n_provenances"), F.min("provenance_sha256").alias("provenance_sha256"), F.count_if(F.col("provenance_sha256").isNull()).alias("n_unproven"),
        F.count_if(F.col("adapter_sha256").isNotNull() | ~F.col("fingerprint").eqNullSafe(F.lit(fingerprint))).alias("n_other_methods"),
    )
    out = proof.join(counts, by, "full_outer").fillna(0)
    (n, last, first_, folds) = n_wanted.first()
    sound_split = bool(n) and (first_, last, folds) == (0, BASE_FOLDS - 1, BASE_FOLDS)
    rules = {
        "exact_fold_coverage": (F.col("n_runs") == BASE_FOLDS) & (F.col("n_folds") == BASE_FOLDS) & F.lit(sound_split) & (F.col("n_held") == n) & (F.col("n_extra") == 0) & (F.col("n_misplaced") == 0),
        "validation_ids_unique": F.col("n_repeated") == 0,
        "run_evidence_unique": F.col("n_files") == F.col("n_runs"),
        "execution_provenance_consistent": (F.col("n_provenances") == 1) & (F.col("n_unproven") == 0),
        "fixed_base_only": F.col("n_other_methods") == 0,
    }
    out = out.withColumns(rules)
    whole = F.lit(True)
    for rule in rules:
        whole = whole & F.col(rule)
    provenance = F.when(F.col("execution_provenance_consistent"), F.col("provenance_sha256"))
    return out.select(by, *rules, whole.alias("qualified"), provenance.alias("execution_provenance_sha256"), F.lit(n).cast("long").alias("oof_problem_count"), "exact_match_count", F.round(F.col("exact_match_count") / F.lit(n or None), 9).alias("accuracy"))
