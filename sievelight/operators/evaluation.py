"""Exact-match scores, paired comparisons and their statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sievelight.functions.text import is_canonical_integer
from sievelight.session import spread


def graded(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, gold, prediction, outcome) over both tables (id, gold) and (id, prediction).

    outcome: correct, wrong, invalid (not a canonical integer), missing (no prediction), extra (no gold).
    """
    a, b = gold.select("id", "gold", F.lit(True).alias("has_gold")), predictions.select("id", "prediction", F.lit(True).alias("has_prediction"))
    outcome = F.when(F.col("has_gold").isNull(), "extra").when(F.col("has_prediction").isNull(), "missing").when(~is_canonical_integer(F.col("prediction")), "invalid").when(F.col("prediction") == F.col("gold"), "correct").otherwise("wrong")
    return a.join(b, "id", "full_outer").select("id", "gold", "prediction", outcome.alias("outcome"))


def exact_match(rows: DataFrame) -> DataFrame:
    """One row of counts and the accuracy, from ``graded``; the denominator is the gold ids."""
    n = lambda *x: F.count_if(F.col("outcome").isin(*x))
    out = rows.agg(n("correct", "wrong", "invalid", "missing").alias("total"), n("correct").alias("correct"), n("missing").alias("missing"), n("extra").alias("extra"), n("invalid").alias("invalid"), n("wrong", "invalid", "missing").alias("incorrect"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 9))


def is_correct(prediction: Column, gold: Column) -> Column:
    return is_canonical_integer(prediction) & F.coalesce(prediction == gold, F.lit(False))


def paired(gold: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, a_ok, b_ok) of every gold id; a missing or invalid prediction is wrong."""
    rows = gold.select("id", "gold").join(a.select("id", F.col("prediction").alias("pa")), "id", "left").join(b.select("id", F.col("prediction").alias("pb")), "id", "left")
    return rows.select("id", is_correct(F.col("pa"), F.col("gold")).alias("a_ok"), is_correct(F.col("pb"), F.col("gold")).alias("b_ok"))


def contingency(rows: DataFrame, by: list[str] | None = None, weight: str | None = None, **more: Column) -> DataFrame:
    """Counts of both, only_a, only_b and neither, with accuracies and their difference, for each value of ``by``.

    A row stands for as many as its column ``weight`` says; ``more`` names conditions whose rows are counted too.
    """
    a, b = F.col("a_ok"), F.col("b_ok")

    def count(cond: Column | None = None) -> Column:
        if weight is None:
            return F.count("*") if cond is None else F.count_if(cond)
        return F.coalesce(F.sum(weight if cond is None else F.when(cond, F.col(weight))), F.lit(0))

    out = rows.groupBy(*(by or [])).agg(count().alias("total"), count(a & b).alias("both"), count(a & ~b).alias("only_a"), count(~a & b).alias("only_b"), count(~a & ~b).alias("neither"), *(count(c).alias(name) for name, c in more.items()))
    return out.withColumns({"accuracy_a": F.round((F.col("both") + F.col("only_a")) / F.col("total"), 9), "accuracy_b": F.round((F.col("both") + F.col("only_b")) / F.col("total"), 9), "delta": F.round((F.col("only_b") - F.col("only_a")) / F.col("total"), 9)})


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact two-sided p: twice the lower binomial tail, at most 1.

    Exact integers up to 5,000 discordant pairs. Beyond, log-gamma terms from the largest down; those more than 40
    root n below it are under 1e-1000 of the sum.
    """
    n, k = only_a + only_b, min(only_a, only_b)
    if n == 0:
        return 1.0
    if n <= 5_000:
        term = tail = 1
        for i in range(1, k + 1):
            term = term * (n - i + 1) // i
            tail += term
        return min(1.0, 2 * tail / 2**n)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(max(0, k - int(40 * n**0.5)), k + 1)]
    return min(1.0, 2 * math.exp(logs[-1]) * math.fsum(math.exp(x - logs[-1]) for x in logs))


@F.pandas_udf(DoubleType())
def _mcnemar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def mcnemar(table: DataFrame) -> DataFrame:
    """``contingency`` rows with ``p_value``."""
    return table.withColumn("p_value", _mcnemar("only_a", "only_b"))


def group_profile(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(delta_sum, size, n): how many groups have this sum of differences b - a and this size; without groups, rows are groups.

    Raises if a row's id has no group. This table, not the groups, is what a bootstrap needs.
    """
    d = rows.select("id", (F.col("b_ok").cast("int") - F.col("a_ok").cast("int")).alias("d"))
    if groups is None:
        return d.groupBy(F.col("d").cast("long").alias("delta_sum"), F.lit(1).cast("long").alias("size")).agg(F.count("*").alias("n"))
    joined = d.join(groups.select("id", "group_id"), "id", "left")
    checked = joined.select("d", F.when(F.col("group_id").isNull() | (F.col("group_id") == ""), F.raise_error(F.lit("a gold id has no group"))).otherwise(F.col("group_id")).alias("group_id"))
    return checked.groupBy("group_id").agg(F.sum("d").alias("delta_sum"), F.count("*").alias("size")).groupBy("delta_sum", "size").agg(F.count("*").alias("n"))


#: Distinct (sum, size) pairs that a bootstrap sends to its tasks.
MAX_PROFILE = 200_000


def bootstrap_deltas(profile: DataFrame, samples: int = 10_000, seed: int = 0, block: int = 500) -> DataFrame:
    """(sample, delta): whole groups drawn with replacement.

    Groups with the same (sum, size) are alike, so a sample of all groups is one multinomial draw over the distinct
    pairs: equal in distribution to drawing groups one by one, in time that doesn't depend on their number. Blocks of
    samples have random streams of their own, so the result doesn't depend on the number of tasks.
    """
    spark = profile.sparkSession
    kinds = profile.orderBy("delta_sum", "size").limit(MAX_PROFILE + 1).collect()
    if len(kinds) > MAX_PROFILE:
        raise ValueError(f"more than {MAX_PROFILE} distinct groups")
    if not kinds:
        raise ValueError("there is nothing to draw from")
    sums, sizes, n = (np.array([r[i] for r in kinds], np.int64) for i in range(3))
    shared = spark.sparkContext.broadcast((sums, sizes, n))
    rows = max(1, min(block, 2_000_000 // len(kinds)))

    def draw(batches):
        sums, sizes, n = shared.value
        for frame in batches:
            for at in frame["id"].tolist():
                rng = np.random.default_rng([seed, at])
                k = min(rows, samples - at * rows)
                counts = rng.multinomial(int(n.sum()), n / n.sum(), size=k)
                yield pd.DataFrame({"sample": np.arange(at * rows, at * rows + k), "delta": (counts @ sums) / (counts @ sizes)})

    blocks = -(-samples // rows)
    return spark.range(0, blocks, 1, min(blocks, spark.sparkContext.defaultParallelism)).mapInPandas(draw, "sample long, delta double")


def bootstrap_ci(deltas: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(ci_low, ci_high) by linear interpolation of the sorted deltas."""
    tail = (1 - confidence) / 2
    return deltas.agg(F.percentile("delta", tail).alias("ci_low"), F.percentile("delta", 1 - tail).alias("ci_high"))


def compare(gold: DataFrame, a: DataFrame, b: DataFrame, groups: DataFrame | None = None, samples: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: contingency, p value and the interval of the difference."""
    rows = paired(gold, a, b)
    profile = group_profile(rows, groups)
    unit = "row_iid" if groups is None else "duplicate_cluster"
    n = profile.agg(F.sum("n")).first()[0]
    low, high = bootstrap_ci(bootstrap_deltas(profile, samples, seed), confidence).first()
    return mcnemar(contingency(rows)).withColumns({"ci_low": F.lit(low), "ci_high": F.lit(high), "bootstrap_group_count": F.lit(n), "bootstrap_unit": F.lit(unit), "bootstrap_samples": F.lit(samples)})


def holm(p_values: DataFrame, family: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Rows (hypothesis, p_value) with adjusted_p and reject, by Holm's steps within each family."""
    keys = family or []
    order = Window.partitionBy(*keys).orderBy("p_value", "hypothesis")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    left = F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1
    out = p_values.withColumn("__left", left)
    out = out.withColumn("adjusted_p", F.least(F.lit(1.0), F.max(F.col("__left") * F.col("p_value")).over(upto)))
    return out.withColumn("reject", F.min((F.col("p_value") <= F.lit(alpha) / F.col("__left")).cast("int")).over(upto) == 1).drop("__left")


def harm_screen(compared: DataFrame) -> DataFrame:
    """``stop`` where a candidate does harm: the difference and its whole interval are negative, and Holm rejects."""
    return compared.withColumn("stop", (F.col("delta") < 0) & (F.col("ci_high") < 0) & F.col("reject"))


def consistency_issues(compared: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(code) for rows whose cells don't add up or whose accuracies don't follow from the cells."""
    cells = F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")
    off = lambda x, y: F.abs(x - y / F.col("total")) > tolerance
    codes = F.array_compact(F.array(F.when(cells != F.col("total"), "cell_sum"), F.when(off(F.col("accuracy_a"), F.col("both") + F.col("only_a")), "accuracy_a"), F.when(off(F.col("accuracy_b"), F.col("both") + F.col("only_b")), "accuracy_b"), F.when(off(F.col("delta"), F.col("only_b") - F.col("only_a")), "delta")))
    return compared.select("*", F.explode(codes).alias("code"))


def compare_family(gold: DataFrame, runs: DataFrame, reference: str, labels: list[str]) -> DataFrame:
    """One row for each hypothesis over runs (label, id, prediction), all under one Holm step.

    ``candidate:x``: run x against the reference. ``fallback_on_invalid:x->y``: run x with y's prediction where x has none
    that can be read, against x alone; ``n_resolved`` counts the ids where y had one. An id repeated in a run raises.

    A hypothesis asks of a run only whether it can be read and whether it is right. Gold rows alike in that are counted
    first, at most three kinds for each run, and the hypotheses are made from these kinds.
    """
    names = list(dict.fromkeys([reference, *labels]))
    col = {x: f"__s{i}" for i, x in enumerate(names)}
    read = spread(runs.select("id", "label", F.when(is_canonical_integer(F.col("prediction")), F.col("prediction")).alias("prediction")), "id")
    own = {x: F.col("label") == x for x in names}
    per_id = read.groupBy("id").agg(*(F.max(F.when(own[x], F.col("prediction"))).alias(c) for x, c in col.items()), F.greatest(*(F.count_if(own[x]) for x in names), F.lit(0), F.lit(0)).alias("__most"), F.count_if(F.col("label").isNull()).alias("__odd"))
    once = F.when((F.col("__most") > 1) | (F.col("__odd") > 0), F.raise_error(F.lit("an id is repeated in a run, or a run has no label")).cast("boolean")).otherwise(True)
    said = per_id.where(once).select("id", *col.values())
    state = {c: F.when(F.col(c).isNull(), 0).when(F.col(c) == F.col("gold"), 2).otherwise(1).alias(c) for c in col.values()}  # unread, wrong, right
    kinds = gold.select("id", "gold").join(said, "id", "left").select(*state.values()).groupBy(*col.values()).agg(F.count("*").alias("n"))

    def case(name: str, a_ok: Column, b_ok: Column, resolved: Column) -> Column:
        return F.struct(F.lit(name).alias("hypothesis"), a_ok.alias("a_ok"), b_ok.alias("b_ok"), resolved.alias("resolved"))

    none, right = ({x: F.col(c) == k for x, c in col.items()} for k in (0, 2))
    cases = [case(f"candidate:{x}", right[reference], right[x], F.lit(False)) for x in labels if x != reference]
    cases += [case(f"fallback_on_invalid:{x}->{y}", right[x], right[x] | (none[x] & right[y]), none[x] & ~none[y]) for x in labels for y in labels if x != y]
    each = kinds.select("n", F.explode(F.array(*cases)).alias("h")).select("n", "h.*")
    tested = mcnemar(contingency(each, ["hypothesis"], "n", n_resolved=F.col("resolved")))
    return holm(tested.withColumn("family", F.lit("all")), ["family"]).drop("family")
