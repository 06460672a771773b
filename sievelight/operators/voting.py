"""Weighted votes over the candidates of each problem, and what to do next with a problem.

A candidate is (problem_id, ord, completion, seed, route, greedy, verifier_passed, sample_index, prompt_sha256,
checkpoint_sha256, generation_config_sha256); ``ord`` is its place in the problem. Weights are exact: the driver brings
them to a common denominator, so sums are integers and ties are ties.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.answers import parse_answer
from sievelight.functions.text import sha256, strip
from sievelight.session import spread

IDENTITY = ("route", "seed", "sample_index", "prompt_sha256", "checkpoint_sha256", "generation_config_sha256")
DIGESTS = ("prompt_sha256", "checkpoint_sha256", "generation_config_sha256")
RANKED = ("score", "verified", "routes", "votes", "greedy")
MAX_WEIGHT = 1_000_000


def exact_weight(value: float) -> Fraction:
    if not math.isfinite(value) or value < 0:
        raise ValueError("weights are finite and not negative")
    if value > MAX_WEIGHT:
        raise ValueError(f"weights don't exceed {MAX_WEIGHT:,}")
    exact = Fraction(value).limit_denominator(10**9)
    if value > 0 and not exact:
        raise ValueError("the weight is positive but too small")
    return exact


def integer_weights(routes: dict[str, float] | None, bonus: float) -> tuple[dict[str, int], int, int]:
    """(weight by route, weight of other routes, bonus), all over the same denominator."""
    if any(w <= 0 for w in (routes or {}).values()):
        raise ValueError("route weights are positive")
    exact = {k: exact_weight(w) for k, w in (routes or {}).items()}
    extra = exact_weight(bonus)
    unit = math.lcm(extra.denominator, *(w.denominator for w in exact.values()))
    return {k: int(w * unit) for k, w in exact.items()}, unit, int(extra * unit)


def trace(completion: Column) -> Column:
    return sha256(strip(completion))


def identity_conflicts(candidates: DataFrame) -> DataFrame:
    """(problem_id, identity columns, n_variants): one generation identity with different completions or vote metadata."""
    seen = F.struct(trace(F.col("completion")).alias("t"), "greedy", "verifier_passed")
    return candidates.withColumns({c: F.lower(c) for c in DIGESTS}).groupBy("problem_id", *IDENTITY).agg(F.count_distinct(F.to_json(seen, {"ignoreNullFields": "false"})).alias("n_variants")).where("n_variants > 1")


def incomplete_provenance(candidates: DataFrame) -> DataFrame:
    """Candidates that lack their sample index or a digest."""
    lacks = F.col("sample_index").isNull()
    for c in DIGESTS:
        lacks |= F.col(c).isNull()
    return candidates.where(lacks)


def evaluate_candidates(candidates: DataFrame, by_trace: bool = True, by_identity: bool = True) -> DataFrame:
    """Candidates with status and value of their answer, ``accepted`` and the reason why not.

    The first of a problem's candidates with a trace (or a generation identity) counts, even if its answer can't be
    read. The checks come in the order: answer, identity, trace. Rows move once, to their problem, where both checks and
    the votes are taken; a problem's candidates are those of its budget. Traces are compared as bytes, half their text.
    """
    seen = candidates.withColumns({"__p": parse_answer(F.col("completion")), "__k": F.unhex(trace(F.col("completion")))})
    seen = seen.withColumns({c: F.lower(c) for c in DIGESTS})  # hex digests in either case are the same
    seen = seen.withColumns({"parse_status": F.col("__p.status"), "answer": F.when(F.col("__p.status") == "ok", F.col("__p.value"))}).drop("__p")
    seen = spread(seen, "problem_id")
    nth = lambda *by: F.row_number().over(Window.partitionBy("problem_id", *by).orderBy("ord"))
    seen = seen.withColumns({"__t": nth("__k") if by_trace else F.lit(1), "__i": nth(*IDENTITY) if by_identity else F.lit(1)})
    reason = F.when(F.col("parse_status") != "ok", F.concat(F.lit("parser_"), "parse_status")).when(F.col("__i") > 1, "duplicate_generation_identity").when(F.col("__t") > 1, "duplicate_trace")
    out = seen.withColumns({"trace": F.lower(F.hex("__k")), "exclusion": reason}).withColumn("accepted", F.col("exclusion").isNull())
    return out.select(*(c for c in candidates.columns if c != "trace"), "trace", "parse_status", "answer", "exclusion", "accepted")


def vote_table(evaluated: DataFrame, routes: dict[str, float] | None = None, bonus: float = 0.25) -> DataFrame:
    """(problem_id, answer, score, unit, votes, verified, routes, greedy, place): the answers of each problem by rank.

    ``score`` is an integer over ``unit``. Answers that are equal in all five features share their place.
    """
    by_route, other, extra = integer_weights(routes, bonus)
    weight = F.lit(other).cast("decimal(20,0)")
    for k, w in by_route.items():
        weight = F.when(F.col("route") == k, F.lit(w).cast("decimal(20,0)")).otherwise(weight)
    sure = F.coalesce(F.col("verifier_passed"), F.lit(False))
    weight = weight + F.when(sure, F.lit(extra)).otherwise(F.lit(0)).cast("decimal(20,0)")
    votes = evaluated.where("accepted").groupBy("problem_id", "answer").agg(
        F.sum(weight).cast("decimal(38,0)").alias("score"), F.count("*").alias("votes"), F.count_if(sure).alias("verified"), F.count_distinct("route").alias("routes"), F.max(F.col("greedy").cast("int")).alias("greedy"),
    )
    best = Window.partitionBy("problem_id").orderBy(*(F.desc(c) for c in RANKED))
    return votes.withColumns({"place": F.rank().over(best), "unit": F.lit(other)})


def decide(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """(problem_id, status, selected_answer, share, verified, n_candidates, n_answers) of every problem with candidates.

    ``selected``: one answer leads; ``tie``: several lead in all features; ``no_valid_answer``: no answer was accepted.
    """
    lead = F.col("place") == 1
    tally = votes.groupBy("problem_id").agg(
        F.count_if(lead).alias("leaders"), F.min(F.when(lead, F.col("answer"))).alias("first"), F.max(F.when(lead, F.col("score"))).alias("top"),
        F.sum("score").alias("total"), F.max(F.when(lead, F.col("verified"))).alias("verified"), F.count("*").alias("n_answers"),
    )
    n = candidates.groupBy("problem_id").agg(F.count("*").alias("n_candidates"))
    joined = n.join(tally, "problem_id", "left")
    status = F.when(F.col("leaders").isNull(), "no_valid_answer").when(F.col("leaders") > 1, "tie").otherwise("selected")
    return joined.select("problem_id", status.alias("status"), F.when(F.col("leaders") == 1, F.col("first")).alias("selected_answer"), F.coalesce(F.col("top").cast("double") / F.col("total").cast("double"), F.lit(0.0)).alias("share"), F.coalesce("verified", F.lit(0)).alias("verified"), "n_candidates", F.coalesce("n_answers", F.lit(0)).alias("n_answers"))


def aggregate_candidates(candidates: DataFrame, routes: dict[str, float] | None = None, bonus: float = 0.25, by_trace: bool = True, by_identity: bool = True) -> DataFrame:
    evaluated = evaluate_candidates(candidates, by_trace, by_identity)
    return decide(candidates, vote_table(evaluated, routes, bonus))


def with_budget(decided: DataFrame, budgets: tuple[int, ...] = (1, 4, 8, 16, 32), least_share: float = 0.75, need_verified: bool = True) -> DataFrame:
    """``should_stop`` and ``next_budget`` (null when done or exhausted) for rows of ``decide``."""
    if not budgets or list(budgets) != sorted(set(budgets)) or budgets[0] <= 0:
        raise ValueError("budgets are positive and rise strictly")
    if not 0 < least_share <= 1:
        raise ValueError("the share is above 0 and at most 1")
    stop = (F.col("n_candidates") >= budgets[0]) & (F.col("status") == "selected") & (F.col("share") >= least_share)
    if need_verified:
        stop &= F.col("verified") > 0
    more = F.array_min(F.filter(F.array(*map(F.lit, budgets)), lambda b: b > F.col("n_candidates")))
    return decided.withColumn("should_stop", stop).withColumn("next_budget", F.when(~F.col("should_stop"), more))
