"""Queries over completions and predictions: parsing, voting, scores, statistics, routing, submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions import answers
from sievelight.functions import text as T
from sievelight.operators import evaluation, joins, validation, voting
from sievelight.plans import inputs
from sievelight.plans.registry import query
from sievelight.session import table

CAND, GOLD = inputs.SQL["candidates"], inputs.SQL["gold"]
RUN = [inputs.SQL[f"run{i}"] for i in range(3)]


def _parsed(spark, d, how):
    rows = inputs.candidates(spark, d).select("problem_id", "ord", how(F.col("completion")).alias("p"))
    return rows.select("problem_id", "ord", "p.status", "p.value", "p.source", "p.reason")


_PARSED = f"SELECT problem_id, ord, 'ok' AS status, answer AS value, 'final_answer' AS source, 'parsed_unambiguous_integer' AS reason FROM ({CAND})"


@query(_PARSED)
def q_parse_fast(spark, d):
    return _parsed(spark, d, answers.parse_answer)


@query(_PARSED)
def q_parse_udf(spark, d):
    return _parsed(spark, d, answers.parse_by_udf)


@query("SELECT 'ok' AS status, 'final_answer' AS source, 'parsed_unambiguous_integer' AS reason_code, count(*) AS n FROM lineitem HAVING count(*) > 0")
def q_parse_hist(spark, d):
    rows = _parsed(spark, d, answers.parse_answer)
    return rows.groupBy("status", "source", answers.reason_code(F.col("reason")).alias("reason_code")).agg(F.count("*").alias("n"))


# Completions of all marker classes with their outcomes, written down by hand.
FORMS = [
    ("so we get\n**Final answer:** 1,204.00", "ok", "1204", "final_answer", "parsed_unambiguous_integer"),
    ("first \\boxed{\\frac{-18}{6}} and \\fbox{-3}", "ok", "-3", "boxed", "parsed_unambiguous_integer"),
    ("#### (77)", "ok", "77", "hashes", "parsed_unambiguous_integer"),
    ("answer is `$15$`.", "ok", "15", "answer", "parsed_unambiguous_integer"),
    ("there are 9 of them, or 3 / 1", "ok", "3", "fallback", "parsed_unambiguous_integer"),
    ("\\boxed{4} or \\boxed{5}", "conflict", None, "boxed", "conflicting_marker_values"),
    ("Final answer: 1\nFinal answer: -1\n\\boxed{1}", "conflict", None, "final_answer", "conflicting_marker_values"),
    ("Final answer: 7/2", "invalid", None, "final_answer", "non_integral_fraction"),
    ("Final answer: 3 and 4", "invalid", None, "final_answer", "multiple_values_in_payload"),
    ("\\boxed{12", "invalid", None, "boxed", "boxed_unbalanced_braces"),
    ("I can't say", "invalid", None, "fallback", "no_numeric_candidate"),
    ("  ", "invalid", None, None, "empty_completion"),
    ("#### 1e6", "invalid", None, "hashes", "scientific_notation_not_allowed"),
]
_VALUES = ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in form[1:])]) + ")" for i, form in enumerate(FORMS))


@query(f"SELECT n_nationkey, status, value, source, reason_code FROM nation JOIN (VALUES {_VALUES}) f(i, status, value, source, reason_code) ON n_nationkey % {len(FORMS)} = i")
def q_parse_forms(spark, d):
    text = F.element_at(F.array(*(F.lit(form[0]) for form in FORMS)), F.col("n_nationkey").cast("int") % len(FORMS) + 1)
    rows = table(spark, d, "nation").select("n_nationkey", answers.parse_answer(text).alias("p"))
    return rows.select("n_nationkey", "p.status", "p.value", "p.source", answers.reason_code(F.col("p.reason")).alias("reason_code"))


#: Completions made from the numbers of a row: part v, quantity q, form f.
_MIXED = "SELECT l_partkey AS v, CAST(l_quantity AS BIGINT) AS q, CAST((l_orderkey + l_linenumber) % 10 AS INTEGER) AS f FROM lineitem"
_OUTCOME = """CASE f WHEN 0 THEN ['ok', 'final_answer', 'parsed_unambiguous_integer', v::VARCHAR] WHEN 1 THEN CASE WHEN v % 6 = 0 THEN ['ok', 'boxed', 'parsed_unambiguous_integer', (-(v // 6))::VARCHAR] ELSE ['invalid', 'boxed', 'non_integral_fraction', NULL] END
 WHEN 2 THEN ['ok', 'hashes', 'parsed_unambiguous_integer', v::VARCHAR] WHEN 3 THEN CASE WHEN v = q THEN ['ok', 'boxed', 'parsed_unambiguous_integer', v::VARCHAR] ELSE ['conflict', 'boxed', 'conflicting_marker_values', NULL] END
 WHEN 4 THEN CASE WHEN v % 7 = 0 THEN ['ok', 'final_answer', 'parsed_unambiguous_integer', (v // 7)::VARCHAR] ELSE ['invalid', 'final_answer', 'non_integral_fraction', NULL] END WHEN 5 THEN ['invalid', 'final_answer', 'multiple_values_in_payload', NULL] WHEN 6 THEN ['invalid', 'hashes', 'scientific_notation_not_allowed', NULL]
 WHEN 7 THEN ['ok', 'answer', 'parsed_unambiguous_integer', v::VARCHAR] WHEN 8 THEN ['invalid', 'boxed', 'boxed_unbalanced_braces', NULL] ELSE ['ok', 'fallback', 'parsed_unambiguous_integer', v::VARCHAR] END"""


@query(f"SELECT f AS form, o[1] AS status, o[2] AS source, o[3] AS reason_code, count(*) AS n, CAST(sum(CAST(o[4] AS BIGINT)) AS BIGINT) AS total FROM (SELECT f, {_OUTCOME} AS o FROM ({_MIXED})) GROUP BY ALL")
def q_parse_mixed(spark, d):
    """Outcomes and values of ten kinds of completion; the row's numbers decide fractions and conflicts."""
    v, q = F.col("l_partkey"), F.col("l_quantity").cast("long").cast("string")
    s = v.cast("string")
    f = ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).cast("int")
    texts = [
        ("so we get\n**Final answer:** ", F.format_number(v, 0), ".00"), ("first \\boxed{\\frac{-", s, "}{6}}"), ("#### (", s, ")"), ("\\boxed{", s, "} or \\boxed{", q, "}"), ("Final answer: ", s, "/7"),
        ("Final answer: ", s, " and ", (v + 1).cast("string")), ("#### ", s, "e6"), ("answer is `$", s, "$`."), ("\\boxed{", s), ("there are ", q, " of them, or ", s, " / 1"),
    ]
    made = F.coalesce(*(F.when(f == i, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in t))) for i, t in enumerate(texts)))  # only the one that a row asks for
    rows = table(spark, d, "lineitem").select(f.alias("form"), made.alias("t")).select("form", answers.parse_answer(F.col("t")).alias("p"))
    return rows.groupBy("form", "p.status", "p.source", answers.reason_code(F.col("p.reason")).alias("reason_code")).agg(F.count("*").alias("n"), F.sum(F.col("p.value").cast("long")).alias("total"))


@query()
def q_parse_documents(spark, d):
    """Outcomes over free text, where every class of marker can occur."""
    p = answers.parse_answer(F.col("text"))
    rows = table(spark, d, "documents").select(p.alias("p")).select("p.status", "p.source", answers.reason_code(F.col("p.reason")).alias("reason_code"))
    return rows.groupBy("status", "source", "reason_code").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (answer <> stored) AS n_changed, count(*) FILTER (stored = CAST(l_partkey % 5 AS VARCHAR)) AS exact_before, count(*) FILTER (answer = CAST(l_partkey % 5 AS VARCHAR)) AS exact_now FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN '9' ELSE answer END AS stored FROM ({CAND}))")
def q_reparse(spark, d):
    """Stored results against those of the current parser."""
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit("\nFinal answer: "), (F.col("l_quantity").cast("int") % 5).cast("string")).alias("c"), (F.col("l_partkey") % 5).cast("string").alias("ref"), F.when(F.col("l_linenumber") == 1, "9").otherwise((F.col("l_quantity").cast("int") % 5).cast("string")).alias("stored"))
    rows = rows.withColumn("now", answers.parse_answer(F.col("c"))["value"])
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("now").eqNullSafe(F.col("stored"))).alias("n_changed"), F.count_if(F.col("stored") == F.col("ref")).alias("exact_before"), F.count_if(F.col("now") == F.col("ref")).alias("exact_now"))


# Route weights 1.5 (R), 0.1 (N), others 1; bonus 0.25: over 20 they are 30, 2, 20 and 5.
ROUTES = {"R": 1.5, "N": 0.1}
_SEEN = f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY problem_id, seed, route, ord ORDER BY ord) > 1 THEN 'duplicate_generation_identity' WHEN row_number() OVER (PARTITION BY problem_id, completion ORDER BY ord) > 1 THEN 'duplicate_trace' END AS exclusion FROM ({CAND})"
_VOTES = f"""SELECT *, rank() OVER (PARTITION BY problem_id ORDER BY score DESC, verified DESC, routes DESC, votes DESC, greedy DESC) AS place FROM (SELECT problem_id, answer,
 CAST(sum(CASE route WHEN 'R' THEN 30 WHEN 'N' THEN 2 ELSE 20 END + CASE WHEN f THEN 5 ELSE 0 END) AS BIGINT) AS score, count(*) AS votes, count(*) FILTER (f) AS verified, count(DISTINCT route) AS routes, max(CASE WHEN ord = 0 THEN 1 ELSE 0 END) AS greedy FROM ({_SEEN}) WHERE exclusion IS NULL GROUP BY 1, 2)"""
_STATUS = f"""SELECT problem_id, CASE WHEN leaders > 1 THEN 'tie' ELSE 'selected' END AS status, CASE WHEN leaders = 1 THEN first END AS selected_answer, round(CAST(top AS DOUBLE) / total, 9) AS share, verified, n_candidates, n_answers FROM (
 SELECT problem_id, count(*) FILTER (place = 1) AS leaders, min(answer) FILTER (place = 1) AS first, max(score) FILTER (place = 1) AS top, sum(score) AS total, max(verified) FILTER (place = 1) AS verified, count(*) AS n_answers FROM ({_VOTES}) GROUP BY 1) JOIN (SELECT problem_id, count(*) AS n_candidates FROM ({CAND}) GROUP BY 1) USING (problem_id)"""


@query(f"SELECT problem_id, ord, answer, exclusion FROM ({_SEEN})")
def q_candidates(spark, d):
    return voting.evaluate_candidates(inputs.candidates(spark, d)).select("problem_id", "ord", "answer", "exclusion")


@query(f"SELECT problem_id, answer, score, votes, verified, routes, greedy, place FROM ({_VOTES})")
def q_vote(spark, d):
    votes = voting.vote_table(voting.evaluate_candidates(inputs.candidates(spark, d)), ROUTES)
    return votes.select("problem_id", "answer", F.col("score").cast("long").alias("score"), "votes", "verified", "routes", "greedy", "place")


@query(_STATUS)
def q_vote_status(spark, d):
    return voting.aggregate_candidates(inputs.candidates(spark, d), ROUTES).withColumn("share", F.round("share", 9))


_STOP = "(n_candidates >= 1 AND status = 'selected' AND share >= 0.75 AND verified > 0)"


@query(f"SELECT problem_id, {_STOP} AS should_stop, CASE WHEN NOT {_STOP} THEN CASE WHEN n_candidates < 1 THEN 1 WHEN n_candidates < 4 THEN 4 WHEN n_candidates < 8 THEN 8 WHEN n_candidates < 16 THEN 16 WHEN n_candidates < 32 THEN 32 END END AS next_budget FROM ({_STATUS})")
def q_next_budget(spark, d):
    return voting.with_budget(voting.aggregate_candidates(inputs.candidates(spark, d), ROUTES)).select("problem_id", "should_stop", "next_budget")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS problem_id, l_returnflag AS route, count(DISTINCT (l_partkey, CAST(l_quantity AS INTEGER) % 5, l_linestatus = 'F')) AS n_variants FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, CAST(l_quantity AS INTEGER) % 5, l_linestatus = 'F')) > 1")
def q_identity_conflicts(spark, d):
    """With one seed and index for all candidates, the route alone is the identity, and conflicts are many."""
    rows = inputs.candidates(spark, d).withColumns({"seed": F.lit(1), "sample_index": F.lit(None).cast("int"), "greedy": F.lit(False)})
    return voting.identity_conflicts(rows).select("problem_id", "route", "n_variants")


@query("SELECT count(*) AS n_incomplete FROM lineitem")
def q_provenance(spark, d):
    return voting.incomplete_provenance(inputs.candidates(spark, d)).agg(F.count("*").alias("n_incomplete"))


@query(f"SELECT route, count(*) AS n_rows, count(*) FILTER (ord = 3 OR seed % 2 = 1 OR seed % 3 = 0 OR seed % 5 = 4) AS n_incomplete FROM ({CAND}) GROUP BY 1")
def q_provenance_mixed(spark, d):
    """Candidates of each route, and those of them that lack their index or one of three digests."""
    s, own = F.col("seed"), F.sha2("completion", 256)
    rows = inputs.candidates(spark, d).withColumns({"sample_index": F.when(F.col("ord") != 3, F.col("ord")), "prompt_sha256": F.when(s % 2 == 0, own), "checkpoint_sha256": F.when(s % 3 != 0, own), "generation_config_sha256": F.when(s % 5 != 4, own)})
    lacking = voting.incomplete_provenance(rows).groupBy("route").agg(F.count("*").alias("n_incomplete"))
    return rows.groupBy("route").agg(F.count("*").alias("n_rows")).join(lacking, "route", "left").select("route", "n_rows", F.coalesce("n_incomplete", F.lit(0)).alias("n_incomplete"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(('0x' || substr(sha256('seed-v1' || chr(0) || 'salt' || chr(0) || CAST(o_orderkey AS VARCHAR) || chr(0) || '3'), 1, 16))::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT) AS seed FROM orders")
def q_seed(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), T.deterministic_seed(F.col("o_orderkey"), F.lit(3), "salt").alias("seed"))


_CANON = "regexp_matches({0}, '^(0|-?[1-9][0-9]*)$')"
_READ = lambda c: f"CASE WHEN {_CANON.format(c)} THEN {c} END"
_ROUTED = f"coalesce({_READ('a.prediction')}, {_READ('b.prediction')})"
_USED = f"CASE WHEN {_READ('a.prediction')} IS NOT NULL THEN 'primary' WHEN {_READ('b.prediction')} IS NOT NULL THEN 'fallback' ELSE 'none' END"
_ROUTED_XY, _USED_XY = (q.replace("a.prediction", "x.prediction").replace("b.prediction", "y.prediction") for q in (_ROUTED, _USED))
_GRADED = f"""SELECT coalesce(g.id, s.id) AS id, gold, prediction, CASE WHEN g.id IS NULL THEN 'extra' WHEN s.id IS NULL THEN 'missing' WHEN prediction IS NULL OR NOT {_CANON.format('prediction')} THEN 'invalid' WHEN prediction = gold THEN 'correct' ELSE 'wrong' END AS outcome
 FROM ({GOLD}) g FULL OUTER JOIN ({inputs.SQL['submitted']}) s ON g.id = s.id"""


def _graded(spark, d):
    return evaluation.graded(inputs.gold(spark, d), inputs.submitted(spark, d))


@query(f"SELECT count(*) FILTER (outcome <> 'extra') AS total, {', '.join(f'count(*) FILTER (outcome = {chr(39)}{k}{chr(39)}) AS {k}' for k in ('correct', 'missing', 'extra', 'invalid'))}, count(*) FILTER (outcome IN ('wrong', 'invalid', 'missing')) AS incorrect, round(count(*) FILTER (outcome = 'correct') / count(*) FILTER (outcome <> 'extra'), 9) AS accuracy FROM ({_GRADED})")
def q_exact_match(spark, d):
    return evaluation.exact_match(_graded(spark, d))


@query(f"SELECT id, outcome FROM ({_GRADED}) WHERE outcome <> 'correct'")
def q_eval_lists(spark, d):
    return _graded(spark, d).where("outcome <> 'correct'").select("id", "outcome")


_OK = lambda p: f"coalesce({_CANON.format(p)} AND {p} = gold, false)"
_PAIRED = f"SELECT g.id, g.fold, g.group_id, {_OK('a.prediction')} AS a_ok, {_OK('b.prediction')} AS b_ok FROM ({GOLD}) g LEFT JOIN ({RUN[0]}) a ON g.id = a.id LEFT JOIN ({RUN[1]}) b ON g.id = b.id"


def _cells(rows, by=""):
    return f"""SELECT {by} *, round((both_ok + only_a) / total, 9) AS accuracy_a, round((both_ok + only_b) / total, 9) AS accuracy_b, round((only_b - only_a) / total, 9) AS delta FROM (SELECT {by} count(*) AS total, count(*) FILTER (a_ok AND b_ok) AS both_ok, count(*) FILTER (a_ok AND NOT b_ok) AS only_a, count(*) FILTER (NOT a_ok AND b_ok) AS only_b, count(*) FILTER (NOT a_ok AND NOT b_ok) AS neither FROM ({rows}))""".replace("SELECT  *", "SELECT *")


def _paired(spark, d):
    return evaluation.paired(inputs.gold(spark, d), inputs.run(spark, d, 0), inputs.run(spark, d, 1))


@query(_cells(_PAIRED))
def q_contingency(spark, d):
    return evaluation.contingency(_paired(spark, d)).withColumnRenamed("both", "both_ok")


_P = "least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM range(0, CAST(lo AS BIGINT) + 1) t(k)))"


@query(f"SELECT l_returnflag, only_a, only_b, CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, 2 * p), 9) END AS p_value FROM (SELECT l_returnflag, only_a, only_b, only_a + only_b AS n, sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))) AS p FROM (SELECT l_returnflag || l_linestatus AS l_returnflag, count(*) FILTER (l_tax > 0.04) AS only_a, count(*) FILTER (l_tax <= 0.04) AS only_b FROM lineitem GROUP BY 1), LATERAL (SELECT unnest(range(0, least(only_a, only_b) + 1)) AS k) GROUP BY ALL)")
def q_mcnemar(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_returnflag")).agg(F.count_if(F.col("l_tax") > 0.04).alias("only_a"), F.count_if(F.col("l_tax") <= 0.04).alias("only_b"))
    return evaluation.mcnemar(rows).select("l_returnflag", "only_a", "only_b", F.round("p_value", 9).alias("p_value"))


@query()
def q_bootstrap(spark, d):
    groups = inputs.gold(spark, d).select("id", "group_id")
    profile = evaluation.group_profile(_paired(spark, d), groups)
    return evaluation.bootstrap_ci(evaluation.bootstrap_deltas(profile, 10_000, seed=7))


@query()
def q_compare(spark, d):
    gold = inputs.gold(spark, d)
    return evaluation.compare(gold, inputs.run(spark, d, 0), inputs.run(spark, d, 1), gold.select("id", "group_id"), 10_000, seed=7)


@query(f"SELECT CAST(d AS BIGINT) AS delta_sum, size, count(*) AS n FROM (SELECT group_id, sum(CAST(b_ok AS INTEGER) - CAST(a_ok AS INTEGER)) AS d, count(*) AS size FROM ({_PAIRED}) GROUP BY 1) GROUP BY 1, 2")
def q_group_profile(spark, d):
    return evaluation.group_profile(_paired(spark, d), inputs.gold(spark, d).select("id", "group_id"))


_PV = "SELECT o_orderpriority AS family, o_orderstatus AS hypothesis, round(avg(o_custkey % 100) / 2000, 9) AS p_value FROM orders GROUP BY 1, 2"


@query(f"""SELECT family, hypothesis, p_value, round(least(1.0, max(l * p_value) OVER w), 9) AS adjusted_p, min(CAST(p_value <= 0.05 / l AS INTEGER)) OVER w = 1 AS reject FROM (SELECT *, count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, hypothesis) + 1 AS l FROM ({_PV}))
 WINDOW w AS (PARTITION BY family ORDER BY p_value, hypothesis ROWS UNBOUNDED PRECEDING)""")
def q_holm(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("hypothesis")).agg(F.round(F.avg(F.col("o_custkey") % 100) / 2000, 9).alias("p_value"))
    return evaluation.holm(rows, ["family"]).withColumn("adjusted_p", F.round("adjusted_p", 9))


_ALL = " UNION ALL ".join(RUN)


def _runs(spark, d):
    return joins.pool([inputs.run(spark, d, i) for i in range(3)])


@query(f"SELECT a.label AS a, b.label AS b, used, count(*) AS n, count(*) FILTER (coalesce({_CANON.format('p')} AND p = gold, false)) AS n_correct FROM (SELECT x.label AS la, y.label AS lb, x.id, {_ROUTED_XY} AS p, {_USED_XY} AS used FROM ({_ALL}) x JOIN ({_ALL}) y ON x.id = y.id AND x.label <> y.label) JOIN ({GOLD}) USING (id), (SELECT unnest(['base', 'tuned', 'small']) AS label) a, (SELECT unnest(['base', 'tuned', 'small']) AS label) b WHERE a.label = la AND b.label = lb GROUP BY ALL")
def q_routing_pairs(spark, d):
    """All ordered pairs of runs, each with the other as its fallback."""
    routed = joins.all_routes(_runs(spark, d).select("label", "id", "prediction")).join(inputs.gold(spark, d).select("id", "gold"), "id")
    return routed.groupBy("a", "b", "used").agg(F.count("*").alias("n"), F.count_if(evaluation.is_correct(F.col("prediction"), F.col("gold"))).alias("n_correct"))


@query(f"SELECT a.id, {_ROUTED} AS prediction, {_USED} AS used FROM ({RUN[0]}) a JOIN ({RUN[1]}) b USING (id)")
def q_route(spark, d):
    return joins.route(inputs.run(spark, d, 0), inputs.run(spark, d, 1))


@query(f"SELECT id, prediction FROM (SELECT a.id, {_ROUTED} AS prediction FROM ({RUN[0]}) a JOIN ({RUN[1]}) b USING (id)) WHERE prediction IS NOT NULL")
def q_frozen_predictions(spark, d):
    """An id without any valid prediction is left out; it never becomes 0."""
    return joins.route(inputs.run(spark, d, 0), inputs.run(spark, d, 1)).where("used <> 'none'").select("id", "prediction")


@query(f"SELECT used, count(*) AS n, count(*) FILTER (coalesce({_CANON.format('prediction')} AND prediction = gold, false)) AS n_correct FROM (SELECT a.id, {_ROUTED} AS prediction, {_USED} AS used FROM ({RUN[0]}) a JOIN ({RUN[1]}) b USING (id)) JOIN ({GOLD}) USING (id) GROUP BY 1")
def q_frozen_policy(spark, d):
    routed = joins.route(inputs.run(spark, d, 0), inputs.run(spark, d, 1)).join(inputs.gold(spark, d).select("id", "gold"), "id")
    return routed.groupBy("used").agg(F.count("*").alias("n"), F.count_if(evaluation.is_correct(F.col("prediction"), F.col("gold"))).alias("n_correct"))


_LABELS = ("base", "tuned", "small")
_BY_LABEL = "SELECT g.id, gold, " + ", ".join(f"(SELECT max({_READ('prediction')}) FROM r WHERE r.id = g.id AND label = '{x}') AS {x}" for x in _LABELS) + " FROM g"
_SAYS = lambda x: f"coalesce({x} = gold, false)"
_CASES = " UNION ALL ".join([
    *(f"SELECT 'candidate:{x}' AS hypothesis, {_SAYS('base')} AS a_ok, {_SAYS(x)} AS b_ok, false AS resolved FROM w" for x in _LABELS[1:]),
    *(f"SELECT 'fallback_on_invalid:{x}->{y}', {_SAYS(x)}, {_SAYS(f'coalesce({x}, {y})')}, {x} IS NULL AND {y} IS NOT NULL FROM w" for x in _LABELS for y in _LABELS if x != y),
])
_FAMILY = f"""WITH g AS ({GOLD}), r AS ({_ALL}), w AS ({_BY_LABEL}), c AS ({_CASES}),
 t AS (SELECT hypothesis, count(*) AS total, count(*) FILTER (a_ok AND NOT b_ok) AS only_a, count(*) FILTER (NOT a_ok AND b_ok) AS only_b, count(*) FILTER (resolved) AS n_resolved FROM c GROUP BY 1),
 p AS (SELECT t.*, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))) FROM (SELECT unnest(range(0, least(only_a, only_b) + 1)) AS k))) END AS p_value FROM t),
 q AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p_value, hypothesis) + 1 AS l FROM p)
SELECT hypothesis, total, only_a, only_b, n_resolved, round(p_value, 9) AS p_value, round(least(1.0, max(l * p_value) OVER v), 9) AS adjusted_p, min(CAST(p_value <= 0.05 / l AS INTEGER)) OVER v = 1 AS reject FROM q WINDOW v AS (ORDER BY p_value, hypothesis ROWS UNBOUNDED PRECEDING)"""


@query(_FAMILY)
def q_compare_family(spark, d):
    """Runs against the reference and all ordered fallback routes, under one Holm step."""
    out = evaluation.compare_family(inputs.gold(spark, d), _runs(spark, d), "base", list(_LABELS))
    return out.select("hypothesis", "total", "only_a", "only_b", "n_resolved", F.round("p_value", 9).alias("p_value"), F.round("adjusted_p", 9).alias("adjusted_p"), "reject")


@query(f"SELECT label, fold, count(*) AS n, count(*) FILTER (coalesce({_CANON.format('prediction')} AND prediction = gold, false)) AS n_correct FROM (SELECT r.*, g.gold FROM ({_ALL}) r JOIN ({GOLD}) g USING (id)) GROUP BY 1, 2")
def q_oof_pool(spark, d):
    rows = _runs(spark, d).join(inputs.gold(spark, d).select("id", "gold"), "id")
    return rows.groupBy("label", "fold").agg(F.count("*").alias("n"), F.count_if(evaluation.is_correct(F.col("prediction"), F.col("gold"))).alias("n_correct"))


@query(f"SELECT label, fold FROM (SELECT unnest(['base', 'tuned', 'small', 'absent']) AS label), (SELECT unnest(range(7)) AS fold) WHERE (label, fold) NOT IN (SELECT (label, fold) FROM ({_ALL}))")
def q_missing_cells(spark, d):
    return joins.missing_cells(_runs(spark, d), ["base", "tuned", "small", "absent"], 7)


@query(f"SELECT fold, total, delta, delta < 0 AS stop FROM (SELECT fold, total, round((only_b - only_a) / total, 9) AS delta FROM (SELECT fold, count(*) AS total, count(*) FILTER (a_ok AND NOT b_ok) AS only_a, count(*) FILTER (NOT a_ok AND b_ok) AS only_b FROM ({_PAIRED}) GROUP BY 1))")
def q_harm_screen(spark, d):
    """With given intervals and decisions, the sign of the difference decides."""
    rows = _paired(spark, d).join(inputs.gold(spark, d).select("id", "fold"), "id")
    cells = evaluation.contingency(rows, ["fold"]).withColumns({"ci_high": F.least(F.col("delta"), F.lit(-1e-9)), "reject": F.lit(True)})
    return evaluation.harm_screen(cells).select("fold", "total", "delta", "stop")


@query(f"SELECT fold, 'cell_sum' AS code FROM ({GOLD}) WHERE fold = 2 GROUP BY 1")
def q_consistency(spark, d):
    """Stored comparisons with one falsified."""
    rows = _paired(spark, d).join(inputs.gold(spark, d).select("id", "fold"), "id")
    return evaluation.consistency_issues(evaluation.contingency(rows, ["fold"]).withColumn("neither", F.col("neither") + (F.col("fold") == 2).cast("long"))).select("fold", "code")


#: Both runs by block of groups, exchanged in odd blocks, with the upper end of a normal interval and a test by the squared difference.
_BLOCKS = f"SELECT block, total, n_both, oa, ob, nn, round((ob - oa) / total, 9) AS delta, (ob - oa) / total + 1.96 * sqrt((oa + ob) / total / total) AS ci_high, (ob - oa) * (ob - oa) * 10 > (oa + ob) * 25 AS reject FROM (SELECT CAST(group_id AS BIGINT) % 97 AS block, count(*) AS total, count(*) FILTER (a_ok AND b_ok) AS n_both, count(*) FILTER (a_ok AND NOT b_ok) AS oa, count(*) FILTER (NOT a_ok AND b_ok) AS ob, count(*) FILTER (NOT a_ok AND NOT b_ok) AS nn FROM (SELECT group_id, CASE WHEN CAST(group_id AS BIGINT) % 97 % 2 = 1 THEN b_ok ELSE a_ok END AS a_ok, CASE WHEN CAST(group_id AS BIGINT) % 97 % 2 = 1 THEN a_ok ELSE b_ok END AS b_ok FROM ({_PAIRED})) GROUP BY 1)"


def _blocks(spark, d):
    blocks = inputs.gold(spark, d).select("id", (F.col("group_id").cast("long") % 97).alias("block"))
    rows, odd = _paired(spark, d).join(blocks, "id"), F.col("block") % 2 == 1
    rows = rows.select("block", F.when(odd, F.col("b_ok")).otherwise(F.col("a_ok")).alias("a_ok"), F.when(odd, F.col("a_ok")).otherwise(F.col("b_ok")).alias("b_ok"))
    cells = evaluation.contingency(rows, ["block"])
    a, b, n = F.col("only_a"), F.col("only_b"), F.col("total")
    return cells.withColumns({"ci_high": (b - a) / n + F.lit(1.96) * F.sqrt((a + b) / n / n), "reject": (b - a) * (b - a) * 10 > (a + b) * 25})


@query(f"SELECT block, total, delta, reject, delta < 0 AND ci_high < 0 AND reject AS stop FROM ({_BLOCKS})")
def q_harm_blocks(spark, d):
    """The harm screen where differences, intervals and decisions disagree."""
    return evaluation.harm_screen(_blocks(spark, d)).select("block", "total", "delta", "reject", "stop")


@query(f"SELECT block, unnest(CASE block % 6 WHEN 1 THEN ['cell_sum'] WHEN 2 THEN ['accuracy_a'] WHEN 3 THEN ['accuracy_b'] WHEN 4 THEN ['delta'] WHEN 5 THEN ['cell_sum', 'accuracy_a', 'accuracy_b', 'delta'] ELSE [] END) AS code FROM ({_BLOCKS})")
def q_consistency_blocks(spark, d):
    """Stored comparisons, five in six of them falsified in one or all of their fields."""
    k = F.col("block") % 6
    off = lambda c, m: F.when(k.isin(m, 5), F.col(c) + 0.25).otherwise(F.col(c))
    rows = _blocks(spark, d).withColumns({"neither": F.col("neither") + k.isin(1, 5).cast("long"), "accuracy_a": off("accuracy_a", 2), "accuracy_b": off("accuracy_b", 3), "delta": off("delta", 4)})
    return evaluation.consistency_issues(rows).select("block", "code")


def _expected(spark, d):
    return inputs.gold(spark, d).select("id", F.col("id").cast("long").alias("ord"))


_SUBMITTED = f"SELECT id, prediction, CAST(regexp_replace(id, 'x', '') AS BIGINT) AS ord FROM ({inputs.SQL['submitted']})"


@query(f"""SELECT id, 'noncanonical_answer' AS code, ord + 2 AS row_number FROM ({_SUBMITTED}) WHERE prediction IS NULL OR NOT {_CANON.format('prediction')} UNION ALL SELECT id, 'missing_ids', NULL FROM ({GOLD}) WHERE id NOT IN (SELECT id FROM ({_SUBMITTED})) UNION ALL SELECT id, 'extra_ids', NULL FROM ({_SUBMITTED}) WHERE id NOT IN (SELECT id FROM ({GOLD}))
 UNION ALL SELECT NULL, 'row_count', NULL WHERE (SELECT count(*) FROM ({_SUBMITTED})) <> (SELECT count(*) FROM orders)""")
def q_submission_issues(spark, d):
    rows = inputs.submitted(spark, d).select("id", F.col("prediction").alias("answer"), F.regexp_replace("id", "x", "").cast("long").alias("ord"))
    return validation.submission_issues(rows, _expected(spark, d))


_LINE_KIND = "CASE o_orderkey % 32 WHEN 3 THEN 'row_type' WHEN 5 THEN 'row_schema' WHEN 6 THEN 'null_id' WHEN 7 THEN 'id_type' WHEN 9 THEN 'both' WHEN 10 THEN 'flag' WHEN 11 THEN 'fraction' WHEN 12 THEN 'zero' ELSE 'sound' END"
_LINE_GONE = "('row_type', 'null_id', 'id_type', 'both')"


@query(f"""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey + 2 AS row_number, {_LINE_KIND} AS k FROM orders)
 SELECT NULL AS id, k AS code, row_number FROM r WHERE k IN ('row_type', 'null_id', 'id_type') UNION ALL SELECT CASE WHEN k = 'row_schema' THEN id END, 'row_schema', row_number FROM r WHERE k IN ('row_schema', 'both') UNION ALL SELECT NULL, 'null_id', row_number FROM r WHERE k = 'both'
 UNION ALL SELECT id, 'noncanonical_answer', row_number FROM r WHERE k IN ('flag', 'fraction') UNION ALL SELECT id, 'missing_ids', NULL FROM r WHERE k IN {_LINE_GONE}""")
def q_submission_lines(spark, d):
    """A submission of JSON lines with every fault of a row: no object, other keys, no id, a number for an id, odd answers."""
    orders = table(spark, d, "orders")
    key, cust, m = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderkey") % 32
    answer = F.when(m == 10, "true").when(m == 11, F.concat(cust, F.lit(".5"))).when(m == 12, "-0").when(m % 2 == 0, F.concat(F.lit('"'), cust, F.lit('"'))).otherwise(cust)
    sound = F.concat(F.lit('{"id":"'), key, F.lit('","answer":'), answer, F.lit("}"))
    swapped = F.concat(F.lit('{"answer":'), cust, F.lit(',"id":"'), key, F.lit('"}'))
    line = F.when(m == 3, F.concat(F.lit("["), key, F.lit("]"))).when(m == 5, swapped).when(m == 6, F.concat(F.lit('{"id":null,"answer":'), cust, F.lit("}"))).when(m == 7, F.concat(F.lit('{"id":'), key, F.lit(',"answer":1}'))).when(m == 9, F.concat(F.lit('{"answer":'), cust, F.lit("}"))).otherwise(sound)
    found = validation.submission_line_issues(orders.select(F.col("o_orderkey").alias("ord"), line.alias("raw")), _expected(spark, d))
    return found.select("id", "code", "row_number")


@query("SELECT 'answer_format' AS code UNION ALL SELECT 'id_sequence'")
def q_independent_issues(spark, d):
    rows = inputs.submitted(spark, d).select("id", F.col("prediction").alias("answer"), F.regexp_replace("id", "x", "").cast("long").alias("ord"))
    return validation.independent_issues(rows, _expected(spark, d))


_INNER = f"SELECT * FROM ({inputs.SQL['submitted']}) WHERE id NOT LIKE 'x%'"


@query(f"SELECT g.id, CASE WHEN {_CANON.format('prediction')} THEN prediction ELSE '0' END AS answer, CASE WHEN {_CANON.format('prediction')} THEN 'prediction' ELSE 'emergency_fallback' END AS provenance, CASE WHEN s.id IS NULL THEN 'missing_prediction' WHEN prediction IS NULL OR NOT {_CANON.format('prediction')} THEN 'invalid_prediction' END AS reason FROM ({GOLD}) g LEFT JOIN ({_INNER}) s ON g.id = s.id")
def q_resolve(spark, d):
    known = inputs.submitted(spark, d).where("id NOT LIKE 'x%'")
    return validation.resolve(known, _expected(spark, d), fallback="0")


@query(f"SELECT coalesce(g.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'missing' ELSE 'extra' END AS code FROM ({GOLD}) g FULL OUTER JOIN ({inputs.SQL['submitted']}) s ON g.id = s.id WHERE g.id IS NULL OR s.id IS NULL")
def q_universe(spark, d):
    return joins.universe_issues(inputs.gold(spark, d), inputs.submitted(spark, d))


@query(f"SELECT g.id, 'prediction' AS field FROM ({RUN[0]}) g JOIN ({RUN[1]}) b USING (id) WHERE g.prediction IS DISTINCT FROM b.prediction UNION ALL SELECT g.id, 'label' FROM ({RUN[0]}) g")
def q_binding(spark, d):
    return joins.binding_issues(inputs.run(spark, d, 0), inputs.run(spark, d, 1), "id", ["prediction", "fold", "label"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS problem_id, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '5-LOW'")
def q_bank_subset(spark, d):
    """Three banks by order status, and the exact subset that is expected."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("problem_id"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    banks = [orders.where(F.col("status") == s).drop("o_orderpriority") for s in ("F", "O", "P")]
    return joins.bank_subset(banks, orders.where("o_orderpriority <> '5-LOW'"))[0]


@query("SELECT fp AS method_fp, label FROM (SELECT DISTINCT o_orderpriority AS label, sha256(o_orderpriority) AS fp FROM orders)")
def q_method_fingerprints(spark, d):
    """Exactly one training-method fingerprint per label, or reading the row fails."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.min(F.sha2("o_orderpriority", 256)).alias("lo"), F.max(F.sha2("o_orderpriority", 256)).alias("hi"))
    return rows.select("label", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("a label has several methods"))).alias("method_fp"))


