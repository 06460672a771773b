"""Queries over out-of-fold runs: orders are the problems, a customer's orders one group, and groups lie in one fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.operators import crossfold
from sievelight.plans import eval_queries, inputs
from sievelight.plans.registry import query
from sievelight.session import spread, table

LABELS = inputs.LABELS
#: One order in 23 is excluded, one in 29 lies in the sealed holdout with all others of its customer.
SPLIT = "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS group_id, CASE WHEN o_custkey % 29 <> 0 THEN o_custkey % 5 END AS fold FROM orders"
EXCLUDED = "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 23 = 0"
WANTED = f"SELECT id, group_id, fold FROM ({SPLIT}) WHERE fold IS NOT NULL AND id NOT IN ({EXCLUDED})"


def split(spark, d):
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), k.cast("string").alias("group_id"), F.when(k % 29 != 0, k % 5).cast("int").alias("fold"))


def excluded(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 23 = 0").select(F.col("o_orderkey").cast("string").alias("id"))


def runs(spark, d):
    """The three runs on every eligible id, each row in its fold."""
    wanted = crossfold.eligible(split(spark, d), excluded(spark, d)).select("id", "fold")
    rows = inputs.run(spark, d, 0).unionByName(inputs.run(spark, d, 1)).unionByName(inputs.run(spark, d, 2))
    return spread(rows.drop("fold"), "id").join(spread(wanted, "id"), "id").select("label", "fold", "id", "prediction")


_ALL = " UNION ALL ".join(f"SELECT label, id, prediction FROM ({inputs.SQL[f'run{i}']})" for i in range(3))
_RUNS = f"SELECT r.label, w.fold, r.id, r.prediction FROM ({_ALL}) r JOIN ({WANTED}) w USING (id)"
_POOLED = f"""WITH w AS ({WANTED}), g AS (SELECT g.id, g.gold FROM ({inputs.SQL["gold"]}) g JOIN w USING (id)), r AS ({_RUNS}),
 s AS (SELECT g.id, any_value(g.gold) AS gold, {", ".join(f"max(CASE WHEN label = '{x}' AND {eval_queries._CANON.format('prediction')} THEN prediction END) AS {x}" for x in LABELS)} FROM g LEFT JOIN r USING (id) GROUP BY g.id),
 c AS ({" UNION ALL ".join([*(f"SELECT 'candidate:{x}' AS hypothesis, coalesce(base = gold, false) AS a_ok, coalesce({x} = gold, false) AS b_ok, false AS asked, false AS answered FROM s" for x in LABELS[1:]), *(f"SELECT 'fallback_on_invalid:{x}->{y}', coalesce({x} = gold, false), coalesce(coalesce({x}, {y}) = gold, false), {x} IS NULL, {x} IS NULL AND {y} IS NOT NULL FROM s" for x in LABELS for y in LABELS if x != y)])}),
 t AS (SELECT hypothesis, count(*) AS total, count(*) FILTER (a_ok AND b_ok) AS "both", count(*) FILTER (a_ok AND NOT b_ok) AS only_a, count(*) FILTER (NOT a_ok AND b_ok) AS only_b, count(*) FILTER (NOT a_ok AND NOT b_ok) AS neither,
  count(*) FILTER (asked) AS n_asked, count(*) FILTER (answered) AS n_answered, count(*) FILTER (asked AND NOT answered) AS n_unanswered FROM c GROUP BY 1),
 p AS (SELECT t.*, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))) FROM (SELECT unnest(range(0, least(only_a, only_b) + 1)) AS k))) END AS p_value FROM t),
 q AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p_value, hypothesis) + 1 AS l FROM p)
SELECT hypothesis, total, "both", only_a, only_b, neither, n_asked, n_answered, n_unanswered, round(("both" + only_a) / total, 9) AS accuracy_a, round(("both" + only_b) / total, 9) AS accuracy_b, round((only_b - only_a) / total, 9) AS delta, round(p_value, 9) AS p_value,
 round(least(1.0, max(l * p_value) OVER v), 9) AS adjusted_p, min(CAST(p_value <= 0.05 / l AS INTEGER)) OVER v = 1 AS reject, true AS holds_delta FROM q WINDOW v AS (ORDER BY p_value, hypothesis ROWS UNBOUNDED PRECEDING)"""


@query(_POOLED)
def q_oof_compare(spark, d):
    """All hypotheses over the pooled folds; the interval, which is drawn, must hold the difference itself."""
    out = crossfold.compare_out_of_fold(inputs.gold(spark, d), runs(spark, d), split(spark, d), "base", list(LABELS[1:]), excluded(spark, d), samples=2_000, seed=3)
    own = ["hypothesis", "total", "both", "only_a", "only_b", "neither", "n_asked", "n_answered", "n_unanswered", "accuracy_a", "accuracy_b", "delta"]
    return out.select(*own, *(F.round(c, 9).alias(c) for c in ("p_value", "adjusted_p")), "reject", F.col("delta").between(F.col("ci_low") - 1e-9, F.col("ci_high") + 1e-9).alias("holds_delta"))


#: Faults of rows: base loses one id in 31, tuned repeats one in 37, small holds one in 41 in the next fold and one under a name that nobody knows, and one label wasn't declared.
_FAULTY = f"""SELECT label, id, fold FROM ({_RUNS}) WHERE NOT (label = 'base' AND CAST(id AS BIGINT) % 31 = 0) AND NOT (label = 'small' AND CAST(id AS BIGINT) % 41 = 0)
 UNION ALL SELECT label, id, fold FROM ({_RUNS}) WHERE label = 'tuned' AND CAST(id AS BIGINT) % 37 = 0 UNION ALL SELECT label, id, (fold + 1) % 5 FROM ({_RUNS}) WHERE label = 'small' AND CAST(id AS BIGINT) % 41 = 0
 UNION ALL SELECT label, 'x' || id, fold FROM ({_RUNS}) WHERE label = 'small' AND CAST(id AS BIGINT) % 43 = 0 UNION ALL SELECT 'other', id, fold FROM ({_RUNS}) WHERE label = 'base' AND CAST(id AS BIGINT) % 47 = 0"""


@query(f"""WITH f AS ({_FAULTY}), w AS ({WANTED}), h AS (SELECT label, id, count(*) AS n, min(fold) AS lo, max(fold) AS hi FROM f WHERE label <> 'other' GROUP BY 1, 2), j AS (SELECT coalesce(h.label, x.label) AS label, coalesce(h.id, x.id) AS id, h.n, h.lo, h.hi, x.fold FROM h FULL JOIN (SELECT * FROM w, (SELECT unnest(['base', 'tuned', 'small']) AS label)) x ON h.label = x.label AND h.id = x.id)
SELECT label, id, 'missing' AS code FROM j WHERE n IS NULL UNION ALL SELECT label, id, 'extra' FROM j WHERE fold IS NULL UNION ALL SELECT label, id, 'duplicate' FROM j WHERE n > 1 UNION ALL SELECT label, id, 'wrong_fold' FROM j WHERE n IS NOT NULL AND fold IS NOT NULL AND (lo <> fold OR hi <> fold) UNION ALL SELECT label, id, 'undeclared_label' FROM f WHERE label = 'other'""")
def q_oof_coverage(spark, d):
    k, label = F.col("id").cast("long"), F.col("label")
    is_ = lambda name, m: (label == name) & (k % m == 0)
    row = lambda cond, name=label, i=F.col("id"), fold=F.col("fold"): F.when(cond, F.struct(name.alias("label"), fold.alias("fold"), i.alias("id")))
    made = [row(~is_("base", 31) & ~is_("small", 41)), row(is_("tuned", 37)), row(is_("small", 41), fold=(F.col("fold") + 1) % 5), row(is_("small", 43), i=F.concat(F.lit("x"), "id")), row(is_("base", 47), F.lit("other"))]
    bad = runs(spark, d).select(F.explode(F.array_compact(F.array(*made))).alias("r")).select("r.*")  # the runs are read once
    return crossfold.coverage_issues(bad, crossfold.eligible(split(spark, d), excluded(spark, d)), list(LABELS))


# A run's evidence is told by its rows: the digest of how many there are and of the least and greatest id.
_EVIDENCE = f"""SELECT label, fold, sha256(label || ':' || CAST(fold AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR) || ':' || min(id) || ':' || max(id)) AS run_sha256, sha256('m' || CAST(count(*) AS VARCHAR) || label || CAST(fold AS VARCHAR)) AS manifest_sha256,
 'method-' || label AS fingerprint, CASE WHEN label <> 'base' THEN sha256('a' || label || CAST(fold AS VARCHAR)) END AS adapter_sha256, 'one' AS provenance_sha256 FROM ({_RUNS}) GROUP BY label, fold"""


def evidence(spark, d):
    f = F.col("fold").cast("string")
    rows = runs(spark, d).groupBy("label", "fold").agg(F.count("*").cast("string").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"))
    return rows.select("label", "fold", F.sha2(F.concat_ws(":", "label", f, "n", "a", "z"), 256).alias("run_sha256"), F.sha2(F.concat(F.lit("m"), "n", "label", f), 256).alias("manifest_sha256"), F.concat(F.lit("method-"), "label").alias("fingerprint"), F.when(F.col("label") != "base", F.sha2(F.concat(F.lit("a"), "label", f), 256)).alias("adapter_sha256"), F.lit("one").alias("provenance_sha256"))


_CHANGED = f"""SELECT CASE WHEN label = 'small' AND fold = 4 THEN 'other' ELSE label END AS label, CASE WHEN label = 'small' AND fold = 3 THEN 7 ELSE fold END AS fold, CASE WHEN label = 'tuned' AND fold = 1 THEN (SELECT run_sha256 FROM e WHERE label = 'base' AND fold = 0) ELSE run_sha256 END AS run_sha256,
 CASE WHEN label = 'tuned' AND fold = 1 THEN (SELECT manifest_sha256 FROM e WHERE label = 'base' AND fold = 0) ELSE manifest_sha256 END AS manifest_sha256, CASE WHEN label = 'tuned' AND fold = 2 THEN 'method-x' ELSE fingerprint END AS fingerprint,
 CASE WHEN label = 'base' AND fold = 2 THEN 'adapter' WHEN label = 'small' AND fold = 0 THEN NULL WHEN label = 'small' AND fold = 2 THEN (SELECT adapter_sha256 FROM e WHERE label = 'tuned' AND fold = 0) ELSE adapter_sha256 END AS adapter_sha256 FROM e"""


@query(f"""WITH e AS ({_EVIDENCE}), b AS ({_CHANGED}), c AS (SELECT label, fold FROM (SELECT unnest(['base', 'tuned', 'small']) AS label), (SELECT unnest(range(5)) AS fold))
SELECT DISTINCT label, CAST(fold AS INTEGER) AS fold, code FROM (SELECT label, fold, 'missing_run' AS code FROM c WHERE (label, fold) NOT IN (SELECT (label, fold) FROM b) UNION ALL SELECT label, fold, CASE WHEN label = 'other' THEN 'undeclared_label' ELSE 'fold_range' END FROM b WHERE (label, fold) NOT IN (SELECT (label, fold) FROM c)
 UNION ALL SELECT label, fold, 'adapter_unexpected' FROM b WHERE label = 'base' AND adapter_sha256 IS NOT NULL UNION ALL SELECT label, fold, 'adapter_missing' FROM b WHERE label <> 'base' AND adapter_sha256 IS NULL
 UNION ALL SELECT label, fold, 'reused_run' FROM b WHERE (run_sha256, manifest_sha256) IN (SELECT (run_sha256, manifest_sha256) FROM b GROUP BY run_sha256, manifest_sha256 HAVING count(*) > 1) UNION ALL SELECT label, fold, 'reused_adapter' FROM b WHERE adapter_sha256 IN (SELECT adapter_sha256 FROM b WHERE adapter_sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT label, NULL, 'mixed_fingerprints' FROM b GROUP BY label HAVING count(DISTINCT fingerprint) > 1)""")
def q_oof_evidence(spark, d):
    """Evidence with a fault of each kind."""
    e, is_ = evidence(spark, d), lambda label, fold: (F.col("label") == label) & (F.col("fold") == fold)
    run = e.where(is_("base", 0)).select("run_sha256", "manifest_sha256").first() or (None, None)
    adapter = (e.where(is_("tuned", 0)).select("adapter_sha256").first() or (None,))[0]
    e = e.withColumns({
        "run_sha256": F.when(is_("tuned", 1), F.lit(run[0])).otherwise(F.col("run_sha256")), "manifest_sha256": F.when(is_("tuned", 1), F.lit(run[1])).otherwise(F.col("manifest_sha256")), "fingerprint": F.when(is_("tuned", 2), "method-x").otherwise(F.col("fingerprint")),
        "adapter_sha256": F.when(is_("base", 2), "adapter").when(is_("small", 0), None).when(is_("small", 2), F.lit(adapter)).otherwise(F.col("adapter_sha256")), "was": F.col("fold"),
    })
    e = e.withColumns({"fold": F.when((F.col("label") == "small") & (F.col("was") == 3), 7).otherwise(F.col("fold")), "label": F.when((F.col("label") == "small") & (F.col("was") == 4), "other").otherwise(F.col("label"))}).drop("was")
    return crossfold.evidence_issues(e, list(LABELS), "base", 5)


#: A sound base run, and one for each way to fail.
CASES = ("sound", "lost_id", "repeated_id", "moved_id", "foreign_id", "lost_fold", "same_file", "two_provenances", "adapter", "other_method")
_K = "CAST(id AS BIGINT)"
_BASE = f"SELECT fold, id, prediction FROM ({_RUNS}) WHERE label = 'base'"
_CASE_ROWS = f"""SELECT c AS label, CASE WHEN c = 'moved_id' AND {_K} % 51 = 1 THEN (fold + 1) % 5 ELSE fold END AS fold, CASE WHEN c = 'foreign_id' AND {_K} % 51 = 1 THEN 'x' || id ELSE id END AS id, prediction FROM ({_BASE}), (SELECT unnest([{", ".join(f"'{c}'" for c in CASES)}]) AS c)
 WHERE NOT (c = 'lost_id' AND {_K} % 51 = 1) AND NOT (c = 'lost_fold' AND fold = 4) UNION ALL SELECT 'repeated_id', fold, id, prediction FROM ({_BASE}) WHERE {_K} % 51 = 1"""
_CASE_PROOF = f"""SELECT c AS label, fold, CASE WHEN c = 'same_file' AND fold = 4 THEN '3' ELSE CAST(fold AS VARCHAR) END AS run_sha256, CASE WHEN c = 'two_provenances' AND fold = 2 THEN 'two' ELSE 'one' END AS provenance_sha256, c = 'adapter' AND fold = 1 AS adapted, c = 'other_method' AND fold = 1 AS other
 FROM (SELECT unnest(range(5)) AS fold), (SELECT unnest([{", ".join(f"'{c}'" for c in CASES)}]) AS c) WHERE NOT (c = 'lost_fold' AND fold = 4)"""


@query(f"""WITH w AS (SELECT * FROM ({WANTED}) JOIN (SELECT id, gold FROM ({inputs.SQL["gold"]})) USING (id)), r AS ({_CASE_ROWS}), e AS ({_CASE_PROOF}), n AS (SELECT count(*) AS n FROM w),
 i AS (SELECT r.label, r.id, count(*) AS n, bool_and(r.fold = w.fold) AS placed, any_value(w.fold) AS fold, coalesce(min(r.prediction) = any_value(w.gold) AND regexp_full_match(min(r.prediction), '0|-?[1-9][0-9]*'), false) AS ok FROM r LEFT JOIN w USING (id) GROUP BY 1, 2),
 m AS (SELECT label, count(*) FILTER (fold IS NOT NULL) AS held, count(*) FILTER (fold IS NULL) AS extra, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (fold IS NOT NULL AND NOT placed) AS misplaced, count(*) FILTER (fold IS NOT NULL AND n = 1 AND ok) AS exact FROM i GROUP BY 1),
 p AS (SELECT label, count(*) AS runs, count(DISTINCT run_sha256) AS files, count(DISTINCT provenance_sha256) AS provenances, count(*) FILTER (adapted OR other) AS odd FROM e GROUP BY 1),
 q AS (SELECT label, runs = 5 AND held = n AND extra = 0 AND misplaced = 0 AS exact_fold_coverage, repeated = 0 AS validation_ids_unique, files = runs AS run_evidence_unique, provenances = 1 AS execution_provenance_consistent, odd = 0 AS fixed_base_only, n, exact FROM m JOIN p USING (label), n)
SELECT label, exact_fold_coverage, validation_ids_unique, run_evidence_unique, execution_provenance_consistent, fixed_base_only, exact_fold_coverage AND validation_ids_unique AND run_evidence_unique AND execution_provenance_consistent AND fixed_base_only AS qualified,
 CASE WHEN execution_provenance_consistent THEN 'one' END AS execution_provenance_sha256, n AS oof_problem_count, exact AS exact_match_count, round(exact / n, 9) AS accuracy FROM q""")
def q_oof_qualification(spark, d):
    case, k = F.col("label"), F.col("id").cast("long") % 51 == 1
    base = runs(spark, d).where("label = 'base'").drop("label").withColumn("label", F.explode(F.array(*map(F.lit, CASES))))
    rows = base.where(~((case == "lost_id") & k) & ~((case == "lost_fold") & (F.col("fold") == 4))).unionByName(base.where((case == "repeated_id") & k))
    rows = rows.select("label", F.when((case == "moved_id") & k, (F.col("fold") + 1) % 5).otherwise(F.col("fold")).alias("fold"), F.when((case == "foreign_id") & k, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), "prediction")
    proof, f = base.select("label", "fold").distinct().where(~((case == "lost_fold") & (F.col("fold") == 4))), F.col("fold")
    proof = proof.select("label", "fold", F.when((case == "same_file") & (f == 4), "3").otherwise(f.cast("string")).alias("run_sha256"), F.lit("m").alias("manifest_sha256"), F.when((case == "two_provenances") & (f == 2), "two").otherwise("one").alias("provenance_sha256"), F.when((case == "adapter") & (f == 1), "a").alias("adapter_sha256"), F.when((case == "other_method") & (f == 1), "tuned").otherwise("base").alias("fingerprint"))
    return crossfold.qualify_base(inputs.gold(spark, d), rows, proof, split(spark, d), "base", excluded(spark, d))
