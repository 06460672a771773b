"""Queries over split manifests, eligibility, token lengths of training plans, corpus counts and row bindings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.operators import aggregates, manifests, splits, training, validation
from sievelight.plans import dialect as D
from sievelight.plans import inputs
from sievelight.plans.ledger_queries import _PROMPT, CORPUS
from sievelight.plans.registry import query
from sievelight.plans.text_queries import _GROUPED, _SPLIT, _TOXIC, REC, SPLIT, _grouped, _order_groups, _toxic
from sievelight.session import settled

_LIST = "sha256('[' || coalesce(string_agg('\"' || record_id || '\"', ',' ORDER BY record_id) FILTER (ok), '') || ']')"


@query(f"""WITH g AS ({_GROUPED}), t AS ({_TOXIC}), m AS (SELECT *, record_id IN (SELECT record_id FROM t) AS direct, group_id IN (SELECT group_id FROM g WHERE record_id IN (SELECT record_id FROM t)) AS out FROM g),
 p AS (SELECT 'direct' AS part, NULL::INTEGER AS fold, record_id, direct AS ok FROM m UNION ALL SELECT 'expanded', NULL, record_id, out FROM m UNION ALL SELECT 'eligible', NULL, record_id, NOT out FROM m
 UNION ALL SELECT 'training', CAST(f AS INTEGER), record_id, NOT out AND fold <> f FROM m, range(5) r(f) UNION ALL SELECT 'validation', CAST(f AS INTEGER), record_id, NOT out AND fold = f FROM m, range(5) r(f))
SELECT part, fold, count(*) FILTER (ok) AS n, CASE WHEN part <> 'eligible' THEN {_LIST} END AS ids_sha256 FROM p GROUP BY 1, 2""")
def q_eligibility_report(spark, d):
    return manifests.eligibility_report(settled(_grouped(spark, d)), _toxic(spark, d), 5)


_K = "CAST(record_id AS BIGINT)"


@query(f"""WITH s AS ({_SPLIT}) SELECT record_id, 'group_id' AS field FROM s WHERE {_K} % 13 = 0 AND {_K} % 29 <> 0 UNION ALL SELECT record_id, 'fold' FROM s WHERE {_K} % 17 = 0 AND {_K} % 29 <> 0
 UNION ALL SELECT record_id, 'partition' FROM s WHERE {_K} % 19 = 0 AND {_K} % 29 <> 0 AND partition <> 'cross_validation' UNION ALL SELECT record_id, 'row' FROM s WHERE {_K} % 29 = 0 UNION ALL SELECT 'new-' || record_id, 'row' FROM s WHERE {_K} % 31 = 0 AND {_K} % 29 <> 0""")
def q_split_diff(spark, d):
    """A falsified split against the one made anew: other groups, folds and partitions, rows gone and rows too many."""
    anew = settled(splits.make_split(_order_groups(spark, d), **SPLIT))
    k = F.col("record_id").cast("long")
    changed = {"group_id": F.when(k % 13 == 0, F.concat(F.lit("x"), "group_id")).otherwise(F.col("group_id")), "fold": F.when(k % 17 == 0, F.coalesce((F.col("fold") + 1) % 5, F.lit(0))).otherwise(F.col("fold")), "partition": F.when(k % 19 == 0, splits.TRAINED).otherwise(F.col("partition"))}
    stored = anew.where(k % 29 != 0).withColumns(changed)
    return manifests.split_diff(stored.unionByName(stored.where(k % 31 == 0).withColumn("record_id", F.concat(F.lit("new-"), "record_id"))), anew)


_ENTRY = """'{"fold":' || coalesce(CAST(fold AS VARCHAR), 'null') || ',"group_id":"' || group_id || '","partition":"' || partition || '","record_id":"' || record_id || '"}'"""


@query(f"""WITH s AS ({_SPLIT}), a AS (SELECT count(*) AS n_records, sha256('[' || string_agg('["' || record_id || '","' || group_id || '"]', ',' ORDER BY record_id) || ']') AS source_groups_sha256, string_agg({_ENTRY}, ',' ORDER BY record_id) AS rows FROM s)
SELECT n_records, source_groups_sha256, sha256('{{"algorithm":"grouped","assignments":[' || rows || '],"holdout_fraction":0.1,"n_folds":5,"seed":7,"source_groups_sha256":"' || source_groups_sha256 || '","version":"v4"}}') AS split_sha256 FROM a""")
def q_split_sha(spark, d):
    return manifests.split_identity(settled(splits.make_split(_order_groups(spark, d), **SPLIT)), "v4", 7, 5, 0.1, "grouped")


#: A tokenizer that SQL can count too: runs of letters, single digits and other signs.
_PIECES = r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x00-\x20]"
_LENGTH = lambda x: f"len(regexp_extract_all({x}, '{_PIECES}'))"
_CHAT = f"'{training.SYSTEM}' || chr(10) || question_raw"


def _pieces(text: str) -> list[str]:
    return re.findall(_PIECES, text)


@query(f"SELECT kind, count(*) AS n_rows, {D.distribution('t', '', ('p50', 'p90', 'p95', 'p99'))}, {', '.join(f'count(*) FILTER (t > {x}) AS over_{x}' for x in (1024, 2048, 4096))} FROM (SELECT 'raw' AS kind, {_LENGTH('question_raw')} AS t FROM ({REC}) UNION ALL SELECT 'chat', {_LENGTH(_CHAT)} FROM ({REC})) GROUP BY 1")
def q_token_report(spark, d):
    return aggregates.token_profile(manifests.token_report(inputs.records(spark, d), _pieces, training.SYSTEM), by=["kind"])


_ENCODED = f"SELECT CAST(f AS BIGINT) AS fold, CASE WHEN fold = f THEN 'validation' ELSE 'training' END AS role, id, t + r AS t, r FROM (SELECT id, fold, {_LENGTH('question_raw')} AS t, {_LENGTH('answer')} AS r FROM ({REC}) WHERE id NOT IN ({_TOXIC})), range(5) x(f) WHERE NOT (fold = f AND CAST(id AS BIGINT) % 10 = 3)"


def _encoded(spark, d):
    """Records that aren't excluded, in training for four folds and in validation for their own; some aren't validated."""
    rows = inputs.records(spark, d).join(_toxic(spark, d).withColumnRenamed("record_id", "id"), "id", "left_anti")
    rows = training.with_tokens(training.with_tokens(rows, "question_raw", _pieces, "t"), "answer", _pieces, "r").select("id", F.col("fold").alias("own"), "t", "r")
    rows = rows.withColumn("fold", F.explode(F.array(*(F.lit(f).cast("long") for f in range(5)))))
    rows = rows.where(~((F.col("own") == F.col("fold")) & (F.col("id").cast("long") % 10 == 3)))
    return rows.select("fold", F.when(F.col("own") == F.col("fold"), "validation").otherwise("training").alias("role"), "id", (F.col("t") + F.col("r")).alias("sequence_tokens"), F.col("r").alias("response_tokens"))


@query(f"SELECT fold, role, count(*) AS n_rows, max(t) AS max_tokens, arg_max(id, (t, id)) AS longest_id, min(r) AS min_response, count(*) FILTER (t > 100) AS over_limit FROM ({_ENCODED}) GROUP BY ALL")
def q_sft_preflight(spark, d):
    return aggregates.preflight(_encoded(spark, d), 100)


@query(f"WITH e AS ({_ENCODED}), m AS (SELECT * FROM e ORDER BY t DESC, id DESC, fold, role LIMIT 1) SELECT (SELECT count(DISTINCT id) FROM e) AS n_development, (SELECT count(DISTINCT id) FROM e WHERE role = 'validation') AS n_validation, (SELECT count(DISTINCT id) FROM e WHERE id NOT IN (SELECT id FROM e WHERE role = 'validation')) AS n_unvalidated, t AS max_tokens, id AS longest_id, fold AS longest_fold, role AS longest_role FROM m")
def q_sft_coverage(spark, d):
    return aggregates.preflight_coverage(_encoded(spark, d))


@query(f"WITH c AS ({CORPUS}) SELECT 'method' AS kind, method AS name, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'teacher', teacher, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'targets', sha256('[' || string_agg('\"' || target_sha256 || '\"', ',' ORDER BY problem_id) || ']'), count(*) FROM c HAVING count(*) > 0")
def q_corpus_counts(spark, d):
    return aggregates.corpus_counts(inputs.corpus(spark, d), ["problem_id"])


#: What is falsified in every so many rows. A record of every 47th row isn't known, one in 53 is in the holdout.
_FALSE = {"group_id": 11, "fold": 13, "question_sha256": 17, "completion_sha256": 19, "status": 23, "reference_answer": 29, "exact_match": 31, "prompt_sha256": 37, "seed": 41, "route": 43}
_OWN = ("completion_sha256", "status", "seed", "route")
_N = "CAST(id AS BIGINT)"
_PROMPT_SHA = f"""sha256('{{"add_generation_prompt":true,"messages":' || {_PROMPT} || '}}')"""


@query(" UNION ALL ".join([
    *(f"SELECT CASE WHEN {_N} % 47 = 0 THEN 'new-' || id ELSE id END AS id, '{c}' AS code FROM ({REC}) WHERE {_N} % {m} = 0" + ("" if c in _OWN else f" AND {_N} % 47 <> 0") for c, m in _FALSE.items()),
    f"SELECT 'new-' || id, 'unknown' FROM ({REC}) WHERE {_N} % 47 = 0", f"SELECT id, 'outside' FROM ({REC}) WHERE {_N} % 53 = 0 AND {_N} % 47 <> 0",
]))
def q_row_binding(spark, d):
    places = settled(_grouped(spark, d).select("record_id", "group_id", "partition", "fold"))
    records = inputs.records(spark, d).drop("fold")
    n = F.col("id").cast("long")
    own = records.join(places.withColumnRenamed("record_id", "id"), "id").withColumns({"problem_id": F.when(n % 47 == 0, F.concat(F.lit("new-"), "id")).otherwise(F.col("id")), "raw_completion": F.concat(F.lit("So.\nFinal answer: "), "answer")})
    right = {
        "group_id": F.col("group_id"), "fold": F.col("fold"), "question_sha256": F.sha2("question_raw", 256), "raw_completion_sha256": F.sha2("raw_completion", 256), "status": F.lit("ok"), "reference_answer": F.col("answer"), "exact_match": F.lit(True),
        "prompt_sha256": F.sha2(training.prompt_json(F.col("question_raw")), 256), "seed": T.deterministic_seed(F.col("problem_id"), F.lit(0), "s"), "route": F.lit("direct_answer"),
    }
    false = {"fold": F.col("fold") + 1, "exact_match": F.lit(False), "seed": F.lit(-1)}
    stored = own.select("problem_id", "raw_completion", *(F.when(n % _FALSE[c.removeprefix("raw_")] == 0, false.get(c, F.lit("x"))).otherwise(v).alias(c) for c, v in right.items()))
    sealed = places.withColumn("partition", F.when(F.col("record_id").cast("long") % 53 == 0, splits.HOLDOUT).otherwise(F.col("partition")))
    return validation.row_binding_issues(stored, records, sealed, "s", training.SYSTEM, {"route": "direct_answer"})


@query(f"SELECT id, {_PROMPT_SHA} AS prompt_sha256 FROM ({REC})")
def q_prompt_json_sha(spark, d):
    return inputs.records(spark, d).select("id", F.sha2(training.prompt_json(F.col("question_raw")), 256).alias("prompt_sha256"))
