"""Queries over ledgers, runs, corpora, records in the making, and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.operators import aggregates, classifier, ledger, training, validation
from sievelight.plans import dialect as D
from sievelight.plans import inputs
from sievelight.plans.registry import query
from sievelight.session import table
from sievelight.sources import files

ATT, RES, PLAN = inputs.SQL["attempts"], inputs.SQL["results"], inputs.SQL["plan"]
_TRIED = f"SELECT unnest(input_ids) AS problem_id, status = 'parsed' AND NOT assessed AS open FROM ({ATT})"
_STATES = f"""SELECT problem_id, coalesce(n, 0) AS n_attempts, CASE WHEN problem_id IN (SELECT problem_id FROM ({RES}) WHERE status = 'accepted') THEN 'accepted' WHEN open THEN 'unassessed' WHEN coalesce(n, 0) >= 60 THEN 'exhausted' ELSE 'pending' END AS state
 FROM ({PLAN}) LEFT JOIN (SELECT problem_id, count(*) AS n, bool_or(open) AS open FROM ({_TRIED}) GROUP BY 1) USING (problem_id)"""


@query(f"SELECT *, CASE state WHEN 'accepted' THEN 'done' WHEN 'unassessed' THEN 'assess' WHEN 'exhausted' THEN 'review' ELSE 'retry' END AS next_action FROM ({_STATES})")
def q_ledger_state(spark, d):
    return ledger.states(inputs.plan(spark, d), inputs.attempts(spark, d), inputs.results(spark, d), 60)


@query(f"SELECT state, count(*) AS n, sum(n_attempts) AS n_attempts FROM ({_STATES}) GROUP BY 1")
def q_ledger_summary(spark, d):
    rows = ledger.states(inputs.plan(spark, d), inputs.attempts(spark, d), inputs.results(spark, d), 60)
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.sum("n_attempts").alias("n_attempts"))


@query(f"SELECT problem_id, count(*) AS n_attempts FROM ({_TRIED}) GROUP BY 1 HAVING count(*) > 3")
def q_attempt_budget(spark, d):
    return ledger.over_budget(inputs.attempts(spark, d))


@query(f"SELECT count(*) AS n_first, count(*) FILTER (problem_id IN (SELECT problem_id FROM ({RES}) WHERE attempt_number = 1 AND status = 'accepted')) AS n_accepted FROM (SELECT DISTINCT unnest(input_ids) AS problem_id FROM ({ATT}) WHERE attempt_number = 1)")
def q_first_pass(spark, d):
    return ledger.first_pass(inputs.attempts(spark, d), inputs.results(spark, d))


@query(f"SELECT status, count(*) AS n, round(CAST(sum(latency_ms) AS DOUBLE), 6) AS latency_total, round(CAST(sum(latency_ms) AS DOUBLE) / count(*), 6) AS latency_mean FROM ({ATT}) GROUP BY 1")
def q_attempt_summary(spark, d):
    return ledger.attempt_summary(inputs.attempts(spark, d))


@query(f"SELECT 'input_tokens' AS key, CAST(sum(k) AS BIGINT) AS total FROM ({ATT}) UNION ALL SELECT 'output_tokens', CAST(sum(2 * k) AS BIGINT) FROM ({ATT})")
def q_usage_totals(spark, d):
    return ledger.usage_totals(inputs.attempts(spark, d))


@query(f"SELECT chunk_index, max(attempt_number) FILTER (status = 'parsed') AS attempt_number, arg_max(event_id, attempt_number) FILTER (status = 'parsed') AS event_id, count(*) FILTER (status <> 'parsed') AS n_invalid FROM ({ATT}) GROUP BY 1 HAVING count(*) FILTER (status = 'parsed') > 0")
def q_latest_valid(spark, d):
    rows = inputs.attempts(spark, d).select("chunk_index", "attempt_number", "event_id", (F.col("status") == "parsed").alias("valid"))
    return ledger.latest_valid(rows, ["chunk_index"])


@query(f"SELECT problem_id AS id, 'accepted_twice' AS code FROM ({RES}) WHERE status = 'accepted' GROUP BY 1 HAVING count(*) > 1")
def q_accepted_issues(spark, d):
    return ledger.accepted_issues(inputs.results(spark, d), inputs.plan(spark, d))


@query("SELECT id, CAST((rn - 1) // 25 AS BIGINT) AS chunk_index, (rn - 1) % 25 AS position FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS rn FROM orders)")
def q_chunks(spark, d):
    return ledger.chunks(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id")), 25)


@query(f"SELECT problem_id AS id, CAST((rn - 1) // 16 AS BIGINT) AS chunk_index, (rn - 1) % 16 AS position FROM (SELECT problem_id, row_number() OVER (ORDER BY problem_id) AS rn FROM ({_STATES}) WHERE state = 'pending')")
def q_repair_chunks(spark, d):
    return ledger.repair_chunks(ledger.states(inputs.plan(spark, d), inputs.attempts(spark, d), inputs.results(spark, d), 60))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, sha256('audit' || chr(0) || 'plan-1' || chr(0) || CAST(o_orderkey AS VARCHAR)) AS sample_key FROM orders ORDER BY 2 LIMIT 64")
def q_hash_sample(spark, d):
    return ledger.hash_sample(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id")), 64, "audit", "plan-1")


@query("SELECT count(*) AS n, count(*) FILTER (o_custkey % 50 > 0) AS n_consistent, count(*) = 64 AND count(*) FILTER (o_custkey % 50 > 0) >= 60 AS passed FROM (SELECT * FROM orders ORDER BY sha256('audit' || chr(0) || 'plan-1' || chr(0) || CAST(o_orderkey AS VARCHAR)) LIMIT 64)")
def q_audit_verdict(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 50 > 0).alias("consistent"))
    sample = ledger.hash_sample(orders, 64, "audit", "plan-1")
    return ledger.audit_verdict(orders.join(sample.select("id"), "id", "left_semi"))


_COUNTS = "SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS returned, [1, 2, 3, 4] AS expected FROM lineitem GROUP BY 1"


@query(f"SELECT l_orderkey, len(returned) AS returned_count, len(list_filter(expected, lambda x: NOT list_contains(returned, x))) AS missing_count, len(list_distinct(list_filter(returned, lambda x: NOT list_contains(expected, x)))) AS unexpected_count, len(returned) - len(list_distinct(returned)) AS duplicate_count, returned <> expected AS order_mismatch FROM ({_COUNTS})")
def q_id_counts(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("returned")).withColumn("expected", F.array(*map(F.lit, (1, 2, 3, 4))))
    return ledger.id_counts(lines).select("l_orderkey", "returned_count", "missing_count", "unexpected_count", "duplicate_count", "order_mismatch")


_FAULT = "CASE WHEN event_id % 8 = 0 THEN 'timeout_spawn/timeout' WHEN event_id % 8 = 1 THEN 'event_json/malformed_event_json' WHEN event_id % 8 = 2 THEN 'terminal_usage/missing_terminal_event' WHEN event_id % 8 = 3 THEN 'agent_json/missing_agent_message' WHEN event_id % 8 = 4 THEN 'output_structure/id_set_mismatch' WHEN event_id % 8 = 5 THEN 'target_policy/wrong_target' ELSE 'success/qualified' END"


@query(f"SELECT split_part(f, '/', 1) AS stage, split_part(f, '/', 2) AS code, count(*) AS n FROM (SELECT {_FAULT} AS f FROM events) GROUP BY ALL")
def q_classify(spark, d):
    """Runner results made from the events, with six kinds of fault."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("u"), (F.col("event_id") % 8).alias("m"))
    answer = F.when(F.col("m") == 5, "8").otherwise("7")
    target = F.concat(F.lit("We add the two parts of the sum.\nFinal answer: "), answer)
    item = F.struct(F.when(F.col("m") == 4, "zz").otherwise(F.col("u")).alias("problem_id"), target.alias("target_text"))
    message = F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.to_json(F.struct(F.array(item).alias("items"))).alias("text")).alias("item")))
    start, end = F.lit('{"type":"turn.started"}'), F.lit('{"type":"turn.completed","usage":{"input_tokens":5,"cached_input_tokens":0,"output_tokens":9}}')
    lines = F.concat_ws("\n", start, F.when(F.col("m") == 1, "{broken"), F.when(F.col("m") != 3, message), F.when(F.col("m") != 2, end))
    rows = e.select("event_id", F.when(F.col("m") == 0, 124).otherwise(0).alias("returncode"), F.lit(None).cast("string").alias("failure_reason"), lines.alias("stdout"), F.array("u").alias("expected"), F.create_map("u", F.lit("7")).alias("answers"))
    return classifier.classify(rows).groupBy("stage", "code").agg(F.count("*").alias("n"))


#: Every outcome in the classifier's order, with what makes it: return code, event lines (b: the answer, e: the end).
_OUTCOMES = {
    "success/qualified": "b e", "process/runner_exception": "b e", "timeout_spawn/timeout": "b e", "timeout_spawn/spawn_failure": "b e", "nonzero/command_nonzero": "b e", "event_json/malformed_event_json": "broken e",
    "unsafe_error_event/unsafe_event_type": "odd failed e", "unsafe_error_event/error_event": "failed odd e", "unsafe_error_event/invalid_item_event": "bare tool e", "unsafe_error_event/unsafe_item": "tool odd e",
    "terminal_usage/multiple_terminal_events": "b e e", "terminal_usage/invalid_usage": "b minus", "terminal_usage/missing_terminal_event": "b", "terminal_usage/terminal_not_final": "e b", "agent_json/missing_agent_message": "e",
    "agent_json/multiple_agent_messages": "b b e", "agent_json/malformed_agent_json": "nope e", "output_schema/invalid_output_schema": "rows e", "output_schema/invalid_item_schema": "part e", "output_structure/cardinality_mismatch": "one e",
    "output_structure/id_set_mismatch": "other e", "output_structure/duplicate_ids": "twice e", "output_structure/order_mismatch": "turned e", "target_policy/target_policy_invalid": "curt e", "target_policy/wrong_target": "wrong e",
}


@query(f"SELECT split_part(f, '/', 1) AS stage, split_part(f, '/', 2) AS code, event_type, count(*) AS n FROM (SELECT event_type, list_extract([{', '.join(map(D.lit, _OUTCOMES))}], CAST((event_id + user_id) % {len(_OUTCOMES)} AS INTEGER) + 1) AS f FROM events) GROUP BY ALL")
def q_classify_all(spark, d):
    """Runner results made from the events, with every outcome of the classifier, by event type."""
    e = table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("p"), F.concat(F.col("user_id").cast("string"), F.lit("-b")).alias("q"), F.pmod(F.col("event_id") + F.col("user_id"), F.lit(len(_OUTCOMES))).cast("int").alias("m"))
    p, q = F.col("p"), F.col("q")
    item = lambda i, a="7": F.struct(i.alias("problem_id"), F.lit("We add the two parts of the sum.\nFinal answer: " + a).alias("target_text"))
    curt = F.struct(q.alias("problem_id"), F.lit("7").alias("target_text"))
    said = lambda text: F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("agent_message").alias("type"), text.alias("text")).alias("item")))
    items = lambda *xs: said(F.to_json(F.struct(F.array(*xs).alias("items"))))
    lines = {
        "b": items(item(p), item(q)), "e": F.lit('{"type":"turn.completed","usage":{"tokens": 5, "cached":0}}'), "minus": F.lit('{"type":"turn.completed","usage":{"tokens":-5}}'), "broken": F.lit("{broken"), "odd": F.lit('{"type":"odd"}'), "failed": F.lit('{"type":"turn.started","error":null}'),
        "bare": F.lit('{"type":"item.started"}'), "tool": F.lit('{"type":"item.started","item":{"type":"tool"}}'), "nope": said(F.lit("nope")), "rows": said(F.lit('{"rows":[]}')), "part": items(F.struct(p.alias("problem_id"))), "one": items(item(p)), "other": items(item(p), item(F.lit("zz"))),
        "twice": items(item(p), item(q), item(q)), "turned": items(item(q), item(p)), "curt": items(item(p), curt), "wrong": items(item(p), item(q, "8")),
    }
    made = F.element_at(F.array(*(F.concat_ws("\n", F.lit('{"type":"turn.started"}'), *(lines[x] for x in how.split())) for how in _OUTCOMES.values())), F.col("m") + 1)
    expected = F.when(F.col("m") == list(_OUTCOMES).index("output_structure/duplicate_ids"), F.array(p, q, q)).otherwise(F.array(p, q))
    code = F.element_at(F.array(*(F.lit({"timeout_spawn/timeout": 124, "timeout_spawn/spawn_failure": 127, "nonzero/command_nonzero": 1}.get(x, 0)) for x in _OUTCOMES)), F.col("m") + 1)
    rows = e.select("event_type", code.alias("returncode"), F.when(F.col("m") == 1, "runner_exception").alias("failure_reason"), made.alias("stdout"), expected.alias("expected"), F.create_map(p, F.lit("7"), q, F.lit("7")).alias("answers"))
    return classifier.classify(rows).groupBy("stage", "code", "event_type").agg(F.count("*").alias("n"))


#: Development is the generation of a customer's orders, training the one unit of an order; both by what the tables say.
_DEV = "SELECT 'development_generation' AS stage, CAST(o_custkey AS VARCHAR) AS id, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'complete' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'planned' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'running' ELSE 'interrupted' END AS s, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) AS total, sha256('c' || CAST(o_custkey AS VARCHAR)) AS contract, CAST(NULL AS VARCHAR) AS completion FROM orders GROUP BY o_custkey"
_TRAIN = "SELECT 'fold_training', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderpriority = '1-URGENT' THEN 'terminal_failed' WHEN o_orderpriority = '2-HIGH' THEN 'retryable' ELSE 'ready' END, 0, 1, sha256('o' || CAST(o_orderkey AS VARCHAR)), CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN sha256('done' || CAST(o_orderkey AS VARCHAR)) END FROM orders"
_STATUS_ROWS = f"""SELECT stage, id, CASE s WHEN 'planned' THEN 'ready' WHEN 'interrupted' THEN 'retryable' ELSE s END AS state, s IN ('complete', 'terminal_failed') AS terminal, s IN ('planned', 'interrupted', 'ready', 'retryable') AS resume_allowed, false AS repair_allowed,
 CASE WHEN stage = 'fold_training' THEN CASE s WHEN 'ready' THEN 'start_training' WHEN 'running' THEN 'wait_for_training' WHEN 'retryable' THEN 'resume_training' WHEN 'terminal_failed' THEN 'record_terminal_training_failure' ELSE 'verify_adapter_artifact' END ELSE CASE s WHEN 'planned' THEN 'start_development' WHEN 'running' THEN 'wait_for_development' WHEN 'interrupted' THEN 'resume_development' ELSE 'verify_development_artifact' END END AS next_action,
 CASE WHEN s = 'terminal_failed' THEN 'no_complete_resume_checkpoint' ELSE '' END AS blockers, CASE WHEN stage = 'fold_training' THEN CAST(s = 'complete' AS BIGINT) ELSE completed END AS completed_count, total AS total_count, coalesce(completion, contract) AS artifact_sha256 FROM ({_DEV} UNION ALL {_TRAIN})"""


def _workflows(spark, d):
    orders = table(spark, d, "orders")
    done, held = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "P")
    dev = orders.groupBy("o_custkey").agg(done.alias("completed"), F.count("*").alias("total"), held.alias("held"))
    state = F.when(F.col("completed") == F.col("total"), "complete").when(F.col("completed") == 0, "planned").when(F.col("held") > 0, "running").otherwise("interrupted")
    cust, key = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    dev = dev.select(F.lit("development_generation").alias("stage"), cust.alias("id"), state.alias("ledger_state"), "completed", "total", F.sha2(F.concat(F.lit("c"), cust), 256).alias("contract_sha256"), F.lit(None).cast("string").alias("completion_sha256"))
    status, first = F.col("o_orderstatus"), F.col("o_orderpriority")
    state = F.when(status == "F", "complete").when(status == "P", "running").when(first == "1-URGENT", "terminal_failed").when(first == "2-HIGH", "retryable").otherwise("ready")
    end = F.when((status == "F") & (F.col("o_orderkey") % 2 == 0), F.sha2(F.concat(F.lit("done"), key), 256))
    train = orders.select(F.lit("fold_training").alias("stage"), key.alias("id"), state.alias("ledger_state"), F.lit(0).cast("long").alias("completed"), F.lit(1).cast("long").alias("total"), F.sha2(F.concat(F.lit("o"), key), 256).alias("contract_sha256"), end.alias("completion_sha256"))
    return ledger.workflow_status(dev.unionByName(train))


@query(_STATUS_ROWS)
def q_workflow_status(spark, d):
    """The shared status of two kinds of resume ledgers, all nine states."""
    rows = _workflows(spark, d).withColumn("blockers", F.concat_ws(",", "blockers"))
    return rows.select("stage", "id", "state", "terminal", "resume_allowed", "repair_allowed", "next_action", "blockers", "completed_count", "total_count", "artifact_sha256")


@query(f"SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN i % 3 = 0 THEN 'stage' END, CASE WHEN i % 5 = 0 THEN 'counts' END, CASE WHEN i % 7 = 0 THEN 'artifact_sha256' END, CASE WHEN i % 11 = 0 THEN 'flags' END, CASE WHEN i % 13 = 0 THEN 'blockers' END], lambda x: x IS NOT NULL)) AS code FROM (SELECT CAST(id AS BIGINT) AS i FROM ({_STATUS_ROWS}) WHERE stage = 'fold_training')) GROUP BY 1")
def q_workflow_issues(spark, d):
    """Training statuses with five kinds of planted breach."""
    rows, i = _workflows(spark, d).where("stage = 'fold_training'"), F.col("id").cast("long")
    broken = rows.withColumns({"stage": F.when(i % 3 == 0, " fold_training").otherwise(F.col("stage")), "completed_count": F.when(i % 5 == 0, F.col("total_count") + 1).otherwise(F.col("completed_count")), "artifact_sha256": F.when(i % 7 == 0, F.upper(F.concat(F.lit("x"), "artifact_sha256"))).otherwise(F.col("artifact_sha256"))})
    broken = broken.withColumns({"terminal": F.when(i % 11 != 0, F.col("terminal")), "blockers": F.when(i % 13 == 0, F.array(F.lit(""))).otherwise(F.col("blockers"))})
    return ledger.workflow_issues(broken, "id").groupBy("code").agg(F.count("*").alias("n"))


RUNS = inputs.SQL["runs"]


@query(f"""SELECT route, count(*) AS n_rows, count(*) AS n_ok, 0 AS n_conflict, 0 AS n_invalid, count(*) FILTER (finish_reason = 'eos') AS n_eos, count(*) FILTER (finish_reason = 'length') AS n_length, count(*) FILTER (exact_match) AS n_exact, round(count(*) FILTER (exact_match) / count(*), 9) AS accuracy,
 CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, max(peak_bytes) AS peak_bytes, round(CAST(sum(latency_ms) AS DOUBLE), 6) AS latency_total, round(CAST(min(latency_ms) AS DOUBLE), 6) AS latency_min, round(CAST(max(latency_ms) AS DOUBLE), 6) AS latency_max, round(CAST(sum(latency_ms) AS DOUBLE) / count(latency_ms), 6) AS latency_mean FROM ({RUNS}) GROUP BY 1""")
def q_run_manifest(spark, d):
    return aggregates.run_manifest(inputs.runs(spark, d), ["route"])


@query("SELECT problem_id AS id, 'completion_sha' AS code FROM (SELECT CAST(l_orderkey AS VARCHAR) AS problem_id, l_partkey FROM lineitem) WHERE l_partkey % 10 = 0 UNION ALL SELECT NULL, 'inconsistent_route'")
def q_run_issues(spark, d):
    sha = F.when(F.col("input_tokens") % 10 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("completion", 256))
    return validation.run_issues(inputs.runs(spark, d).withColumn("completion_sha256", sha), ["route"])


_PER = "SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1"


@query(f"SELECT id, 'repeated_index' AS code FROM ({_PER}) WHERE d < n UNION ALL SELECT id, 'not_contiguous' FROM ({_PER}) WHERE lo <> 0 OR hi <> d - 1 UNION ALL SELECT id, 'uneven' FROM ({_PER}) WHERE n <> (SELECT max(n) FROM ({_PER}))")
def q_sample_index_issues(spark, d):
    return validation.sample_index_issues(inputs.runs(spark, d))


_BAD = """SELECT CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN ' ' || CAST(k AS VARCHAR) WHEN k % 10 = 2 THEN 'twin' || CAST(k // 100 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS id, CASE WHEN k % 10 = 3 THEN '  ' WHEN k % 10 = 4 THEN NULL ELSE 'q' END AS question_raw,
 CASE WHEN k % 10 = 5 THEN '01' WHEN k % 10 = 6 THEN '' WHEN k % 10 = 7 THEN '1.5' ELSE '3' END AS answer FROM (SELECT o_orderkey AS k FROM orders)"""


@query(f"SELECT id, 'missing_id' AS code FROM ({_BAD}) WHERE id = '' UNION ALL SELECT id, 'untrimmed_id' FROM ({_BAD}) WHERE trim(id) <> id UNION ALL SELECT id, 'blank_question' FROM ({_BAD}) WHERE question_raw IS NULL OR trim(question_raw) = '' UNION ALL SELECT id, 'missing_answer' FROM ({_BAD}) WHERE answer = '' UNION ALL SELECT id, 'noncanonical_answer' FROM ({_BAD}) WHERE answer IN ('01', '1.5') UNION ALL SELECT id, 'duplicate_id' FROM ({_BAD}) GROUP BY id HAVING count(*) > 1")
def q_record_issues(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    rows = table(spark, d, "orders").select(
        F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit(" "), s)).when(k % 10 == 2, F.concat(F.lit("twin"), F.floor(k / 100).cast("string"))).otherwise(s).alias("id"), F.when(k % 10 == 3, "  ").when(k % 10 != 4, "q").alias("question_raw"),
        F.when(k % 10 == 5, "01").when(k % 10 == 6, "").when(k % 10 == 7, "1.5").otherwise("3").alias("answer"),
    )
    return validation.record_issues(rows)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'unknown_id' AS code FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)")
def q_exclusion_issues(spark, d):
    excluded = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return validation.exclusion_issues(excluded, inputs.records(spark, d))


CORPUS = inputs.SQL["corpus"]
_N = "CAST(problem_id AS BIGINT)"


@query(f"""SELECT problem_id AS id, 'target_sha' AS code FROM ({CORPUS}) WHERE {_N} % 23 = 0 UNION ALL SELECT c.problem_id, unnest(['answer', 'parser']) FROM ({CORPUS}) c JOIN ({inputs.SQL['records']}) r ON r.id = c.problem_id WHERE {_N} % 19 = 0 AND r.answer <> '7' UNION ALL SELECT problem_id, 'method' FROM ({CORPUS}) WHERE {_N} % 29 = 0
 UNION ALL SELECT problem_id, 'rationale_length' FROM ({CORPUS}) WHERE {_N} % 31 = 0 UNION ALL SELECT problem_id, 'rationale_lines' FROM ({CORPUS}) WHERE {_N} % 37 = 0 AND {_N} % 31 <> 0""")
def q_corpus_issues(spark, d):
    return validation.corpus_issues(inputs.corpus(spark, d), inputs.records(spark, d))


@query(f"SELECT count(*) AS n_rows, min(length(rationale)) AS chars_min, max(length(rationale)) AS chars_max, round(avg(length(rationale)), 6) AS chars_mean, max(length(rationale) - length(replace(rationale, chr(10), '')) + 1) AS lines_max, count(DISTINCT method) AS n_methods, count(DISTINCT teacher) AS n_teachers FROM ({CORPUS})")
def q_corpus_audit(spark, d):
    rationale, _ = validation.rationale_columns(F.col("target_text"))
    return aggregates.corpus_audit(inputs.corpus(spark, d).withColumn("rationale", rationale))


@query(f"SELECT problem_id, sha256(target_text) AS target_sha256, CASE WHEN {_N} % 19 <> 0 OR r.answer = '7' THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN {_N} % 19 <> 0 OR r.answer = '7' THEN 'reference_answer_exact_match' ELSE 'answer_mismatch' END AS reason FROM ({CORPUS}) c JOIN ({inputs.SQL['records']}) r ON r.id = c.problem_id")
def q_assessment(spark, d):
    return ledger.assess(inputs.corpus(spark, d), inputs.records(spark, d))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, 'truncated' AS code FROM lineitem WHERE l_linenumber + 3 > 8 UNION ALL SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 'prompt_labels' FROM lineitem WHERE l_quantity = 7")
def q_encoding_issues(spark, d):
    n = F.col("l_linenumber").cast("int")
    prompt = F.array(F.lit(11), F.lit(12), F.lit(13))
    response = F.sequence(F.lit(1), n)
    labels = F.concat(F.when(F.col("l_quantity") == 7, F.array(*map(F.lit, (-100, 12, -100)))).otherwise(F.array_repeat(F.lit(-100), 3)), response)
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("id"), prompt.alias("prompt_ids"), F.concat(prompt, response).alias("input_ids"), labels.alias("labels"), F.lit(8).alias("max_length"))
    return validation.encoding_issues(rows)


_JSON = lambda x: f"replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
_PROMPT = "'[{\"content\":\"" + training.SYSTEM + "\",\"role\":\"system\"},{\"content\":\"' || " + _JSON("question_raw") + " || '\",\"role\":\"user\"}]'"


@query(f"SELECT id, sha256({_PROMPT}) AS prompt_sha256 FROM ({inputs.SQL['records']})")
def q_prompt_sha(spark, d):
    return inputs.records(spark, d).select("id", training.prompt_sha256(training.prompt_messages(F.col("question_raw"))).alias("prompt_sha256"))


_GROUPED = f"SELECT id AS record_id, min(id) OVER (PARTITION BY source_fp) AS group_id, fold, question_raw, answer FROM ({D.views(inputs.SQL['records'])})"
_TOXIC = "SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1"


@query(f"WITH g AS ({_GROUPED}) SELECT record_id, group_id, fold, 'Final answer: ' || answer AS target, sha256({_PROMPT}) AS prompt_sha256 FROM g WHERE fold <> 1 AND group_id NOT IN (SELECT group_id FROM g WHERE record_id IN ({_TOXIC}))")
def q_sft_examples(spark, d):
    from sievelight.plans.text_queries import _grouped, _toxic

    return training.sft_examples(inputs.records(spark, d).drop("fold"), _grouped(spark, d), _toxic(spark, d), 1).drop("messages")


@query(f"SELECT conv_id, count(*) AS n_turns, sha256('[' || string_agg('{{\"content\":\"' || {_JSON('text')} || '\",\"role\":\"' || role || '\"}}', ',' ORDER BY turn) || ']') AS messages_sha256 FROM conversations GROUP BY 1")
def q_conversations(spark, d):
    rows = training.conversation_messages(table(spark, d, "conversations"))
    return rows.select("conv_id", "n_turns", training.prompt_sha256(F.col("messages")).alias("messages_sha256"))


_LINE = "'{\"answer\":\"' || answer || '\",\"fold\":' || CAST(fold AS VARCHAR) || ',\"id\":\"' || id || '\",\"note\":null}'"


@query(f"SELECT id, {_LINE} AS line FROM ({inputs.SQL['records']})")
def q_canonical_json(spark, d):
    return inputs.records(spark, d).select("id", T.canonical_json(id=F.col("id"), answer=F.col("answer"), fold=F.col("fold"), note=F.lit(None).cast("string")).alias("line"))


@query("SELECT o_custkey, sha256('[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']') AS ids_sha256 FROM orders GROUP BY 1")
def q_ids_sha(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(T.ids_sha256(F.sort_array(F.collect_list("o_orderkey"))).alias("ids_sha256"))  # the orders of one customer


@query("SELECT CAST(event_id AS VARCHAR) AS id, ts, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def q_first_seen(spark, d):
    rows = validation.first_seen(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return rows.select(F.col("event_id").cast("string").alias("id"), "ts", "user_id", "event_type")


@query()
def q_file_manifest(spark, d):
    return files.file_manifest(spark, d, (".parquet",), ("tmp",))


@query()
def q_tree_sha(spark, d):
    return files.tree_sha256(files.file_manifest(spark, d, (".parquet",)))


@query("SELECT 'train-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS problem_id, 'Compute the signed integer sum (' || CAST(i * 37 % 199 - 99 AS VARCHAR) || ') + (' || CAST(i * 53 % 211 - 105 AS VARCHAR) || ').' AS question, CAST((i * 37 % 199 - 99) + (i * 53 % 211 - 105) AS VARCHAR) AS expected_answer FROM (SELECT o_orderkey, o_custkey AS i FROM orders)")
def q_fixture(spark, d):
    return files.fixture_of(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("number")))


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_stream_hours(spark, d):
    """Structured Streaming over the events: hourly counts per type, run until what is there is consumed."""
    from sievelight.streaming import attempts as stream

    return stream.hourly(spark, f"{d}/events.parquet")


_IN_ORDER = "problem_id, sample_index, seed, completion"


@query(f"""WITH r AS ({RUNS}) SELECT route, 'latency_ms' AS name, count(*) AS n, round(CAST(sum(CAST(latency_ms AS DECIMAL(20,6))) AS DOUBLE), 6) AS total, NULL AS sha256 FROM r GROUP BY 1
UNION ALL SELECT NULL, 'seed', count(*), NULL, sha256('[' || string_agg(CAST(seed AS VARCHAR), ',' ORDER BY {_IN_ORDER}) || ']') FROM r UNION ALL SELECT NULL, 'completion', count(*), NULL, sha256('[' || string_agg('"' || replace(completion, chr(10), chr(92) || 'n') || '"', ',' ORDER BY {_IN_ORDER}) || ']') FROM r""")
def q_generation_evidence(spark, d):
    """Exact latency totals of each route, and the digests of seeds and completions in the order of problems and samples."""
    rows = inputs.runs(spark, d)
    sums = aggregates.exact_sum(rows, "latency_ms", ["route"]).join(rows.groupBy("route").agg(F.count("latency_ms").alias("n")), "route")
    sums = sums.select("route", F.lit("latency_ms").alias("name"), "n", F.round("total", 6).alias("total"), F.lit(None).cast("string").alias("sha256"))
    told = aggregates.sequence_sha256(rows, ["problem_id", "sample_index", "seed", "completion"], ["seed", "completion"])
    return sums.unionByName(told.select(F.lit(None).cast("string").alias("route"), F.col("column").alias("name"), "n", F.lit(None).cast("double").alias("total"), "sha256"))
