"""The attempt ledger: chunks of problems, attempts at them, assessments, and what is still to do.

Attempts: (chunk_index, attempt_number, input_ids array, status, assessed boolean, latency_ms, usage map).
Results: (problem_id, status) with status accepted or rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions.answers import parse_answer
from sievelight.functions.text import sha256
from sievelight.operators.ranking import numbered

# ---- fixed values: what follows each state -----------------------------------------------------------------
NEXT_ACTION = {"unassessed": "assess", "pending": "retry", "exhausted": "review", "accepted": "done"}
EVENT_TYPES = ("thread.started", "turn.started", "turn.completed", "turn.failed", "item.started", "item.updated", "item.completed", "error")
#: By stage and state of a resume ledger: shared state, terminal, resume_allowed, next_action, blockers.
WORKFLOW = {
    "development_generation": {
        "planned": ("ready", False, True, "start_development", ()),
        "running": ("running", False, False, "wait_for_development", ()),
        "interrupted": ("retryable", False, True, "resume_development", ()),
        "complete": ("complete", True, False, "verify_development_artifact", ()),
    },
    "fold_training": {
        "ready": ("ready", False, True, "start_training", ()),
        "running": ("running", False, False, "wait_for_training", ()),
        "retryable": ("retryable", False, True, "resume_training", ()),
        "terminal_failed": ("terminal_failed", True, False, "record_terminal_training_failure", ("no_complete_resume_checkpoint",)),
        "complete": ("complete", True, False, "verify_adapter_artifact", ()),
    },
}
WORKFLOW_STATES = ("ready", "running", "qualified", "retryable", "terminal_failed", "complete")
# ---- end of fixed values ---------------------------------------------------------------------------------


def chunks(ids: DataFrame, size: int, id_col: str = "id", digest: str | None = None) -> DataFrame:
    """(id, chunk_index, position): ids in order, cut into chunks of ``size``.

    Sorted ids are numbered through a range exchange per 4,096 digest buckets when ``digest`` (a hex order column) is
    given; else in the ids' own order, by counting the rows before each range partition.
    """
    if digest is not None:
        rows = numbered(ids.select(id_col, digest), [digest, id_col])
    else:
        rows = in_order(ids.select(id_col), id_col)
    return rows.select(F.col(id_col).alias("id"), F.floor((F.col("rn") - 1) / size).cast("long").alias("chunk_index"), F.pmod(F.col("rn") - 1, F.lit(size)).cast("long").alias("position"))


def in_order(df: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """``df`` with its row numbers by ``key``: a range exchange, the count of each partition, and places within them.

    Rows are sorted and get their places before they are settled, so they aren't moved again to be numbered: they stay in
    their range partitions, in order.
    """
    from sievelight.session import settled

    place = F.monotonically_increasing_id()  # the partition, and below it 33 bits for the place in it
    parts = settled(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__m", place)).withColumn("__p", F.shiftright("__m", 33))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    base = parts.groupBy("__p").agg(F.count("*").alias("__c")).select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    number = F.col("__base") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(base), "__p").withColumn(name, number).select(*df.columns, name)


def hash_sample(ids: DataFrame, k: int, namespace: str, plan: str, id_col: str = "id") -> DataFrame:
    """The k ids with the least digests of (namespace, plan, id): a sample that depends on nothing else."""
    key = sha256(F.concat_ws("\u0000", F.lit(namespace), F.lit(plan), F.col(id_col).cast("string")))
    return ids.select(F.col(id_col).alias("id"), key.alias("sample_key")).orderBy("sample_key", "id").limit(k)


def latest_valid(attempts: DataFrame, keys: list[str], order: str = "attempt_number", valid: str = "valid") -> DataFrame:
    """Per key the valid attempt with the highest number, and how many attempts were invalid; keys without a valid one are absent."""
    best = F.max(F.when(F.col(valid), F.struct(F.col(order).alias("o"), F.struct(*(c for c in attempts.columns if c not in (*keys, order, valid))).alias("rest")))).alias("b")
    return attempts.groupBy(*keys).agg(best, F.count_if(~F.coalesce(F.col(valid), F.lit(False))).alias("n_invalid")).where("b IS NOT NULL").select(*keys, F.col("b.o").alias(order), "b.rest.*", "n_invalid")


def assess(items: DataFrame, records: DataFrame) -> DataFrame:
    """(problem_id, target_sha256, status, reason) of returned items (problem_id, target_text) against the records' answers."""
    joined = items.join(records.select(F.col("id").alias("problem_id"), F.col("answer").alias("__a")), "problem_id").withColumn("__p", parse_answer(F.col("target_text")))
    reason = F.when((F.col("__p.status") != "ok") | (F.col("__p.source") != "final_answer"), "parser_invalid").when(F.col("__p.value") == F.col("__a"), "reference_answer_exact_match").otherwise("answer_mismatch")
    return joined.select("problem_id", F.sha2("target_text", 256).alias("target_sha256"), F.when(reason == "reference_answer_exact_match", "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))


def states(plan: DataFrame, attempts: DataFrame, results: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(problem_id, n_attempts, state, next_action) of every planned problem.

    accepted: some result says so; unassessed: a parsed attempt on it waits for its assessment; else exhausted or
    pending by the number of attempts.
    """
    tried = attempts.select(F.explode("input_ids").alias("problem_id"), ((F.col("status") == "parsed") & ~F.coalesce(F.col("assessed"), F.lit(False))).alias("open"))
    tally = tried.groupBy("problem_id").agg(F.count("*").alias("n"), F.max(F.col("open").cast("int")).alias("open"))
    done = results.where("status = 'accepted'").select("problem_id").distinct().withColumn("done", F.lit(True))
    joined = plan.select("problem_id").join(tally, "problem_id", "left").join(done, "problem_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    state = F.when(F.col("done"), "accepted").when(F.col("open") == 1, "unassessed").when(n >= max_attempts, "exhausted").otherwise("pending")
    return joined.select("problem_id", n.alias("n_attempts"), state.alias("state")).withColumn("next_action", next_action(F.col("state")))


def next_action(state):
    return F.create_map(*(F.lit(x) for kv in NEXT_ACTION.items() for x in kv))[state]


def workflow_status(ledgers: DataFrame) -> DataFrame:
    """The shared status of resume ledgers (stage, ledger_state, completed, total, contract_sha256, completion_sha256).

    Adds state, terminal, resume_allowed, repair_allowed, next_action, blockers, completed_count, total_count and
    artifact_sha256. Training is one unit of work, done or not, whose artifact is that of its completion where there is
    one; generation counts what was generated, under its contract. Reading an unknown stage or state raises.
    """
    what = "struct<state:string,terminal:boolean,resume_allowed:boolean,next_action:string,blockers:array<string>>"
    pairs = [(f"{stage}/{s}", to) for stage, states in WORKFLOW.items() for s, to in states.items()]
    told = F.create_map(*(c for k, to in pairs for c in (F.lit(k), F.struct(*map(F.lit, to[:4]), F.array(*map(F.lit, to[4])).cast("array<string>")).cast(what))))
    name = F.concat("stage", F.lit("/"), "ledger_state")
    s = F.coalesce(told[name], F.raise_error(F.concat(F.lit("unsupported state: "), F.coalesce(name, F.lit("none")))).cast(what))
    training = F.col("stage") == "fold_training"
    rows = ledgers.withColumn("__s", s)
    return rows.withColumns({
        "state": F.col("__s.state"), "terminal": F.col("__s.terminal"), "resume_allowed": F.col("__s.resume_allowed"), "repair_allowed": F.lit(False), "next_action": F.col("__s.next_action"), "blockers": F.col("__s.blockers"),
        "completed_count": F.when(training, (F.col("ledger_state") == "complete").cast("long")).otherwise(F.col("completed").cast("long")), "total_count": F.when(training, F.lit(1).cast("long")).otherwise(F.col("total").cast("long")),
        "artifact_sha256": F.when(training, F.coalesce("completion_sha256", "contract_sha256")).otherwise(F.col("contract_sha256")),
    }).drop("__s")


def workflow_issues(status: DataFrame, key: str) -> DataFrame:
    """(id, code) of statuses that break the shared contract; nulls break it too."""
    untrimmed = lambda c: (c == "") | (T.strip(c) != c)
    done, total = F.col("completed_count"), F.col("total_count")
    rules = {
        "stage": untrimmed(F.col("stage")), "state": ~F.col("state").isin(*WORKFLOW_STATES), "next_action": untrimmed(F.col("next_action")), "blockers": F.exists("blockers", lambda b: F.coalesce(untrimmed(b), F.lit(True))),
        "flags": F.lit(False), "counts": (done < 0) | (total < 1) | (done > total), "artifact_sha256": ~F.col("artifact_sha256").rlike(r"^[0-9a-f]{64}\z"),
    }
    needs = {"flags": ("terminal", "resume_allowed", "repair_allowed"), "counts": ("completed_count", "total_count")}
    for code in rules:
        for c in needs.get(code, (code,)):
            rules[code] |= F.col(c).isNull()
    codes = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(True)), F.lit(code)) for code, cond in rules.items())))
    return status.select(F.col(key).cast("string").alias("id"), F.explode(codes).alias("code"))


def accepted_issues(results: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, code): problems accepted more than once, or accepted but not planned."""
    ok = results.where("status = 'accepted'")
    twice = ok.groupBy(F.col("problem_id").alias("id")).count().where("count > 1").select("id", F.lit("accepted_twice").alias("code"))
    return twice.unionByName(ok.select(F.col("problem_id").alias("id")).distinct().join(plan.select(F.col("problem_id").alias("id")), "id", "left_anti").select("id", F.lit("not_planned").alias("code")))


def repair_chunks(ledger: DataFrame, size: int = 16) -> DataFrame:
    """Pending problems, chunked anew."""
    return chunks(ledger.where("state = 'pending'").select("problem_id"), size, "problem_id")


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """(status, n, latency_total, latency_mean) by status."""
    t = F.col("latency_ms").cast("decimal(20,6)")
    return attempts.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(t).cast("double"), 6).alias("latency_total"), F.round(F.sum(t).cast("double") / F.count(t), 6).alias("latency_mean"))


def usage_totals(attempts: DataFrame) -> DataFrame:
    """(key, total): the usage maps added up key by key."""
    return attempts.select(F.explode("usage")).groupBy("key").agg(F.sum("value").alias("total"))


def over_budget(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(problem_id, n_attempts) with more than ``most`` attempts."""
    return attempts.select(F.explode("input_ids").alias("problem_id")).groupBy("problem_id").agg(F.count("*").alias("n_attempts")).where(F.col("n_attempts") > most)


def first_pass(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """One row: problems of first attempts, and how many of them were accepted in one. Results carry their attempt."""
    first = attempts.where("attempt_number = 1").select(F.explode("input_ids").alias("problem_id")).distinct()
    ok = results.where("attempt_number = 1 AND status = 'accepted'").select("problem_id").distinct().withColumn("ok", F.lit(1))
    return first.join(ok, "problem_id", "left").agg(F.count("*").alias("n_first"), F.count("ok").alias("n_accepted"))


def audit_verdict(sample: DataFrame, least: int = 60, of: int = 64) -> DataFrame:
    """One row over audited rows (consistent boolean): whether enough of a full sample are consistent."""
    n = sample.agg(F.count("*").alias("n"), F.count_if("consistent").alias("n_consistent"))
    return n.withColumn("passed", (F.col("n") == of) & (F.col("n_consistent") >= least))


def id_counts(df: DataFrame, expected: str = "expected", returned: str = "returned") -> DataFrame:
    """``df`` with the multiset comparison of two id arrays of a row."""
    e, r = F.col(expected), F.col(returned)
    return df.withColumns({
        "returned_count": F.size(r), "missing_count": F.size(F.array_except(e, r)), "unexpected_count": F.size(F.array_except(r, e)),
        "duplicate_count": F.size(r) - F.size(F.array_distinct(r)), "order_mismatch": e != r,
    })
