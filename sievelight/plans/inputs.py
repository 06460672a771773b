"""The relations that the queries work on, derived from the test tables. Each has its SQL twin in ``SQL``.

Roles: documents are the questions, lineitem rows the candidates of an order, orders the gold answers with three runs
of predictions, events the ledger of attempts. All rows of a table take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.session import spread, table

SQL: dict[str, str] = {}

SQL["records"] = "SELECT CAST(doc_id AS VARCHAR) AS id, text AS question_raw, CAST(n_chars % 1000 - 200 AS VARCHAR) AS answer, source, lang, n_chars, n_chars % 5 AS fold FROM documents"


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question_raw"), (F.col("n_chars") % 1000 - 200).cast("string").alias("answer"), "source", "lang", "n_chars", (F.col("n_chars") % 5).alias("fold"))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
SQL["candidates"] = f"""SELECT CAST(l_orderkey AS VARCHAR) AS problem_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS ord,
 'part ' || CAST(l_partkey AS VARCHAR) || chr(10) || 'Final answer: ' || CAST(CAST(l_quantity AS INTEGER) % 5 AS VARCHAR) AS completion, CAST(CAST(l_quantity AS INTEGER) % 5 AS VARCHAR) AS answer,
 l_suppkey AS seed, l_returnflag AS route, l_linestatus = 'F' AS f, l_linenumber, l_extendedprice, l_quantity, l_partkey, l_shipdate FROM lineitem"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spread(table(spark, d, "lineitem"), "l_orderkey")
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    text = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit("\nFinal answer: "), (F.col("l_quantity").cast("int") % 5).cast("string"))
    seen = rows.select(F.col("l_orderkey").cast("string").alias("problem_id"), ord_.alias("ord"), text.alias("completion"), F.col("l_suppkey").alias("seed"), F.col("l_returnflag").alias("route"), (F.col("l_linestatus") == "F").alias("f"))
    return seen.select("problem_id", "ord", "completion", "seed", "route", (F.col("ord") == 0).alias("greedy"), F.when(F.col("f"), F.lit(True)).alias("verifier_passed"), F.col("ord").alias("sample_index"), *(F.lit(None).cast("string").alias(c) for c in ("prompt_sha256", "checkpoint_sha256", "generation_config_sha256")))


RUN_ROWS = """SELECT CAST(l_orderkey AS VARCHAR) AS problem_id, 'part ' || CAST(l_partkey AS VARCHAR) || chr(10) || 'Final answer: ' || CAST(CAST(l_quantity AS INTEGER) % 5 AS VARCHAR) AS completion,
 CAST(l_partkey % 5 AS VARCHAR) AS reference, CAST(l_quantity AS INTEGER) % 5 = l_partkey % 5 AS exact_match, CASE WHEN l_linestatus = 'F' THEN 'eos' ELSE 'length' END AS finish_reason, l_partkey AS input_tokens, CAST(l_quantity AS BIGINT) AS output_tokens,
 CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey * 1000 END AS peak_bytes, CAST(l_extendedprice AS DECIMAL(20,6)) AS latency_ms, l_suppkey AS seed, l_linenumber AS sample_index, l_returnflag AS route FROM lineitem"""
SQL["runs"] = RUN_ROWS


def runs(spark: SparkSession, d: str) -> DataFrame:
    from sievelight.functions.answers import parse_answer

    q = F.col("l_quantity").cast("int") % 5
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("problem_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit("\nFinal answer: "), q.cast("string")).alias("completion"), (F.col("l_partkey") % 5).cast("string").alias("reference"),
        (q == F.col("l_partkey") % 5).alias("exact_match"), F.when(F.col("l_linestatus") == "F", "eos").otherwise("length").alias("finish_reason"), F.col("l_partkey").alias("input_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"),
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") * 1000).alias("peak_bytes"), F.col("l_extendedprice").alias("latency_ms"), F.col("l_suppkey").alias("seed"), F.col("l_linenumber").alias("sample_index"), F.col("l_returnflag").alias("route"),
    )
    return rows.withColumn("status", parse_answer(F.col("completion"))["status"])


def _prediction(run: int) -> Column:
    k, g = F.col("o_orderkey"), F.col("o_custkey")
    return {
        0: F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.concat(F.lit("0"), g.cast("string"))).when(k % 3 == 0, (g + 1).cast("string")).otherwise(g.cast("string")),
        1: F.when(k % 13 == 0, F.lit(None)).when(k % 4 == 0, (g - 1).cast("string")).otherwise(g.cast("string")),
        2: F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, (g + 2).cast("string")).otherwise(g.cast("string")),
    }[run]


LABELS = ("base", "tuned", "small")
SQL["gold"] = "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS gold, CAST(o_custkey AS VARCHAR) AS group_id, o_orderkey % 5 AS fold FROM orders"
_RUNS = (
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '0' || CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey + 1 AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey - 1 AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey + 2 AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END",
)
for _i, _sql in enumerate(_RUNS):
    SQL[f"run{_i}"] = f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_sql} AS prediction, '{LABELS[_i]}' AS label, o_orderkey % 5 AS fold FROM orders"
#: Run 0 with some ids gone and others that no gold row has.
SQL["submitted"] = f"SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS id, {_RUNS[0]} AS prediction FROM orders WHERE o_orderkey % 19 <> 0"


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("gold"), F.col("o_custkey").cast("string").alias("group_id"), (F.col("o_orderkey") % 5).alias("fold"))


def run(spark: SparkSession, d: str, i: int) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), _prediction(i).alias("prediction"), F.lit(LABELS[i]).alias("label"), (F.col("o_orderkey") % 5).alias("fold"))


def submitted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where(k % 19 != 0).select(F.when(k % 17 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("id"), _prediction(0).alias("prediction"))


#: Attempts: every event is one, at its user's problem and the one after it; errors failed, views wait for assessment.
SQL["attempts"] = """SELECT event_id, user_id AS chunk_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_number, [CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR)] AS input_ids,
 CASE WHEN event_type = 'error' THEN 'failed' ELSE 'parsed' END AS status, event_type <> 'view' AS assessed, CAST(value AS DECIMAL(20,6)) AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("chunk_index"), n.alias("attempt_number"), F.array(F.col("user_id").cast("string"), (F.col("user_id") + 1).cast("string")).alias("input_ids"), F.when(F.col("event_type") == "error", "failed").otherwise("parsed").alias("status"),
        (F.col("event_type") != "view").alias("assessed"), F.col("value").alias("latency_ms"), F.create_map(F.lit("input_tokens"), k, F.lit("output_tokens"), k * 2).alias("usage"), "event_type",
    )


def results(spark: SparkSession, d: str) -> DataFrame:
    """Assessed attempts accept the first of their two problems on a purchase, and reject otherwise."""
    rows = attempts(spark, d).where("status = 'parsed' AND assessed")
    return rows.select(F.element_at("input_ids", 1).alias("problem_id"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("rejected").alias("status"), "attempt_number")


SQL["results"] = f"SELECT input_ids[1] AS problem_id, CASE WHEN event_type = 'purchase' THEN 'accepted' ELSE 'rejected' END AS status, attempt_number FROM ({SQL['attempts']}) WHERE status = 'parsed' AND assessed"
SQL["plan"] = "SELECT DISTINCT unnest([CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR), CAST(user_id + 2 AS VARCHAR)]) AS problem_id FROM events"


def plan(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, d, "events").select(F.explode(F.array(u.cast("string"), (u + 1).cast("string"), (u + 2).cast("string"))).alias("problem_id")).distinct()


#: A corpus over the documents: mostly lawful rows, some with each breach.
SQL["corpus"] = f"""SELECT id AS problem_id, sha256(question_raw) AS question_sha256, target_text, CASE WHEN n % 23 = 0 THEN sha256('x') ELSE sha256(target_text) END AS target_sha256, CASE WHEN n % 29 = 0 THEN 'guess' ELSE 'reference_answer_exact_match' END AS method, 'teacher-' || CAST(n % 3 AS VARCHAR) AS teacher, rationale
 FROM (SELECT id, question_raw, n, rationale, rationale || chr(10) || 'Final answer: ' || CASE WHEN n % 19 = 0 THEN '7' ELSE answer END AS target_text FROM (
 SELECT id, question_raw, answer, CAST(id AS BIGINT) AS n, CASE WHEN CAST(id AS BIGINT) % 31 = 0 THEN 'short' WHEN CAST(id AS BIGINT) % 37 = 0 THEN repeat('line' || chr(10), 20) || 'end' ELSE 'We add the parts of record ' || id || ' one by one.' END AS rationale FROM ({SQL["records"]})))"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("long")
    rationale = F.when(n % 31 == 0, "short").when(n % 37 == 0, F.concat(F.repeat(F.lit("line\n"), F.lit(20)), F.lit("end"))).otherwise(F.concat(F.lit("We add the parts of record "), F.col("id"), F.lit(" one by one.")))
    rows = records(spark, d).select("id", "question_raw", n.alias("n"), "answer", rationale.alias("rationale"))
    rows = rows.withColumn("target_text", F.concat("rationale", F.lit("\nFinal answer: "), F.when(F.col("n") % 19 == 0, "7").otherwise(F.col("answer"))))
    return rows.select(F.col("id").alias("problem_id"), F.sha2("question_raw", 256).alias("question_sha256"), "target_text", F.when(F.col("n") % 23 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("target_text", 256)).alias("target_sha256"), F.when(F.col("n") % 29 == 0, "guess").otherwise("reference_answer_exact_match").alias("method"), F.concat(F.lit("teacher-"), (F.col("n") % 3).cast("string")).alias("teacher"), "rationale")
