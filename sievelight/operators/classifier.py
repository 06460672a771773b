"""An ordered classifier of runner results: the first check that fails names the (stage, code) of a row.

A result is (returncode, failure_reason, stdout: NDJSON events, expected: ids, answers: map of expected answers or null).
Events and agent messages are decoded by from_json inside the plan; only reading target answers needs the parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.ledger import EVENT_TYPES, id_counts

# ---- fixed values: limits of a target text ---------------------------------------------------------------------
TARGET_CHARS = (16, 1600)
TARGET_LINES = 13
FINAL_TARGET = r"(?s)^.+\nFinal answer: (?:0|-?[1-9][0-9]*)\z"
_FINAL = r"(?s)^.*\nFinal answer: (0|-?[1-9][0-9]*)\z"
# ---- end of fixed values ---------------------------------------------------------------------------------------

_EVENT = "type string, item struct<type string, text string>, usage string"
#: An object of names and counts.
_COUNTED = r'\s*+"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:\s*+(?:-?0|[1-9][0-9]*+)\s*+'
_USAGE = rf"(?s)^\{{{_COUNTED}(?:,{_COUNTED})*+\}}\z"
_ITEM = "problem_id string, target_text string"


def _lines(stdout):
    return F.filter(F.split(stdout, "\n"), lambda x: F.trim(x) != "")


def decoded(df: DataFrame) -> DataFrame:
    """``df`` with events (array of structs), event_ok (every line is an object), and the agent's items."""
    lines = df.withColumn("__l", _lines(F.col("stdout")))
    out = lines.withColumn("events", F.transform("__l", lambda x: F.from_json(x, _EVENT)))
    out = out.withColumn("event_ok", (F.size("__l") > 0) & F.forall("__l", lambda x: F.json_object_keys(x).isNotNull()))
    text = F.transform(F.filter("events", lambda e: (e["type"] == "item.completed") & (e["item"]["type"] == "agent_message")), lambda e: e["item"]["text"])
    out = out.withColumn("messages", text).withColumn("message", F.try_element_at("messages", F.lit(1)))
    raw = F.from_json(F.get_json_object("message", "$.items"), "array<string>")
    out = out.withColumn("raw_items", raw)
    items = F.transform("raw_items", lambda x: F.from_json(x, _ITEM))
    return out.withColumn("items", items).withColumn("returned", F.coalesce(F.transform("items", lambda x: x["problem_id"]), F.array().cast("array<string>")))


def _unsafe(e, line):
    """Why an event isn't safe, or null; of a row the first such event counts."""
    kind, item = e["type"], F.coalesce(e["type"].startswith("item."), F.lit(False))
    failed = F.array_contains(F.json_object_keys(line), "error") | kind.isin("turn.failed", "error")
    return (
        F.when(kind.isNull() | ~kind.isin(*EVENT_TYPES), "unsafe_event_type").when(failed, "error_event").when(item & e["item"].isNull(), "invalid_item_event").when(item & ~F.coalesce(e["item"]["type"].isin("agent_message", "reasoning"), F.lit(False)), "unsafe_item")
    )


def classify(df: DataFrame) -> DataFrame:
    """``df`` with stage and code of each row, and the id counts (0 and the number expected while no ids came back).

    Unsafe events are judged in their order: the first of them names the code, whatever the others are.
    """
    out = id_counts(decoded(df))
    ev = F.col("events")
    types = F.transform(ev, lambda e: e["type"])
    ends = F.filter(ev, lambda e: e["type"] == "turn.completed")
    usage_ok = lambda e: F.coalesce(e["usage"].rlike(_USAGE) & F.forall(F.json_object_keys(e["usage"]), lambda k: k != ""), F.lit(False))
    codes = F.array_compact(F.zip_with(ev, "__l", _unsafe))
    unsafe = lambda code: F.try_element_at(codes, F.lit(1)) == code
    keys = F.json_object_keys("message")
    bad_items = F.exists("raw_items", lambda x: F.coalesce(F.sort_array(F.json_object_keys(x)) != F.array(F.lit("problem_id"), F.lit("target_text")), F.lit(True))) | F.exists("items", lambda x: x["problem_id"].isNull() | x["target_text"].isNull())
    target_bad = F.exists("items", lambda x: ~x["target_text"].rlike(FINAL_TARGET) | ~F.length(x["target_text"]).between(*TARGET_CHARS) | (F.size(F.split(x["target_text"], "\n")) > TARGET_LINES))
    wrong = F.exists("items", lambda x: F.coalesce(F.regexp_extract(x["target_text"], _FINAL, 1) != F.element_at(F.col("answers"), x["problem_id"]), F.lit(True)))
    checks = [
        (F.col("failure_reason") == "runner_exception", "process", "runner_exception"), (F.col("returncode") == 124, "timeout_spawn", "timeout"), (F.col("returncode") == 127, "timeout_spawn", "spawn_failure"), (F.col("returncode") != 0, "nonzero", "command_nonzero"),
        (~F.col("event_ok"), "event_json", "malformed_event_json"), (unsafe("unsafe_event_type"), "unsafe_error_event", "unsafe_event_type"), (unsafe("error_event"), "unsafe_error_event", "error_event"), (unsafe("invalid_item_event"), "unsafe_error_event", "invalid_item_event"), (unsafe("unsafe_item"), "unsafe_error_event", "unsafe_item"),
        (F.size(ends) > 1, "terminal_usage", "multiple_terminal_events"), (F.exists(ends, lambda e: ~usage_ok(e)), "terminal_usage", "invalid_usage"), (F.size(ends) == 0, "terminal_usage", "missing_terminal_event"), (F.try_element_at(types, F.lit(-1)) != "turn.completed", "terminal_usage", "terminal_not_final"),
        ((F.size("messages") == 0) | F.exists("messages", lambda x: x.isNull() | (x == "")), "agent_json", "missing_agent_message"), (F.size("messages") > 1, "agent_json", "multiple_agent_messages"), (keys.isNull(), "agent_json", "malformed_agent_json"),
        ((keys != F.array(F.lit("items"))) | F.col("raw_items").isNull(), "output_schema", "invalid_output_schema"), (bad_items, "output_schema", "invalid_item_schema"), (F.col("returned_count") != F.size("expected"), "output_structure", "cardinality_mismatch"),
        ((F.col("missing_count") > 0) | (F.col("unexpected_count") > 0), "output_structure", "id_set_mismatch"), (F.col("duplicate_count") > 0, "output_structure", "duplicate_ids"), (F.col("order_mismatch"), "output_structure", "order_mismatch"),
        (target_bad, "target_policy", "target_policy_invalid"), (F.col("answers").isNotNull() & wrong, "target_policy", "wrong_target"),
    ]
    found = F.lit("success/qualified")
    for cond, stage, code in reversed(checks):
        found = F.when(F.coalesce(cond, F.lit(False)), F.lit(f"{stage}/{code}")).otherwise(found)
    out = out.withColumn("__f", found)
    return out.withColumns({"stage": F.split_part("__f", F.lit("/"), F.lit(1)), "code": F.split_part("__f", F.lit("/"), F.lit(2))}).drop("__l", "__f", "events", "event_ok", "messages", "message", "raw_items", "items")
