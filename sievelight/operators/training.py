"""Training examples: chat messages, prompt digests, response-only encodings, and pluggable tokenizers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# ---- fixed value -----------------------------------------------------------------------------------------------
SYSTEM = "Solve the problem and finish with one line: Final answer: <integer>"
# ---- end of fixed value ----------------------------------------------------------------------------------------


def prompt_messages(question: Column, system: str = SYSTEM) -> Column:
    """array<struct<content, role>>, fields in the order of canonical JSON."""
    message = lambda role, c: F.struct(c.alias("content"), F.lit(role).alias("role"))
    return F.array(message("system", F.lit(system)), message("user", question))


def prompt_sha256(messages: Column) -> Column:
    return F.sha2(F.to_json(messages), 256)


def prompt_json(question: Column, system: str = SYSTEM) -> Column:
    """Canonical JSON of a generation prompt: the messages and that an answer is to follow."""
    return F.to_json(F.struct(F.lit(True).alias("add_generation_prompt"), prompt_messages(question, system).alias("messages")))


def sft_examples(records: DataFrame, split: DataFrame, excluded: DataFrame, fold: int, validation: bool = False) -> DataFrame:
    """(record_id, group_id, fold, messages, target, prompt_sha256) of a fold's eligible records."""
    from sievelight.operators.splits import eligible

    rows = eligible(split, excluded, fold, validation).join(records.withColumnRenamed("id", "record_id"), "record_id")
    out = rows.withColumn("messages", prompt_messages(F.col("question_raw")))
    return out.select("record_id", "group_id", "fold", "messages", F.concat(F.lit("Final answer: "), F.col("answer")).alias("target"), prompt_sha256(F.col("messages")).alias("prompt_sha256"))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, messages): the turns of each conversation in order."""
    m = F.struct("turn", F.struct(F.col("text").alias("content"), "role").alias("m"))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.transform(F.sort_array(F.collect_list(m)), lambda x: x["m"]).alias("messages"))  # the turns of one conversation


def with_tokens(df: DataFrame, text: str, tokenize: Callable[[str], list[int]], name: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens by any tokenizer, in Arrow batches."""

    @F.pandas_udf(IntegerType())
    def count(x: pd.Series) -> pd.Series:
        return x.map(lambda t: len(tokenize(t)) if t is not None else None).astype("Int32")

    return df.withColumn(name, count(text))


def encode_response_only(df: DataFrame, tokenize: Callable[[str], list[int]], max_length: int, ignored: int = -100) -> DataFrame:
    """``df`` (prompt, target) with prompt_ids, input_ids, labels (``ignored`` over the prompt) and max_length; nothing is cut."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(x: pd.Series) -> pd.Series:
        return x.map(lambda t: list(tokenize(t)), na_action="ignore")

    out = df.withColumn("prompt_ids", ids("prompt")).withColumn("target_ids", ids("target"))
    labels = F.concat(F.transform("prompt_ids", lambda _: F.lit(ignored)), "target_ids")
    return out.withColumns({"input_ids": F.concat("prompt_ids", "target_ids"), "labels": labels, "max_length": F.lit(max_length)}).drop("target_ids")
