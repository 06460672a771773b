"""The corpus pipeline: five stages, each over all rows that the stage before it kept.

Counted as part of ``sievelight.llm``: without that subpackage this module can't be used.

Edge cases of all stages: null texts count as empty (the first stage drops them); texts of any length are handled
whole; an empty table gives an empty one; extra columns, whatever their names, are kept as they are up to the last
stage, whose columns are fixed. Repeated rows are one near duplicate group, of which one row stays; ties there go to
the least doc_id, then to the least set hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bpe, decontaminate, language_id, ngram_join, secret_scan
from sievelight.llm import textscan as ts
from sievelight.session import discard, shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told (null or letterless text); the rest keep their columns as they are.

    The classifiers learn from the stage's own rows.
    """
    boxed = ts.boxed(docs, "doc_id", "lang", "text")
    return language_id.predict(boxed, language_id.train(boxed), ["__row"]).where("lang_pred <> 'und'").select("__row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the least doc_id. Links are of 0.8 on five words, not op5's."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts, and counts the characters anew where it did."""
    masked = secret_scan.redact(ts.boxed(docs, "text"))
    changed = ~F.col("text").eqNullSafe(F.col("__row.text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return masked.select(*(new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of ids, and the digests of ids and decoded text."""
    return bpe.digests(docs, [c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("bpe", token_stage),
]

#: Language ID, Jaccard components, recursive secret masking and BPE aren't expressible in SQL; the tests hold the rows
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each result written as Parquet and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    return docs
