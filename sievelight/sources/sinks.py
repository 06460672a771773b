"""Sinks: validated submissions, canonical JSON lines, hashed reports, and data with a manifest written last.

Data goes out through Spark's committers. A folder counts as published once its ``_MANIFEST.json`` is there, which is
written after everything else through the same file system; readers check its digests against the data.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelight.functions import text as T
from sievelight.operators import validation
from sievelight.operators.ledger import in_order
from sievelight.session import discard, release
from sievelight.sources import jsonl

MANIFEST = "_MANIFEST.json"
# ---- fixed value -----------------------------------------------------------------------------------------------
SOURCE_ROW = "gate-b-concise-rationale-row-v1"
# ---- end of fixed value ------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_once(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small text file on any file system, under its final name only when whole; an existing one is an error."""
    fs, p, jvm = _fs(spark, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if overwrite and fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, on any file system (Spark's readers skip names that begin with an underscore)."""
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def canonical(payload) -> str:
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def write_json(spark: SparkSession, path: str, payload: dict, overwrite: bool = False) -> None:
    write_once(spark, path, json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n", overwrite)


def hashed(payload: dict) -> dict:
    """``payload`` with payload_sha256, the digest of its canonical JSON without that key."""
    import hashlib

    rest = {k: v for k, v in payload.items() if k != "payload_sha256"}
    return rest | {"payload_sha256": hashlib.sha256(canonical(rest).encode()).hexdigest()}


def is_intact(payload: dict) -> bool:
    return payload.get("payload_sha256") == hashed(payload)["payload_sha256"]


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON object with sorted keys per line, nulls kept, as a folder of parts."""
    row = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.option("lineSep", "\n").mode("errorifexists").text(path)


def digest_of(df: DataFrame) -> dict:
    """Row count and an order-free digest of a table: the sum of its rows' 64-bit hashes, and of a second hash."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    n, a, b = df.select(row.alias("r")).agg(F.count("*"), F.sum(F.xxhash64("r").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), F.col("r")).cast("decimal(38,0)"))).first()
    return {"rows": n, "hash_a": str(a or 0), "hash_b": str(b or 0)}


def publish(df: DataFrame, path: str, note: dict | None = None, partition_by: tuple[str, ...] = ()) -> dict:
    """Writes Parquet, reads it back, and writes the manifest last. The same path twice is an error."""
    spark = df.sparkSession
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    manifest = hashed((note or {}) | {"columns": sorted(df.columns)} | digest_of(spark.read.parquet(path).select(*df.columns)))
    write_json(spark, f"{path}/{MANIFEST}", manifest)
    return manifest


def load_published(spark: SparkSession, path: str) -> DataFrame:
    """The table of a published folder, after its manifest was found intact and in agreement with the rows."""
    manifest = json.loads(read_text(spark, f"{path}/{MANIFEST}"))
    df = spark.read.parquet(path)
    if not is_intact(manifest) or digest_of(df) != {k: manifest[k] for k in ("rows", "hash_a", "hash_b")}:
        raise ValueError(f"{path}: the manifest doesn't match the rows")
    return df


def cv_shard(split: DataFrame, records: DataFrame, path: str) -> dict:
    """Publishes the records outside the holdout, with their group and fold, partitioned by fold."""
    rows = split.where("partition = 'cross_validation'").join(records.withColumnRenamed("id", "record_id"), "record_id")
    return publish(rows.drop("partition"), path, {"kind": "development_cv_shard"}, ("fold",))


def write_submission(predictions: DataFrame, expected: DataFrame, path: str, fallback: str | None = None) -> dict:
    """A submission as CSV parts in the expected order, validated by both checks before and after it is written.

    Rows are range-partitioned by their place, so parts in name order hold the expected order, and no task holds all.
    """
    spark = predictions.sparkSession
    resolved = validation.resolve(predictions, expected, fallback)
    rows = expected.select("ord", "id").join(resolved.select("id", "answer"), "id")
    validation.require_valid(validation.submission_issues(rows, expected), "submission")
    out = rows.repartitionByRange("ord").sortWithinPartitions("ord").select(F.col("id").alias("ID"), "answer")
    out.write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)
    back = spark.read.schema("ID string, answer string").option("header", True).csv(path)
    places = back.withColumnRenamed("ID", "id").join(expected, "id", "left").select("ord", "id", "answer")
    validation.require_valid(validation.submission_issues(places, expected), "written submission")
    manifest = hashed({"header": ["ID", "answer"]} | digest_of(back))
    write_json(spark, f"{path}/{MANIFEST}", manifest)
    return manifest


def publish_whole(spark: SparkSession, path: str, write, manifest_of) -> dict:
    """Publishes a folder with its manifest in one step: both are made under a name of their own, which then is renamed.

    ``write(folder)`` writes the parts, ``manifest_of(folder)`` reads them back. Whatever fails, ``path`` doesn't come to be
    and nothing is left behind; a path that exists is an error.
    """
    fs, p, jvm = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        write(staging)
        manifest = hashed(manifest_of(staging))
        write_json(spark, f"{staging}/{MANIFEST}", manifest)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), p):
            raise FileExistsError(path)
    except BaseException:
        discard(spark, staging)
        raise
    return manifest


def source_bank(plan: DataFrame, accepted: DataFrame) -> DataFrame:
    """The rows of a source bank in plan order: ``plan`` (ord, problem_id, question_sha256) with what was accepted for each.

    ``accepted``: problem_id, target_text, provider, model_id, model_revision, prompt_sha256, execution_sha256, seed,
    agent_message_sha256. A row's sample_index is its position in the plan, numbered within range partitions. A planned
    problem without exactly one accepted answer raises when the rows are read.
    """
    return _bank_rows(_planned(plan, accepted))


def _planned(plan: DataFrame, accepted: DataFrame) -> DataFrame:
    """What the plan has and what was accepted for it, settled in plan order: (ord, problem_id, question_sha256 packed, n, a, rn)."""
    one = accepted.groupBy("problem_id").agg(F.count("*").alias("n"), F.first(F.struct(*(c for c in accepted.columns if c != "problem_id"))).alias("a"))
    rows = plan.select("ord", "problem_id", T.packed_hex(F.col("question_sha256")).alias("question_sha256"))
    return in_order(rows.join(one, "problem_id", "left"), "ord")


def _bank_rows(rows: DataFrame) -> DataFrame:
    position = F.when(F.coalesce(F.col("n"), F.lit(0)) != 1, F.raise_error(F.concat(F.lit("not exactly one accepted answer: "), "problem_id"))).otherwise(F.col("rn") - 1)
    no, a = F.lit(False), (lambda c: F.col(f"a.{c}"))
    teacher = F.struct(
        a("provider").alias("provider"), a("model_id").alias("model_id"), a("model_revision").alias("model_revision"), a("prompt_sha256").alias("prompt_sha256"), a("execution_sha256").alias("generation_config_sha256"), a("seed").cast("long").alias("seed"),
        position.alias("sample_index"), a("agent_message_sha256").alias("raw_generation_sha256"), no.alias("reference_answer_in_prompt"), F.lit("training_only").alias("network_scope"),
    )
    verification = F.struct(F.lit("accepted").alias("status"), F.lit("reference_answer_exact_match").alias("method"), no.alias("leaderboard_or_test_used"), no.alias("locked_holdout_accessed"), no.alias("tool_used"))
    return rows.select("ord", F.lit(SOURCE_ROW).alias("schema_version"), "problem_id", T.unpacked_hex(F.col("question_sha256")).alias("question_sha256"), a("target_text").alias("target_text"), F.sha2(a("target_text"), 256).alias("target_sha256"), teacher.alias("teacher"), verification.alias("verification"))


def _sorted_json(df: DataFrame) -> Column:
    """A row as compact JSON, keys sorted at every depth, nulls kept."""

    def tidy(c: Column, kind) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*(tidy(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)))
        return c

    fields = sorted(df.schema, key=lambda f: f.name)
    return F.to_json(F.struct(*(tidy(F.col(f.name), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})


def write_source_bank(plan: DataFrame, accepted: DataFrame, path: str, note: dict | None = None, compression: str = "none") -> dict:
    """Publishes the bank as JSON lines in parts whose name order is the plan's, together with its manifest or not at all.

    ``compression`` is that of the parts, as Spark's text writer names it. The rows are settled in their order, so that they
    are written where they are, after the exchanges that brought them there are gone.
    """
    spark = plan.sparkSession
    rows = source_bank(plan, accepted)
    release(spark)
    lines = rows.select(_sorted_json(rows.drop("ord")).alias("value"))

    def manifest(folder: str) -> dict:
        return (note or {}) | {"kind": "source_bank", "schema_version": SOURCE_ROW} | digest_of(spark.read.option("lineSep", "\n").text(folder))

    return publish_whole(spark, path, lambda folder: lines.write.option("lineSep", "\n").option("compression", compression).mode("errorifexists").text(folder), manifest)


def load_source_bank(spark: SparkSession, path: str, expected: DataFrame, id_form: str = jsonl.TRAIN_ID) -> DataFrame:
    """The bank's rows in the order of ``expected`` (ord, problem_id), after its manifest and every line were found sound."""
    manifest = json.loads(read_text(spark, f"{path}/{MANIFEST}"))
    if not is_intact(manifest) or digest_of(spark.read.option("lineSep", "\n").text(path)) != {k: manifest[k] for k in ("rows", "hash_a", "hash_b")}:
        raise ValueError(f"{path}: the manifest doesn't match the rows")
    _, issues = jsonl.load_rationales(spark, path, expected, id_form)
    validation.require_valid(issues, "source bank")
    return jsonl.sound_rationales(spark, path, expected)
