"""JSON lines with an exact key set, JSON maps of predictions, and strict JSON manifests."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sievelight.functions import text as T
from sievelight.session import settled

# ---- fixed values ----------------------------------------------------------------------------------------------
MAX_LINE_BYTES = 16 << 20
TRAIN_ID = r"^train-[0-9]{6}\z"
#: The fields of a run record; parse is kept as the text of its object.
RUN_RECORD = """schema_version string, problem_id string, question_sha256 string, route string, sample_index long, seed long, model_id string, revision string,
 prompt_sha256 string, checkpoint_sha256 string, config_sha256 string, decoding_policy string, decoding_policy_sha256 string, raw_completion string, raw_completion_sha256 string,
 finish_reason string, input_token_count long, output_token_count long, parse string, reference_answer string, exact_match boolean, latency_ms double, peak_vram_allocated_bytes long,
 split_version string, split_sha256 string, source_groups_sha256 string, fold long, partition string, split_partition string, group_id string, eligibility_ids_sha256 string"""
#: The fields of a rationale row.
RATIONALE = """schema_version string, problem_id string, question_sha256 string, target_text string, target_sha256 string,
 teacher struct<provider: string, model_id: string, model_revision: string, prompt_sha256: string, generation_config_sha256: string, seed: long, sample_index: long, raw_generation_sha256: string, reference_answer_in_prompt: boolean, network_scope: string>,
 verification struct<status: string, method: string, leaderboard_or_test_used: boolean, locked_holdout_accessed: boolean, tool_used: boolean>"""
# ---- end of fixed values ---------------------------------------------------------------------------------------
#: Numbers beyond six digits, as tables of more than a million problems have them.
LONG_TRAIN_ID = r"^train-(?:[0-9]{6}|[1-9][0-9]{6,})\z"
#: Names of files that Spark's readers decompress.
PACKED = r"(?i)\.(?:gz|bz2|deflate|lz4|snappy|zst)$"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(row, raw, problem): each line as the struct ``row`` of ``schema``.

    problem: null, blank_line, line_too_long, not_an_object, key_set (keys other than exactly the schema's), or types
    (a value that the schema can't hold). Lines are split by LF alone, so carriage returns stay in them.
    """
    schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    names = sorted(f.name for f in schema)
    lines = spark.read.option("lineSep", "\n").text(path)
    keys = F.json_object_keys("value")
    parsed = F.from_json("value", schema.add("_bad", "string") if "_bad" not in names else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.select(F.col("value").alias("raw"), parsed.alias("row"), keys.alias("keys"))
    problem = (
        F.when(F.col("raw").rlike(r"^\s*\z"), "blank_line").when(F.octet_length("raw") >= MAX_LINE_BYTES, "line_too_long").when(F.col("keys").isNull(), "not_an_object")
        .when((F.sort_array("keys") != F.array(*map(F.lit, names))), "key_set").when(F.col("row._bad").isNotNull(), "types")
    )
    return out.select(F.struct(*(F.col(f"row.{n}").alias(n) for n in (f.name for f in schema if f.name != "_bad"))).alias("row"), "raw", problem.alias("problem"))


def unterminated(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files whose last line lacks its LF: their lines, with an LF for each, make more bytes than the file has.

    Lines are counted where the splits of the files are read, so files of any size will do. The size of a compressed file
    doesn't tell how many bytes it holds. Its lines are read once more, up to each brace and LF: what isn't closed so gets
    two bytes too many, so only a file without its last LF gets one more than by LF alone.
    """

    def counted(end: str) -> DataFrame:
        lines = spark.read.option("lineSep", end).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        return lines.withColumn("packed", F.col("path").rlike(PACKED)).withColumn("bytes", F.octet_length("value") + len(end))

    found = counted("\n").where("NOT packed").groupBy("path", "size").agg(F.sum("bytes").alias("n")).where("n > size").select("path")
    if not any(re.search(PACKED, f) for f in spark.read.text(path).inputFiles()):
        return found
    both = counted("\n").where("packed").select("path", F.col("bytes").alias("n")).unionByName(counted("}\n").where("packed").select("path", (-F.col("bytes")).alias("n")))
    return found.unionByName(both.groupBy("path").agg(F.sum("n").alias("n")).where("n = -1").select("path"))


@F.arrow_udf(StringType())
def strict_json(raw: pa.Array) -> pa.Array:
    """What is wrong with each line as one JSON object, at any depth: encoding, repeated_key, constant (NaN or an infinity), invalid_json, not_an_object.

    Spark's own parser lets these pass: it keeps the last of repeated keys and ignores what follows an object.
    """
    return pa.array([None if x is None else _line_problem(x) for x in raw.to_pylist()], pa.string())


class _Refused(ValueError):
    pass


def _line_problem(raw: bytes) -> str | None:
    def once(pairs):
        if len(dict(pairs)) != len(pairs):
            raise _Refused("repeated_key")
        return True

    def refuse(_):
        raise _Refused("constant")

    try:
        got = json.loads(raw.decode(), object_pairs_hook=once, parse_constant=refuse)
    except UnicodeDecodeError:
        return "encoding"
    except _Refused as e:
        return str(e)
    except (ValueError, RecursionError):
        return "invalid_json"
    return None if got is True and raw.lstrip()[:1] == b"{" else "not_an_object"


def _nested_keys(schema: StructType, at: str = "$") -> list[tuple[str, list[str]]]:
    """(path, sorted keys) of every object in the schema, the line itself left out."""
    out = []
    for f in schema:
        if isinstance(f.dataType, StructType):
            out.append((f"{at}.{f.name}", sorted(f.dataType.names)))
            out += _nested_keys(f.dataType, f"{at}.{f.name}")
    return out


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``read_jsonl`` with what only a whole parse can see: ``strict_json``'s problems, and the key sets of nested objects."""
    schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    rows = read_jsonl(spark, path, schema)
    odd = F.lit(False)
    for at, names in _nested_keys(schema):
        odd = odd | ~F.coalesce(F.sort_array(F.json_object_keys(F.get_json_object("raw", at))) == F.array(*map(F.lit, names)), F.lit(False))
    early = F.col("problem").isin("blank_line", "line_too_long")
    whole = F.when(~F.coalesce(early, F.lit(False)), strict_json(F.col("raw").cast("binary")))
    return rows.withColumn("problem", F.when(early, F.col("problem")).otherwise(F.coalesce(whole, "problem", F.when(odd, "key_set"))))


def _in_order_of(rows: DataFrame, expected: DataFrame) -> DataFrame:
    return rows.join(expected.select("ord", "problem_id"), "problem_id").repartitionByRange("ord").sortWithinPartitions("ord")


def _loaded(rows: DataFrame, expected: DataFrame, own: Column, id_form: str) -> tuple[DataFrame, DataFrame]:
    """(rows in the order of ``expected`` (ord, problem_id), issues (id, code)) of lines that were read strictly.

    What is told of a line, its id and its problem, is settled: all issues come from one strict reading.
    """
    rows = rows.withColumn("problem", F.coalesce("problem", own))
    told = settled(rows.select(F.when(F.col("problem").isNull(), F.col("row.problem_id")).otherwise(F.get_json_object("raw", "$.problem_id")).alias("id"), F.col("problem").alias("code")))
    issues = told.where("code IS NOT NULL").unionByName(coverage_issues(told.where("code IS NULL").select(F.col("id").alias("problem_id")), expected, id_form=id_form))
    return _in_order_of(rows.where("problem IS NULL").select("row.*"), expected), issues


def load_run(spark: SparkSession, path: str, expected: DataFrame, id_form: str = TRAIN_ID) -> tuple[DataFrame, DataFrame]:
    """A run's records on exactly the ``expected`` (ord, problem_id), one sample each: (rows in that order, issues (id, code)).

    Codes are those of ``read_strict`` and ``coverage_issues``, sample_index (not 0) and final_lf (a file without; its id is
    the path). Range partitions hold the order: neither the rows nor the ids are gathered. A caller that wants none of the
    rows where there is any issue asks for the issues first. Tables of more than a million problems need another ``id_form``.
    """
    index = F.when(~F.coalesce(F.col("row.sample_index") == 0, F.lit(False)), "sample_index")
    rows, issues = _loaded(read_strict(spark, path, RUN_RECORD), expected, index, id_form)
    return rows, issues.unionByName(unterminated(spark, path).select(F.col("path").alias("id"), F.lit("final_lf").alias("code")))


def load_rationales(spark: SparkSession, path: str, expected: DataFrame, id_form: str = TRAIN_ID) -> tuple[DataFrame, DataFrame]:
    """A rationale corpus on exactly the ``expected`` (ord, problem_id): (rows in that order, issues), as ``load_run``, with nested teacher and verification."""
    rows, issues = _loaded(read_strict(spark, path, RATIONALE), expected, F.lit(None).cast("string"), id_form)
    return rows, issues.unionByName(unterminated(spark, path).select(F.col("path").alias("id"), F.lit("final_lf").alias("code")))


def sound_rationales(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """The rows of ``load_rationales`` where its issues were found to be none: the lines aren't read strictly again, and digests move as bytes."""
    digests = ("question_sha256", "target_sha256")
    rows = read_jsonl(spark, path, RATIONALE).select("row.*").withColumns({c: T.packed_hex(F.col(c)) for c in digests})
    return _in_order_of(rows, expected).withColumns({c: T.unpacked_hex(F.col(c)) for c in digests})


def coverage_issues(rows: DataFrame, expected: DataFrame, id_col: str = "problem_id", id_form: str = TRAIN_ID) -> DataFrame:
    """(id, code): ids that repeat, aren't expected, are missing or aren't of the form of a training id."""
    from sievelight.operators.joins import universe_issues

    own = rows.where(~F.col(id_col).rlike(id_form)).select(F.col(id_col).alias("id"), F.lit("id_form").alias("code"))
    return universe_issues(expected.select(F.col(id_col)), rows.select(id_col), id_col).unionByName(own)


def read_prediction_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction) of JSON files that are one object of id: integer."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("id", "prediction"))


def load_manifest(text: str | bytes, keys: set[str] | None = None) -> dict:
    """A JSON object without repeated keys and without NaN or infinities; with ``keys``, exactly these."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def refuse(x):
        raise ValueError(f"{x} is no JSON number")

    got = json.loads(text, object_pairs_hook=once, parse_constant=refuse)
    if not isinstance(got, dict):
        raise ValueError("the manifest isn't an object")
    if keys is not None and set(got) != keys:
        raise ValueError(f"keys differ: {sorted(set(got) ^ keys)}")
    return got
