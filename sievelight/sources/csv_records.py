"""Strict CSV of questions and answers.

Files are read whole (``binaryFile``, one row each) and parsed by the csv module's strict reader in the task that holds
them, so quoted line ends, BOMs, NULs and bad UTF-8 are seen as they are; a file must fit a task. Files beyond that, or
many at once where lossy line ends are fine, go through ``read_fast``.

Every reader gives one row per record with its place (``ord`` from 0 and ``row_number``, the header being row 1) and
``problem``, null or the first breach of the contract; ``require`` turns breaches into an error.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.text import is_canonical_integer, normalize_question

# ---- fixed values: legal headers -----------------------------------------------------------------------------
TRAIN_HEADERS = (("id", "question", "answer"),)
LEADERBOARD_HEADERS = (("id", "question"), ("id", "question", "answer"), ("id", "question", " answer"))
EXCLUSION_HEADERS = (("id",), ("id", "answer", "question"))
SUBMISSION_HEADERS = (("ID", "answer"),)
# ---- end of fixed values -------------------------------------------------------------------------------------

_PARSED = "path string, ord long, row_number long, fields array<string>, header array<string>, problem string"


def parse_csv(content: bytes) -> Iterator[tuple[int, list[str] | None, str | None]]:
    """(row number, fields, problem) of a file's rows, the header first."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        yield 1, None, "csv_parse"
        return
    reader = csv.reader(io.StringIO(text, newline=""), strict=True)
    number = 0
    try:
        for number, row in enumerate(reader, 1):
            yield number, row, None
    except csv.Error:
        yield number + 1, None, "csv_parse"
    if number == 0:
        yield 1, None, "empty_file"


def read_rows(spark: SparkSession, path: str, headers: tuple[tuple[str, ...], ...], pad_to: int | None = None) -> DataFrame:
    """All rows of the CSV files at ``path``. ``pad_to``: rows one field short of it get an empty last field."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                out: list[tuple] = []
                header: list[str] | None = None
                for number, row, problem in parse_csv(bytes(content)):
                    if problem:
                        out.append((where, None, number, None, header, problem))
                    elif header is None:
                        header = row
                        if tuple(row) not in headers:
                            out.append((where, None, 1, None, row, "header_schema"))
                    else:
                        if pad_to == len(header) == len(row) + 1:
                            row = [*row, ""]
                        out.append((where, number - 2, number, row, header, None if len(row) == len(header) else "row_width"))
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=["path", "ord", "row_number", "fields", "header", "problem"]).astype({"ord": "Int64"})
                        out = []
                yield pd.DataFrame(out, columns=["path", "ord", "row_number", "fields", "header", "problem"]).astype({"ord": "Int64"})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, _PARSED)
    empty = _empty_files(spark, path)  # scans leave them out
    return rows.unionByName(spark.createDataFrame([(p, None, 1, None, None, "empty_file") for p in empty], _PARSED)) if empty else rows


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(where) or ():
        found += [x for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if x.isFile() and x.getLen() == 0]
    return [x.getPath().toString() for x in found]


def _field(name: str):
    at = F.array_position(F.transform("header", lambda x: F.trim(x)), name)
    return F.when(at > 0, F.try_element_at("fields", at.cast("int")))


def _records(rows: DataFrame, answered: bool) -> DataFrame:
    out = rows.select("path", "ord", "row_number", "problem", _field("id").alias("id"), _field("question").alias("question_raw"), _field("answer").alias("answer_raw"))
    i, q, a = F.col("id"), F.col("question_raw"), F.col("answer_raw")
    blank = lambda c: F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "") == ""
    odd = F.when(F.col("problem").isNotNull(), F.col("problem")).when(i.isNull() | (i == ""), "missing_id").when(i != F.regexp_replace(i, r"(?U)^\s+|\s+\z", ""), "untrimmed_id").when(i.contains("\u0000") | q.contains("\u0000"), "nul").when(q.isNull() | blank(q), "blank_question")
    odd = odd.when(a.isNull() | (a == ""), "missing_answer").when(~is_canonical_integer(a), "noncanonical_answer") if answered else odd.when(a != "", "unexpected_answer")
    out = out.withColumn("problem", odd)
    return out.withColumns({"question_normalized": normalize_question(q), "answer": F.when(is_canonical_integer(a), F.expr("try_cast(answer_raw as decimal(38,0))"))})


def read_train(spark: SparkSession, path: str) -> DataFrame:
    """Records of a training file: exact header, three fields, canonical answers."""
    return _records(read_rows(spark, path, TRAIN_HEADERS), True)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Records without answers; under a three-column header a row of two fields gets an empty answer."""
    return _records(read_rows(spark, path, LEADERBOARD_HEADERS, pad_to=3), False)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    rows = read_rows(spark, path, EXCLUSION_HEADERS)
    return rows.select("ord", "row_number", _field("id").alias("id"), F.when(F.col("problem").isNotNull(), F.col("problem")).when(_field("id").isNull() | (_field("id") == ""), "missing_id").when(_field("id") != F.trim(_field("id")), "untrimmed_id").alias("problem"))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """(ord, row_number, id, answer, problem) of a submission file."""
    rows = read_rows(spark, path, SUBMISSION_HEADERS)
    return rows.select("ord", "row_number", F.try_element_at("fields", F.lit(1)).alias("id"), F.try_element_at("fields", F.lit(2)).alias("answer"), "problem")


def require(rows: DataFrame, key: str = "id", least: int = 1) -> DataFrame:
    """``rows`` if none has a problem, no key repeats and there are at least ``least``; else an error naming the first few."""
    bad = rows.where("problem IS NOT NULL").orderBy("row_number").select("row_number", "problem").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"row {r[0]}: {r[1]}" for r in bad))
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate id {twice[0][0]!r}")
    if least and rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    return rows


def read_fast(spark: SparkSession, path: str, schema: str = "id string, question string, answer string") -> DataFrame:
    """Spark's own multi-line CSV scan: distributed over files, fails on malformed rows. Quoted CRLF becomes LF."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
