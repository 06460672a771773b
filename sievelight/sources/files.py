"""Manifests of files: sizes and digests, and one digest for a tree."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The largest file that is read as one row, and the bytes of a larger one that are held at a time.
ONE_ROW = 64 << 20
PIECE = 8 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark names it (nothing escaped), and the path within it."""
    scheme, rest = path.split(":", 1) if re.match(r"\w[\w+.-]*:/", path) else ("file", path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def _streamed(batches):
    for b in batches:
        found = []
        for path in b.column(0).to_pylist():
            store, name = _store(path)
            state = hashlib.sha256()
            with store.open_input_stream(name) as f:
                while piece := f.read(PIECE):
                    state.update(piece)
            found.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], ["path", "length", "sha256"])


def file_manifest(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), exclude: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path, size_bytes, sha256) of the files under a folder, without those with an excluded path part.

    Each file is digested in the task that reads it: as one binary row up to ``ONE_ROW`` bytes, and beyond in pieces of
    ``PIECE`` bytes through the store's own input stream. Sizes are filtered before contents are read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    small = listed.where(F.col("length") <= ONE_ROW).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = listed.where(F.col("length") > ONE_ROW).select("path", "length").mapInArrow(_streamed, "path string, length long, sha256 string")
    files = small.unionByName(large)
    at = F.regexp_replace("path", r"^\w+:/*", "/")
    root = "/" + path.split("://")[-1].strip("/")
    named = files.select(F.regexp_replace(at, "^" + _quoted(root) + "/?", "").alias("path"), F.col("length").alias("size_bytes"), "sha256")
    if suffixes:
        named = named.where(F.lower("path").rlike("(?:" + "|".join(map(_quoted, suffixes)) + r")\z"))
    for part in exclude:
        named = named.where(~F.array_contains(F.split("path", "/"), part))
    return named


def _quoted(x: str) -> str:
    return "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def tree_sha256(manifest: DataFrame) -> DataFrame:
    """(n_files, size_bytes, tree_sha256): the digest of the compact JSON list of the files in path order. One row per file, of names and digests only."""
    entry = F.struct("path", "sha256", "size_bytes")
    return manifest.agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.sha2(F.to_json(F.sort_array(F.collect_list(entry))), 256).alias("tree_sha256"))


def arithmetic_fixture(spark: SparkSession, n: int = 64, first: int = 900_001) -> DataFrame:
    """(problem_id, question, expected_answer): synthetic sums of signed integers, for trying a harness out."""
    return fixture_of(spark.range(n).select("id", (F.col("id") + first).alias("number")))


def fixture_of(numbers: DataFrame) -> DataFrame:
    """The fixture's problem for each row (id, number)."""
    i = F.col("id")
    a, b = (i * 37 % 199 - 99), (i * 53 % 211 - 105)
    text = F.concat(F.lit("Compute the signed integer sum ("), a.cast("string"), F.lit(") + ("), b.cast("string"), F.lit(")."))
    return numbers.select(F.format_string("train-%06d", "number").alias("problem_id"), text.alias("question"), (a + b).cast("string").alias("expected_answer"))
