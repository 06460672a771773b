"""Split manifests: identity digests, strict reading, what differs from a split made anew, and eligibility reports.

All digests of a report come from the same pass over the pieces of ``sequences``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.operators import sequences
from sievelight.operators.joins import binding_issues
from sievelight.operators.ranking import meet
from sievelight.operators.splits import HOLDOUT, TRAINED
from sievelight.sources.jsonl import strict_json

# ---- fixed values: the keys of a split manifest ----------------------------------------------------------------
ASSIGNMENT = "record_id string, group_id string, partition string, fold int"
COUNTS = "partition_records map<string,long>, partition_groups map<string,long>, fold_records map<string,long>, fold_groups map<string,long>"
MANIFEST_KEYS = ("actual_counts", "algorithm", "assignments", "holdout_fraction", "n_folds", "seed", "sha256", "source_groups_sha256", "version")
# ---- end of fixed values ---------------------------------------------------------------------------------------


_encode = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def _compact(x: object) -> str:
    return _encode(x)


def ids_digests(rows: DataFrame, parts: dict[str, Column], id_col: str = "record_id") -> DataFrame:
    """(part, n, ids_sha256): for each condition of ``parts``, the digest of the compact JSON list of its ids in binary order. Empty parts have the digest of []; an empty table gives no row."""
    names = list(parts)
    chosen = rows.select(F.col(id_col).cast("string").alias("id"), *(F.coalesce(c, F.lit(False)).alias(f"p{i}") for i, c in enumerate(parts.values())))

    def texts(b):
        said = pa.array([_encode(x) for x in b.column(0).to_pylist()], pa.string())
        return [said.filter(c).to_pylist() for c in b.columns[1:]]

    def finish(states, counts, _):
        for s in states:
            s.update(b"]")
        return pa.RecordBatch.from_pydict({"part": names, "n": counts, "ids_sha256": [s.hexdigest() for s in states]}, pa.schema([("part", pa.string()), ("n", pa.int64()), ("ids_sha256", pa.string())]))

    return sequences.hashed(sequences.pieces(chosen.orderBy("id"), texts), [b"["] * len(names), finish, "part string, n long, ids_sha256 string")


def split_identity(split: DataFrame, version: str, seed: int, n_folds: int, holdout_fraction: float, algorithm: str) -> DataFrame:
    """(n_records, source_groups_sha256, split_sha256) of a split: the digest of its (record, group) pairs, and of the manifest's canonical JSON without what can be derived.

    Keys are sorted and doubles are written in their shortest form that reads back the same. An empty split gives no row.
    """
    last = {"holdout_fraction": float(holdout_fraction), "n_folds": n_folds, "seed": seed}

    def texts(b):
        rows = b.to_pylist()
        return [[_encode(r) for r in rows], [_encode([r["record_id"], r["group_id"]]) for r in rows]]

    def finish(states, counts, n):
        whole, pairs = states
        pairs.update(b"]")
        groups = pairs.hexdigest()
        whole.update(("]," + _compact({**last, "source_groups_sha256": groups, "version": version})[1:]).encode())
        return pa.RecordBatch.from_pydict({"n_records": [n], "source_groups_sha256": [groups], "split_sha256": [whole.hexdigest()]}, pa.schema([("n_records", pa.int64()), ("source_groups_sha256", pa.string()), ("split_sha256", pa.string())]))

    rows = split.select(F.col("record_id").cast("string"), F.col("group_id").cast("string"), "partition", F.col("fold").cast("int"))
    starts = [f'{{"algorithm":{_compact(algorithm)},"assignments":['.encode(), b"["]
    return sequences.hashed(sequences.pieces(rows.orderBy("record_id"), texts), starts, finish, "n_records long, source_groups_sha256 string, split_sha256 string")


def split_diff(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """(record_id, field): where a stored split differs from one made anew, null-safe; ``row`` where a record is in one of them alone."""
    return binding_issues(stored, derived, "record_id", ["group_id", "partition", "fold"])


def _counts(split: DataFrame, n_folds: int) -> DataFrame:
    """One row of the maps of ``COUNTS``, as its keys and values are written."""
    parts = split.groupBy("partition").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("g"))
    folds = split.where(F.col("partition") == TRAINED).groupBy(F.col("fold").cast("string").alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("g"))
    rows = parts.select(F.col("partition").alias("key"), F.lit("partition").alias("kind"), "n", "g").unionByName(folds.select(F.col("fold").alias("key"), F.lit("fold").alias("kind"), "n", "g"))
    return rows.where(F.col("key").isNotNull() & (F.col("key").isin(HOLDOUT, TRAINED) | F.col("key").isin(*map(str, range(n_folds)))))


def read_split(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignments, issues (code)) of a JSON split manifest, or of the one under ``key`` of a wrapper.

    Codes: those of ``strict_json``, key_set, header (a value missing or of the wrong type), assignment (a row without a
    record, group or known partition), order (records not in binary order, or repeated), source_groups_sha256, sha256 and
    actual_counts where the stored value isn't that of the assignments. Rows are given only of a manifest whose JSON and keys are right.
    """
    entry = f"version string, seed long, n_folds int, holdout_fraction double, algorithm string, source_groups_sha256 string, sha256 string, actual_counts struct<{_fields(COUNTS)}>, assignments array<struct<{_fields(ASSIGNMENT)}>>"
    own = F.get_json_object("value", f"$['{key}']") if key else F.col("value")
    doc = spark.read.text(path, wholetext=True).select(strict_json(F.col("value").cast("binary")).alias("problem"), own.alias("own"))
    doc = doc.select("problem", F.sort_array(F.json_object_keys("own")).alias("keys"), F.from_json("own", entry).alias("m"))
    head = doc.select("problem", "keys", F.struct(*(f"m.{c}" for c in MANIFEST_KEYS if c != "assignments")).alias("m")).first()
    codes = []
    if head is None or head["problem"]:
        codes.append("missing" if head is None else head["problem"])
    elif head["keys"] != list(MANIFEST_KEYS):
        codes.append("key_set")
    if codes:
        return spark.createDataFrame([], ASSIGNMENT), spark.createDataFrame([(c,) for c in codes], "code string")
    rows = doc.select(F.posexplode("m.assignments").alias("pos", "a")).select("pos", "a.*")
    split = rows.drop("pos")
    m = head["m"]
    if any(m[c] is None for c in MANIFEST_KEYS if c != "assignments"):
        codes.append("header")
    else:
        found = split_identity(split, m["version"], m["seed"], m["n_folds"], m["holdout_fraction"], m["algorithm"]).first()
        codes += [c for c, value in (("source_groups_sha256", found["source_groups_sha256"]), ("sha256", found["split_sha256"])) if value != m[c]]
        seen: dict[str, dict] = {"partition_records": dict.fromkeys((TRAINED, HOLDOUT), 0), "partition_groups": dict.fromkeys((TRAINED, HOLDOUT), 0), "fold_records": {str(f): 0 for f in range(m["n_folds"])}, "fold_groups": {str(f): 0 for f in range(m["n_folds"])}}
        for r in _counts(split, m["n_folds"]).collect():  # one row for each partition and fold
            seen[f"{r['kind']}_records"][r["key"]], seen[f"{r['kind']}_groups"][r["key"]] = r["n"], r["g"]
        codes += ["actual_counts"] if m["actual_counts"].asDict() != seen else []
    wrong = ~F.coalesce((T.strip(F.col("record_id")) != "") & (T.strip(F.col("group_id")) != "") & F.col("partition").isin(HOLDOUT, TRAINED), F.lit(False))
    bad = rows.agg(F.count_if(wrong)).first()[0]
    nxt = rows.select((F.col("pos") - 1).alias("pos"), F.col("record_id").alias("after"))
    late = rows.join(nxt, "pos").where(~F.coalesce(F.col("record_id") < F.col("after"), F.lit(False))).limit(1).count()
    codes += (["assignment"] if bad else []) + (["order"] if late else [])
    return split, spark.createDataFrame([(c,) for c in codes], "code string")


def _fields(ddl: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in ddl.replace("string,long", "string;long").split(",")).replace("string;long", "string,long")


def eligibility_report(split: DataFrame, excluded: DataFrame, n_folds: int) -> DataFrame:
    """(part, fold, n, ids_sha256): the records that are excluded themselves (direct) and with their groups (expanded), and each fold's eligible training and validation records.

    ``eligible`` counts all that remain; the holdout is among them, so it has no digest. A record of ``excluded`` that isn't in the split counts nowhere.
    """
    direct = excluded.select("record_id").where(F.col("record_id").isNotNull()).distinct().withColumn("direct", F.lit(True))
    marked = split.select("record_id", "group_id", "partition", "fold").join(direct, "record_id", "left")
    groups = marked.where("direct").select("group_id").distinct().withColumn("expanded", F.lit(True))
    marked = meet(marked, groups, "group_id", "left")
    out, trained = F.coalesce("expanded", F.lit(False)), F.col("partition") == TRAINED
    parts: dict[str, Column] = {"direct": F.col("direct"), "expanded": out, "eligible": ~out}
    for f in range(n_folds):
        parts[f"training {f}"] = trained & ~out & (F.col("fold") != f)
        parts[f"validation {f}"] = trained & ~out & (F.col("fold") == f)
    found = ids_digests(marked, parts)
    at = F.split("part", " ")
    return found.select(at[0].alias("part"), F.try_element_at(at, F.lit(2)).cast("int").alias("fold"), "n", F.when(at[0] != "eligible", F.col("ids_sha256")).alias("ids_sha256"))


def token_report(records: DataFrame, tokenize: Callable[[str], list], system: str, template: str = "{system}\n{question}") -> DataFrame:
    """(id, kind, tokens): lengths of whole questions, raw and as the chat input that ``template`` makes of them, by any tokenizer."""
    from sievelight.operators.training import with_tokens

    before, after = template.replace("{system}", system).split("{question}")
    kinds = F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("question_raw").alias("x")), F.struct(F.lit("chat").alias("kind"), F.concat(F.lit(before), F.col("question_raw"), F.lit(after)).alias("x"))))
    return with_tokens(records.select("id", kinds.alias("k")).select("id", "k.kind", "k.x"), "x", tokenize).drop("x")
