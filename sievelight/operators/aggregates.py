"""Summaries of questions, answers, strata, runs and token lengths. Every one is exact."""

from __future__ import annotations

import json
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelight.functions import quality
from sievelight.functions import text as T
from sievelight.operators import sequences
from sievelight.operators.ranking import top
from sievelight.session import settled

QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def distribution(c: Column, prefix: str = "", quantiles: dict[str, float] | None = None) -> list[Column]:
    """min, linear-interpolated quantiles and max. Spark merges value counts, so its state follows the distinct values."""
    q = QUANTILES if quantiles is None else quantiles
    return [F.min(c).alias(f"{prefix}min"), *(F.round(F.percentile(c, p), 6).alias(f"{prefix}{k}") for k, p in q.items()), F.max(c).alias(f"{prefix}max")]


def question_summary(records: DataFrame, question: str = "question_raw") -> DataFrame:
    q = F.col(question)
    seen = records.select(F.length(q).alias("chars"), T.word_count(q).alias("words"), T.is_multiline(q).alias("lines"), T.is_non_ascii(q).alias("wide"))
    return seen.agg(F.count("*").alias("n_rows"), *distribution(F.col("chars"), "chars_"), *distribution(F.col("words"), "words_"), F.count_if("lines").alias("multiline_count"), F.count_if("wide").alias("non_ascii_count"))


def flag_histogram(records: DataFrame, question: str = "question_raw") -> DataFrame:
    """(flag, n) of the flags that occur: one pass of conditional counts, no explode."""
    counts = quality.assess(records.select(question), question).agg(*(F.count_if(k).alias(k) for k in quality.FLAGS))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.col(k).alias("n")) for k in quality.FLAGS))).alias("x")).select("x.flag", "x.n").where("n > 0")


def _plain(answer: Column) -> Column:
    """An integer answer as text: without leading zeros where it has up to 38 digits, as it stands beyond."""
    return F.coalesce(answer.try_cast("decimal(38,0)").cast("string"), answer.cast("string"))


def _by_value(a: Column) -> Column:
    """What orders integers of any length, given as text: negatives by falling magnitude, then the rest by rising."""
    negative, digits = a.startswith("-"), F.ltrim(a, F.lit("-"))
    return F.struct(F.when(negative, -F.length(digits)).otherwise(F.length(digits)).alias("size"), F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"), a.alias("a"))


def answer_summary(records: DataFrame, answer: str = "answer", as_text: bool = False) -> DataFrame:
    """One row over the distinct answers and their counts; the most frequent answer is the smallest among equals.

    Answers may have any number of digits. With ``as_text`` the integers come as text, whole; without, as longs, null beyond 64 bits.
    """
    counts = records.where(F.col(answer).isNotNull()).groupBy(_plain(F.col(answer)).alias("a")).agg(F.count("*").alias("n"))
    counts = counts.select("n", _by_value(F.col("a")).alias("v"), _by_value(F.ltrim("a", F.lit("-"))).alias("m"), F.abs(F.col("a").try_cast("double")).alias("size"), F.col("a").startswith("-").alias("negative"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    kind = lambda c: c if as_text else c.try_cast("long")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("v").alias("v")))
    weighted = [kind(F.min("m")["a"]).alias("abs_min"), *(F.round(F.percentile("size", p, F.col("n")), 6).alias(f"abs_{k}") for k, p in QUANTILES.items()), kind(F.max("m")["a"]).alias("abs_max")]
    m = F.col("size")
    out = counts.agg(
        F.count("*").alias("unique_count"), kind(F.min("v")["a"]).alias("minimum"), kind(F.max("v")["a"]).alias("maximum"), total(F.col("negative")).alias("negative_count"), total(m == 0).alias("zero_count"), total(~F.col("negative") & (m > 0)).alias("positive_count"),
        best.alias("best"), *weighted, *(total(m <= b).alias(f"abs_le_{b}_count") for b in (10, 100, 1000)), total(m >= 10**6).alias("abs_ge_1e6_count"), total(m >= 10**12).alias("abs_ge_1e12_count"),
    )
    return out.withColumns({"most_common_answer": kind(F.col("best.v.a")), "most_common_count": (-F.col("best.less")).cast("long")}).drop("best")


def strata(records: DataFrame, by: str = "fold") -> DataFrame:
    """(by, kind, stratum, n): counts of answer signs, magnitudes and flags per fold. Rows with a null ``by`` (the sealed holdout) give nothing."""
    a = F.col("answer").try_cast("double")  # signs and magnitudes of integers of any length
    seen = quality.assess(records.where(F.col(by).isNotNull()).select(by, "question_raw", T.answer_sign(a).alias("sign"), T.answer_bucket(a).alias("bucket")))
    kinds = F.concat(F.array(F.struct(F.lit("sign").alias("kind"), F.col("sign").alias("stratum")), F.struct(F.lit("bucket").alias("kind"), F.col("bucket").alias("stratum"))), F.transform("flags", lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("stratum"))))
    return seen.select(by, F.explode(kinds).alias("k")).groupBy(by, "k.kind", "k.stratum").agg(F.count("*").alias("n"))


def top_answers(records: DataFrame, by: str = "fold", n: int = 10, as_text: bool = False) -> DataFrame:
    """(by, place, answer, n): the most frequent answers of each fold, smaller ones first among equals; answers as in ``answer_summary``.

    Spark keeps the first n of each fold in every task before a fold's rows meet.
    """
    counts = records.where(F.col(by).isNotNull()).groupBy(by, _plain(F.col("answer")).alias("a")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), _by_value(F.col("a"))))
    answer = F.col("a") if as_text else F.col("a").try_cast("long")
    return counts.withColumn("place", place).where(F.col("place") <= n).select(by, "place", answer.alias("answer"), "n")


def run_manifest(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of a run's rows (status, exact_match, finish_reason, input_tokens, output_tokens, peak_bytes, latency_ms), in one pass.

    Latencies are summed as decimals, so the total doesn't depend on the order of the rows.
    """
    n = lambda c, v: F.count_if(F.col(c) == v)
    t = F.col("latency_ms").cast("decimal(20,6)")
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"), n("status", "ok").alias("n_ok"), n("status", "conflict").alias("n_conflict"), n("status", "invalid").alias("n_invalid"), n("finish_reason", "eos").alias("n_eos"), n("finish_reason", "length").alias("n_length"),
        F.count_if("exact_match").alias("n_exact"), F.round(F.count_if("exact_match") / F.count("*"), 9).alias("accuracy"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max("peak_bytes").alias("peak_bytes"),
        F.round(F.sum(t).cast("double"), 6).alias("latency_total"), F.round(F.min(t).cast("double"), 6).alias("latency_min"), F.round(F.max(t).cast("double"), 6).alias("latency_max"), F.round(F.sum(t).cast("double") / F.count(t), 6).alias("latency_mean"),
    )


#: Bits of a double's fraction, and of the halves that are summed.
_FRACTION, _HALF = 53, 27


def exact_sum(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, total): the sum of doubles, rounded once, whatever their order and partitions. NaN and infinities give NaN or an infinity.

    A double is an integer times a power of two. Tasks add up the integers of each power in two halves, Spark adds the
    tasks' sums as decimals, and the at most 2,100 powers of a group are put together exactly at the end.
    """
    keys = by or []
    schema = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL("power int, high long, low long, odd double").fields])

    def run(frames):
        for f in frames:
            x = f[value].to_numpy("float64", na_value=0.0)
            whole = np.isfinite(x)
            fraction, power = np.frexp(np.where(whole, x, 0.0))
            n = np.ldexp(fraction, _FRACTION).astype(np.int64)
            part = f[keys].assign(power=(power - _FRACTION).astype("int32"), high=n >> _HALF, low=n & ((1 << _HALF) - 1), odd=np.where(whole, 0.0, x))
            yield part.groupby([*keys, "power"], as_index=False, dropna=False).agg({"high": "sum", "low": "sum", "odd": "sum"})[[*keys, "power", "high", "low", "odd"]]

    @F.udf("double")
    def joined(parts):
        total = sum((Fraction(int(p["high"])) * (1 << _HALF) + int(p["low"])) * Fraction(2) ** p["power"] for p in parts)
        return float(total)

    seen = rows.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    sums = seen.mapInPandas(run, schema).groupBy(*keys, "power").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")), F.sum("odd").alias("odd"))
    out = sums.groupBy(*keys).agg(F.sum("odd").alias("odd"), joined(F.collect_list(F.struct("power", "high", "low"))).alias("total"))
    return out.select(*keys, F.when(F.col("odd") == 0, F.col("total")).otherwise(F.col("odd")).alias("total"))


def sequence_sha256(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(column, n, sha256): the digest of each column's values as a compact JSON list in order.

    One task hashes the pieces that ``sequences`` makes, never the list. Texts are quoted as JSON without escaping
    non-ASCII; nulls are null. An empty table gives no row.
    """
    encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
    found = sequences.pieces(rows.orderBy(*order).select(*columns), lambda b: [[encode(x) for x in c.to_pylist()] for c in b.columns])

    def finish(states, counts, n):
        for s in states:
            s.update(b"]")
        return pa.RecordBatch.from_pydict({"column": columns, "n": [n] * len(columns), "sha256": [s.hexdigest() for s in states]}, pa.schema([("column", pa.string()), ("n", pa.int64()), ("sha256", pa.string())]))

    return sequences.hashed(found, [b"["] * len(columns), finish, "column string, n long, sha256 string")


def token_profile(tokens: DataFrame, limits: tuple[int, ...] = (1024, 2048, 4096), by: list[str] | None = None) -> DataFrame:
    """One row (or one for each ``by``) over (id, tokens): lengths and how many lie above each limit."""
    c = F.col("tokens")
    return tokens.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), *distribution(c, "", {k: QUANTILES[k] for k in ("p50", "p90", "p95", "p99")}), *(F.count_if(c > x).alias(f"over_{x}") for x in limits))


def longest(tokens: DataFrame, n: int = 20) -> DataFrame:
    return top(tokens.select("id", "tokens"), n, F.desc("tokens"), F.asc("id"))


def preflight(encoded: DataFrame, limit: int | None = None) -> DataFrame:
    """Per fold and role: rows, the longest sequence (largest id among equals) and the shortest response; with ``limit`` also the sequences over it."""
    over = [] if limit is None else [F.count_if(F.col("sequence_tokens") > limit).alias("over_limit")]
    return encoded.groupBy("fold", "role").agg(F.count("*").alias("n_rows"), F.max("sequence_tokens").alias("max_tokens"), F.max_by("id", F.struct("sequence_tokens", "id")).alias("longest_id"), F.min("response_tokens").alias("min_response"), *over)


def preflight_coverage(encoded: DataFrame) -> DataFrame:
    """One row over all folds: the distinct ids of both roles and of validation, those that aren't validated, and the longest sequence of all.

    Among equally long ones the largest id counts, and of its places the first fold, training before validation.
    """
    place = F.struct("sequence_tokens", "id", (-F.col("fold")).alias("back"), (F.col("role") == "training").alias("first"))
    ids = encoded.groupBy("id").agg(F.bool_or(F.col("role") == "validation").alias("validated"), F.max(place).alias("top"))
    out = ids.agg(F.count("*").alias("n_development"), F.count_if("validated").alias("n_validation"), F.count_if(~F.col("validated")).alias("n_unvalidated"), F.max("top").alias("top"))
    role = F.when(F.col("top.first"), "training").when(F.col("top").isNotNull(), "validation")
    return out.select("n_development", "n_validation", "n_unvalidated", F.col("top.sequence_tokens").alias("max_tokens"), F.col("top.id").alias("longest_id"), (-F.col("top.back")).alias("longest_fold"), role.alias("longest_role"))


def corpus_audit(rows: DataFrame) -> DataFrame:
    """One row over a rationale corpus (problem_id, rationale, method, teacher): sizes only, never text."""
    c = F.length("rationale")
    lines = F.length("rationale") - F.length(F.replace(F.col("rationale"), F.lit("\n"), F.lit(""))) + 1
    return rows.agg(F.count("*").alias("n_rows"), F.min(c).alias("chars_min"), F.max(c).alias("chars_max"), F.round(F.avg(c), 6).alias("chars_mean"), F.max(lines).alias("lines_max"), F.count_distinct("method").alias("n_methods"), F.count_distinct("teacher").alias("n_teachers"))


def corpus_counts(rows: DataFrame, order: list[str]) -> DataFrame:
    """(kind, name, n): rows of each verification method and teacher, and the digest of the targets' digests in order (kind targets)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("name")) for k in ("method", "teacher"))))
    counts = rows.select(kinds.alias("k")).groupBy("k.kind", "k.name").agg(F.count("*").alias("n"))
    return counts.unionByName(sequence_sha256(rows, order, ["target_sha256"]).select(F.lit("targets").alias("kind"), F.col("sha256").alias("name"), "n"))


def audit_report(records: DataFrame) -> DataFrame:
    """(section, name, value) of a whole audit: summaries, flags and duplicates of all three fingerprints.

    The fingerprints are settled first, all three in one pass: a test for null would compute such long chains over again.
    """
    from sievelight.operators.joins import duplicate_summary

    def long(df: DataFrame, section: str) -> DataFrame:
        return df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(c).cast("double") for c in df.columns)))).alias("name", "value")).select(F.lit(section).alias("section"), "name", "value")

    views = settled(T.with_views(records).select("id", "canonical_fp", "source_fp", "masked_fp"))
    out = long(question_summary(records), "question").unionByName(long(answer_summary(records), "answer"))
    out = out.unionByName(flag_histogram(records).select(F.lit("flags").alias("section"), F.col("flag").alias("name"), F.col("n").cast("double").alias("value")))
    for fp in ("canonical_fp", "source_fp", "masked_fp"):
        out = out.unionByName(long(duplicate_summary(views, fp), f"duplicates {fp.removesuffix('_fp')}"))
    return out
