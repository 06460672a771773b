"""Row contracts: rules over a table give a table of issues; ``require_valid`` raises if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions.answers import parse_answer
from sievelight.session import settled, spread

# ---- fixed values: contracts of rows and targets -----------------------------------------------------------
SHA256_HEX = r"^[0-9a-f]{64}\z"
FINAL_LINE = r"(?d)(?:^|\n)Final answer: (0|-?[1-9][0-9]*)\z"
FINAL_MARKER = r"(?i)final answer:"
MIN_RATIONALE, MAX_RATIONALE, MAX_LINES = 16, 1500, 12
METHODS = ("reference_answer_exact_match", "independent_recomputation", "manual_review")
# ---- end of fixed values ---------------------------------------------------------------------------------


def issues(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(id, code) for every row and rule whose condition holds, all rules in one pass."""
    codes = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules.items())))
    return df.select(F.col(key).cast("string").alias("id"), F.explode(codes).alias("code"))


def repeated(df: DataFrame, key: str, code: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).count().where("count > 1").select("id", F.lit(code).alias("code"))


def require_valid(found: DataFrame, what: str = "rows") -> None:
    first = found.limit(5).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(f"{r['id']}: {r['code']}" for r in first))


def _blank(c: Column) -> Column:
    return T.strip(c) == ""


def record_issues(records: DataFrame, answered: bool = True) -> DataFrame:
    """(id, code) of records (id, question_raw, answer); without ``answered`` an answer is the issue."""
    i, q, a = F.col("id"), F.col("question_raw"), F.col("answer")
    rules = {
        "missing_id": i.isNull() | (i == ""),
        "untrimmed_id": T.strip(i) != i,
        "nul_in_id": i.contains("\u0000"),
        "blank_question": q.isNull() | _blank(q),
        "nul_in_question": q.contains("\u0000"),
    }
    if answered:
        rules |= {"missing_answer": a.isNull() | (a == ""), "noncanonical_answer": (a != "") & ~T.is_canonical_integer(a)}
    else:
        rules |= {"unexpected_answer": a.isNotNull() & (a != "")}
    return issues(records, "id", rules).unionByName(repeated(records, "id", "duplicate_id"))


def exclusion_issues(excluded: DataFrame, records: DataFrame) -> DataFrame:
    i = F.col("id")
    own = issues(excluded, "id", {"missing_id": i.isNull() | (i == ""), "untrimmed_id": T.strip(i) != i}).unionByName(repeated(excluded, "id", "duplicate_id"))
    unknown = excluded.select("id").distinct().join(records.select("id"), "id", "left_anti").where("id IS NOT NULL").select("id", F.lit("unknown_id").alias("code"))
    return own.unionByName(unknown)


#: Rows of a bucket that are numbered together; one row for each bucket then meets in one place.
PLACES = 65_536


def submission_issues(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, code, row_number) of a submission (ord, id, answer) against expected (ord, id); ord counts from 0.

    Codes: null_id, noncanonical_answer, duplicate_ids, missing_ids, extra_ids, row_count, and id_order, which is only
    looked for where the id sets agree, among the rows that have an id. Places are compared by one join on the id, never
    by collecting a column.
    """
    faults = F.when(F.col("id").isNull() | (F.col("id") == ""), F.array(F.lit("null_id"))).otherwise(F.array().cast("array<string>"))
    return _submitted(rows.select("ord", "id", "answer", faults.alias("faults")).withColumn("usable", F.size("faults") == 0), expected)


def submission_line_issues(lines: DataFrame, expected: DataFrame, header: tuple[str, str] = ("id", "answer")) -> DataFrame:
    """(id, code, row_number) of a submission that comes as JSON (ord, raw), one object to a line, against expected (ord, id).

    Beyond the codes of ``submission_issues``: row_type where a line isn't an object (null, unreadable and with repeated
    keys included; it counts as a row all the same), row_schema where its keys aren't the header in that order, id_type
    where the id is neither a string nor null. Answers may be integers or canonical text; booleans, fractions and null
    are noncanonical. Spark's JSON reader ignores what follows an object on its line.
    """
    v = F.try_parse_json("raw")
    path = [f"$['{c}']" for c in header]
    kind = [F.schema_of_variant(F.try_variant_get(v, p, "variant")) for p in path]
    seen = lines.select("ord", F.when(v.isNotNull(), F.json_object_keys("raw")).alias("keys"), F.when(kind[0] == "STRING", F.get_json_object("raw", path[0])).alias("id"), kind[0].alias("kind"), T.integer_text(F.get_json_object("raw", path[1]), kind[1]).alias("answer"))
    blank = F.coalesce(F.col("kind"), F.lit("VOID")) == "VOID"
    faults = F.when(F.col("keys").isNull(), F.array(F.lit("row_type"))).otherwise(
        F.array_compact(F.array(F.when(F.col("keys") != F.array(*map(F.lit, header)), "row_schema"), F.when(blank | (F.col("id") == ""), "null_id").when(F.col("kind") != "STRING", "id_type")))
    )
    usable = F.col("keys").isNotNull() & (F.coalesce(F.col("id"), F.lit("")) != "")
    return _submitted(seen.select("ord", "id", "answer", faults.alias("faults"), usable.alias("usable")), expected)


def _placed(rows: DataFrame) -> DataFrame:
    """The usable rows with their place among them; a running sum by buckets of ord."""
    rows = rows.withColumn("__b", F.coalesce(F.floor(F.col("ord") / PLACES), F.lit(-1)))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 65,536
    base = rows.groupBy("__b").agg(F.count_if("usable").alias("__c")).select("__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__b").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    numbered = spread(rows, "__b").withColumn("__n", F.coalesce(F.sum(F.col("usable").cast("long")).over(inside), F.lit(0)))
    return numbered.join(base, "__b").where("usable").withColumn("place", F.col("__base") + F.col("__n"))


def _submitted(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Issues of (ord, id, answer, faults of the row, usable: it has an id)."""
    number = (F.col("ord") + 2).cast("long")
    odd_answer = F.when(F.col("usable") & ~T.is_canonical_integer(F.col("answer")), F.array(F.lit("noncanonical_answer"))).otherwise(F.array().cast("array<string>"))
    rows = settled(rows.select("ord", "id", F.concat("faults", odd_answer).alias("faults"), "usable"))  # lines are read once, for five uses
    out = rows.select("id", F.explode("faults").alias("code"), number.alias("row_number"))
    seen = spread(_placed(rows).select("id", "place"), "id").groupBy("id").agg(F.count("*").alias("n"), F.min("place").alias("at"))
    sets = expected.select("id", F.col("ord").alias("want")).join(seen, "id", "full_outer")
    codes = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate_ids"), F.when(F.col("n").isNull(), "missing_ids"), F.when(F.col("want").isNull(), "extra_ids")))
    odd = sets.select("id", F.explode(codes).alias("code"), F.lit(None).cast("long").alias("row_number"))
    nothing = F.lit(None).cast("string").alias("id")
    sizes = rows.agg(F.count("*").alias("n")).unionAll(expected.agg(-F.count("*"))).agg(F.sum("n").alias("n"))
    totals = sizes.where("n <> 0").select(nothing, F.lit("row_count").alias("code"), F.lit(None).cast("long").alias("row_number"))
    whole = (F.col("n") == 1) & F.col("want").isNotNull()
    order = sets.agg(F.min(F.when(whole & (F.col("at") != F.col("want")), F.col("want"))).alias("w"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("torn"))
    first = order.where("w IS NOT NULL AND torn = 0").select(nothing, F.lit("id_order").alias("code"), (F.col("w") + 2).cast("long").alias("row_number"))
    return out.unionByName(odd).unionByName(totals).unionByName(first)


def independent_issues(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(code) of the short second check: another way to the same verdict, by positions alone."""
    p = rows.select("ord", F.col("id").alias("have"), "answer").join(expected.select("ord", F.col("id").alias("want")), "ord", "full_outer")
    bad = p.agg(F.count_if(~F.col("have").eqNullSafe(F.col("want"))).alias("positions"), F.count_if(F.col("have").isNotNull() & ~F.coalesce(F.col("answer").rlike(T.CANONICAL_INTEGER), F.lit(False))).alias("answers"))
    return bad.select(F.explode(F.array_compact(F.array(F.when(F.col("positions") > 0, "id_sequence"), F.when(F.col("answers") > 0, "answer_format")))).alias("code"))


def resolve(predictions: DataFrame, expected: DataFrame, fallback: str | None = None, resolver=None) -> DataFrame:
    """(id, answer, provenance, reason) of every expected id.

    A missing or invalid prediction takes the one fallback given (a canonical integer, or a function of the columns
    id, raw prediction and reason), with its reason; without a fallback reading the rows raises. Predictions for
    unexpected ids raise at once.
    """
    if fallback is not None and resolver is not None:
        raise ValueError("give one fallback, not two")
    stray = predictions.join(expected.select("id"), "id", "left_anti").limit(1).collect()
    if stray:
        raise ValueError(f"unexpected prediction id: {stray[0]['id']!r}")
    joined = expected.select("id").join(predictions.select("id", "prediction", F.lit(True).alias("given")), "id", "left")
    reason = F.when(F.col("given").isNull(), "missing_prediction").when(~T.is_canonical_integer(F.col("prediction")), "invalid_prediction")
    joined = joined.withColumn("reason", reason)
    other = F.lit(fallback) if fallback is not None else resolver(F.col("id"), F.col("prediction"), F.col("reason")) if resolver is not None else F.raise_error(F.concat(F.lit("unresolved: "), F.col("id"), F.lit(":"), F.col("reason")))
    other = F.when(T.is_canonical_integer(other), other).otherwise(F.raise_error(F.lit("the fallback isn't a canonical integer")).cast("string"))
    return joined.select("id", F.when(F.col("reason").isNull(), F.col("prediction")).otherwise(other).alias("answer"), F.when(F.col("reason").isNull(), "prediction").otherwise("emergency_fallback").alias("provenance"), "reason")


def rationale_columns(target: Column) -> tuple[Column, Column]:
    """(rationale, final answer) of a target text; null where the last line isn't ``Final answer: <integer>``."""
    found = target.rlike(FINAL_LINE)
    head = F.regexp_replace(F.regexp_replace(target, FINAL_LINE, ""), r"\n+\z", "")
    return F.when(found, head), F.when(found, F.regexp_extract(target, FINAL_LINE, 1))


def corpus_issues(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(id, code) of corpus rows (problem_id, question_sha256, target_text, target_sha256, method) against their records."""
    known = records.select(F.col("id").alias("problem_id"), F.sha2("question_raw", 256).alias("__q"), F.col("answer").alias("__a"))
    rationale, final = rationale_columns(F.col("target_text"))
    seen = rows.join(known, "problem_id", "left").withColumns({"__r": rationale, "__f": final, "__p": parse_answer(F.col("target_text"))})
    lines = F.length("__r") - F.length(F.replace(F.col("__r"), F.lit("\n"), F.lit(""))) + 1
    rules = {
        "unknown_record": F.col("__a").isNull(),
        "question_sha": ~F.col("question_sha256").eqNullSafe(F.col("__q")) & F.col("__a").isNotNull(),
        "target_sha": ~F.col("target_sha256").eqNullSafe(F.sha2("target_text", 256)),
        "untrimmed_target": T.strip(F.col("target_text")) != F.col("target_text"),
        "control_character": T.has_control(F.col("target_text")),
        "final_line": F.col("__f").isNull(),
        "answer": F.col("__f") != F.col("__a"),
        "markers": F.regexp_count("target_text", F.lit(FINAL_MARKER)) != 1,
        "parser": (F.col("__p.status") != "ok") | ~F.col("__p.value").eqNullSafe(F.col("__a")) | (F.col("__p.source") != "final_answer"),
        "rationale_length": ~F.length("__r").between(MIN_RATIONALE, MAX_RATIONALE),
        "rationale_lines": lines > MAX_LINES,
        "method": ~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)),
    }
    return issues(seen, "problem_id", rules).unionByName(repeated(rows, "problem_id", "duplicate_row"))


def run_issues(rows: DataFrame, constant: list[str]) -> DataFrame:
    """(id, code) of run rows: derived fields that don't follow from the completion, and fields that vary within the run."""
    p = parse_answer(F.col("completion"))
    seen = rows.withColumn("__p", p)
    exact = F.coalesce((F.col("__p.status") == "ok") & (F.col("__p.value") == F.col("reference")), F.lit(False))
    own = issues(seen, "problem_id", {
        "completion_sha": ~F.col("completion_sha256").eqNullSafe(F.sha2("completion", 256)), "status": ~F.col("status").eqNullSafe(F.col("__p.status")), "exact_match": ~F.col("exact_match").eqNullSafe(exact),
        "sample_index": ~F.coalesce(F.col("sample_index") >= 0, F.lit(False)), "seed": ~F.coalesce(F.col("seed") >= 0, F.lit(False)), "latency": ~F.coalesce((F.col("latency_ms") >= 0) & (F.col("latency_ms") < float("inf")), F.lit(False)),
        "tokens": ~F.coalesce((F.col("input_tokens") >= 0) & (F.col("output_tokens") >= 0), F.lit(False)),
    })
    ends = rows.agg(*(F.struct(F.min(c).cast("string").alias("a"), F.max(c).cast("string").alias("z"), F.count_if(F.col(c).isNull()).alias("n"), F.count("*").alias("all")).alias(c) for c in constant))
    varies = F.array_compact(F.array(*(F.when(~F.col(f"{c}.a").eqNullSafe(F.col(f"{c}.z")) | ((F.col(f"{c}.n") > 0) & (F.col(f"{c}.n") < F.col(f"{c}.all"))), F.lit(f"inconsistent_{c}")) for c in constant)))
    return own.unionByName(ends.select(F.lit(None).cast("string").alias("id"), F.explode(varies).alias("code")))


def row_binding_issues(rows: DataFrame, records: DataFrame, split: DataFrame, salt: str, system: str, constant: dict[str, object] | None = None) -> DataFrame:
    """(id, code) of stored validation rows that don't follow from their record (id, question_raw, answer) and its place in the split.

    Recomputed are the question, completion and prompt digests, the parsed answer, the match and the seed; group, fold and
    partition come from the split, and ``constant`` names the fields with one lawful value. unknown: no such record;
    outside: the record isn't in cross-validation. A null stored value is a mismatch.
    """
    from sievelight.operators.splits import TRAINED
    from sievelight.operators.training import prompt_json

    known = records.select(F.col("id").alias("problem_id"), F.col("question_raw").alias("__q"), F.col("answer").cast("string").alias("__a"), F.lit(True).alias("__known"))
    places = split.select(F.col("record_id").alias("problem_id"), *(F.col(c).alias(f"__{c}") for c in ("group_id", "fold", "partition")))
    seen = rows.join(known, "problem_id", "left").join(places, "problem_id", "left").withColumn("__p", parse_answer(F.col("raw_completion")))
    exact = F.coalesce((F.col("__p.status") == "ok") & (F.col("__p.value") == F.col("__a")), F.lit(False))
    there = F.col("__known").isNotNull()
    differs = lambda c, want: there & ~F.col(c).eqNullSafe(want)
    rules = {
        "unknown": ~there,
        "outside": there & ~F.col("__partition").eqNullSafe(F.lit(TRAINED)),
        "group_id": differs("group_id", F.col("__group_id")),
        "fold": differs("fold", F.col("__fold")),
        "question_sha256": differs("question_sha256", F.sha2("__q", 256)),
        "completion_sha256": ~F.col("raw_completion_sha256").eqNullSafe(F.sha2("raw_completion", 256)),
        "status": ~F.col("status").eqNullSafe(F.col("__p.status")),
        "reference_answer": differs("reference_answer", F.col("__a")),
        "exact_match": differs("exact_match", exact),
        "prompt_sha256": differs("prompt_sha256", F.sha2(prompt_json(F.col("__q"), system), 256)),
        "seed": ~F.col("seed").eqNullSafe(T.deterministic_seed(F.col("problem_id"), F.lit(0), salt)),
        **{k: ~F.col(k).eqNullSafe(F.lit(v)) for k, v in (constant or {}).items()},
    }
    return issues(seen, "problem_id", rules).unionByName(repeated(rows, "problem_id", "duplicate_row"))


def sample_index_issues(rows: DataFrame) -> DataFrame:
    """(id, code): problems whose sample indices aren't 0 .. n - 1 once each, or whose n differs from the largest."""
    per = rows.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_distinct("sample_index").alias("d"), F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi"))
    most = per.agg(F.max("n")).first()[0] or 0
    return issues(per, "problem_id", {"repeated_index": F.col("d") < F.col("n"), "not_contiguous": (F.col("lo") != 0) | (F.col("hi") != F.col("d") - 1), "uneven": F.col("n") != most})


def encoding_issues(rows: DataFrame, ignored: int = -100) -> DataFrame:
    """(id, code) of response-only encodings (id, prompt_ids, input_ids, labels, max_length)."""
    k, n = F.size("prompt_ids"), F.size("input_ids")
    rules = {
        "not_longer_than_prompt": n <= k,
        "prompt_not_prefix": F.slice("input_ids", 1, F.greatest(k, F.lit(1))) != F.col("prompt_ids"),
        "truncated": n > F.col("max_length"),
        "label_length": F.size("labels") != n,
        "prompt_labels": F.exists(F.slice("labels", 1, F.greatest(k, F.lit(1))), lambda x: x != ignored),
        "response_labels": F.slice("labels", k + 1, F.greatest(n - k, F.lit(0))) != F.slice("input_ids", k + 1, F.greatest(n - k, F.lit(0))),
    }
    return issues(rows, "id", rules)


def leaks(report: DataFrame, forbidden: tuple[str, ...] = ("id", "answer", "question", "text", "completion")) -> list[str]:
    """Column names of an aggregate report that could carry row content."""
    return [c for c in report.columns if any(c == x or c.endswith(f"_{x}") or c.startswith(f"{x}_") for x in forbidden)]


#: Characters by which values and places of a report meet; shorter values can't be told from counts and common words.
LEAST_VALUE = 6
#: Characters of its cell that a place carries; only values that agree with all of them meet the whole cell.
CARRIED = 32
#: Characters by which longer values meet, so that a common beginning of many ids doesn't bring them into one task.
LONG_START = 16
#: Characters of a cell whose places are made together, so that finding them doesn't take the square of a long text.
CELL_BLOCK = 500


def redaction_issues(report: DataFrame, secrets: DataFrame, first_place: bool = False) -> DataFrame:
    """(kind, column, n_values, n_cells) where cells of an aggregate report hold values of ``secrets`` (kind, value): ids, answers, texts.

    A value counts where it stands in a cell of any type (nested ones as JSON) and isn't part of a longer word or number;
    the result tells how many, never which. Values meet the places of the report by their first LEAST_VALUE or LONG_START characters,
    so neither side is gathered or broadcast. A place carries CARRIED characters, not its cell, which may be a long text;
    what agrees with them is compared whole. Nulls and shorter values are left out.
    With ``first_place`` only the first place of a value in a cell decides, as where SQL's strpos finds it; by default any place does.
    """
    as_text = lambda f: F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`").cast("string")
    cells = report.select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), as_text(f).alias("cell")) for f in report.schema))).alias("c")).select("c.*").where(F.length("cell") >= LEAST_VALUE)
    cells = settled(cells.distinct().withColumn("cell_id", F.sha2("cell", 256)))
    starts = F.sequence(F.lit(0), F.floor((F.length("cell") - 1) / CELL_BLOCK).cast("int"))
    blocks = cells.select("column", "cell_id", F.posexplode(F.transform(starts, lambda k: F.substring("cell", k * CELL_BLOCK + 1, F.lit(CELL_BLOCK + CARRIED)))).alias("k", "block")).where(F.length("block") >= LEAST_VALUE)
    inside = F.sequence(F.lit(1), F.least(F.lit(CELL_BLOCK), F.length("block") - LEAST_VALUE + 1))
    places = blocks.select("column", "cell_id", "k", F.posexplode(F.transform(inside, lambda i: F.substring("block", i, F.lit(CARRIED)))).alias("i", "head"))
    places = places.select("column", "cell_id", (F.col("k") * CELL_BLOCK + F.col("i") + 1).alias("at"), "head", F.explode(F.array_compact(F.array(F.substring("head", 1, LEAST_VALUE), F.when(F.length("head") >= LONG_START, F.substring("head", 1, LONG_START))))).alias("start"))
    values = secrets.where(F.length("value") >= LEAST_VALUE).select("kind", "value").distinct().withColumn("start", F.substring("value", F.lit(1), F.when(F.length("value") >= LONG_START, LONG_START).otherwise(LEAST_VALUE)))
    size = F.length("value")
    word = lambda c: F.coalesce(c.rlike(r"^[\p{L}\p{N}]"), F.lit(False))
    before, after = F.when(F.col("at") > 1, F.substring("cell", F.col("at") - 1, F.lit(1))), F.substring("cell", F.col("at") + size, F.lit(1))
    whole = ~(word(F.col("value")) & word(before)) & ~(word(F.right("value", F.lit(1))) & word(after))
    near = places.join(values, "start").where(F.substring("value", 1, CARRIED) == F.substring("head", F.lit(1), size)).select("kind", "column", "value", "cell_id", "at")
    met = near.join(cells, ["column", "cell_id"]).where(F.substring("cell", F.col("at"), size) == F.col("value")).select("kind", "column", "value", "cell_id", "at", whole.alias("whole"))
    if first_place:
        met = met.groupBy("kind", "column", "value", "cell_id").agg(F.min_by("whole", "at").alias("whole"))
    met = met.where("whole")
    return met.groupBy("kind", "column").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("cell_id").alias("n_cells"))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
