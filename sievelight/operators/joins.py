"""Joins on record ids and fingerprints: exclusions, overlaps, routing, pooling, and checks that id sets agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import is_canonical_integer

from sievelight.operators.ranking import meet
from sievelight.session import settled, spread


def exclude(records: DataFrame, excluded: DataFrame, id_col: str = "id") -> DataFrame:
    """Records whose id isn't excluded. Spark broadcasts the exclusions only below its own size threshold."""
    return records.join(excluded.select(id_col).distinct(), id_col, "left_anti")


def unknown_ids(asked: DataFrame, records: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of ``asked`` that no record has."""
    return asked.select(id_col).distinct().join(records, id_col, "left_anti")


def universe_issues(expected: DataFrame, observed: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, code) where the id sets differ: missing, extra or duplicate."""
    a = expected.groupBy(id_col).agg(F.lit(1).alias("want"))
    b = observed.groupBy(id_col).agg(F.count("*").alias("have"))
    codes = F.array_compact(F.array(F.when(F.col("have").isNull(), "missing"), F.when(F.col("want").isNull(), "extra"), F.when(F.col("have") > 1, "duplicate")))
    return a.join(b, id_col, "full_outer").select(F.col(id_col).alias("id"), F.explode(codes).alias("code"))


def fingerprint_groups(records: DataFrame, fp: str, id_col: str = "id") -> DataFrame:
    """(fp, n, first_id): sizes of the groups of equal fingerprints; members stay in the table they came from."""
    return records.where(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("fp")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))


def duplicate_groups(records: DataFrame, fp: str, id_col: str = "id") -> DataFrame:
    """(fp, n, first_id, id): every member of a group with more than one; one row per member, so a huge group stays spread.

    Ids and fingerprints are settled first, as in ``cross_overlap``.
    """
    rows = settled(records.select(F.col(fp).alias("fp"), F.col(id_col).alias("id")))
    groups = fingerprint_groups(rows, "fp", "id").where("n > 1")
    return meet(rows, groups, "fp").select("fp", "n", "first_id", "id")


def duplicate_summary(records: DataFrame, fp: str, id_col: str = "id") -> DataFrame:
    """One row: groups and rows that repeat, and the largest group (1 where nothing repeats)."""
    groups = fingerprint_groups(records, fp, id_col).where("n > 1")
    return groups.agg(F.count("*").alias("group_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.max("n"), F.lit(1)).alias("max_group_size"))


def cross_overlap(a: DataFrame, b: DataFrame, fp: str, id_col: str = "id") -> DataFrame:
    """(fp, n_a, first_a, n_b, first_b) of fingerprints on both sides; each side is grouped before they meet.

    Ids and fingerprints are settled first: the join's tests for null would compute long fingerprints over again.
    """
    x = fingerprint_groups(settled(a.select(fp, id_col)), fp, id_col).select("fp", F.col("n").alias("n_a"), F.col("first_id").alias("first_a"))
    y = fingerprint_groups(settled(b.select(fp, id_col)), fp, id_col).select("fp", F.col("n").alias("n_b"), F.col("first_id").alias("first_b"))
    return x.join(y, "fp")


def overlap_summary(overlap: DataFrame) -> DataFrame:
    return overlap.agg(F.count("*").alias("shared_fingerprints"), F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"))


def route(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(id, prediction, used): the fallback's value only where the primary has none that can be read; neither: no prediction (never 0)."""
    a, b = primary.select("id", readable("prediction").alias("p")), fallback.select("id", readable("prediction").alias("q"))
    joined = a.join(b, "id", "left")
    used = F.when(F.col("p").isNotNull(), "primary").when(F.col("q").isNotNull(), "fallback").otherwise("none")
    return joined.select("id", F.coalesce("p", "q").alias("prediction"), used.alias("used"))


def readable(name: str) -> Column:
    """The prediction, or null where it isn't a canonical integer."""
    return F.when(is_canonical_integer(F.col(name)), F.col(name))


def ordered_pairs(labels: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in labels for b in labels if a != b]


def all_routes(runs: DataFrame) -> DataFrame:
    """(a, b, id, prediction, used) for every ordered pair of runs in a table (label, id, prediction).

    The runs of one id meet by grouping on the id (a run is one array element), so no table is crossed with another.
    """
    per_id = runs.groupBy("id").agg(F.collect_list(F.struct("label", "prediction")).alias("r"))  # one element per run
    out = per_id.select("id", F.explode("r").alias("x"), "r").select("id", "x", F.explode("r").alias("y")).where("x.label <> y.label")
    p, q = readable("x.prediction"), readable("y.prediction")
    used = F.when(p.isNotNull(), "primary").when(q.isNotNull(), "fallback").otherwise("none")
    return out.select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), "id", F.coalesce(p, q).alias("prediction"), used.alias("used"))


def pool(parts: list[DataFrame]) -> DataFrame:
    """The union of out-of-fold results; repeated (label, id) raise when the rows are read."""
    rows = spread(reduce(DataFrame.unionByName, parts), "label", "id")
    n = F.count("*").over(Window.partitionBy("label", "id"))
    return rows.withColumn("__n", n).select(*(F.when(F.col("__n") > 1, F.raise_error(F.lit("an id is in more than one fold of a run"))).otherwise(F.col(c)).alias(c) if c == "id" else F.col(c) for c in rows.columns))


def missing_cells(runs: DataFrame, labels: list[str], folds: int) -> DataFrame:
    """(label, fold) cells without any row."""
    spark = runs.sparkSession
    cells = spark.createDataFrame([(a, f) for a in labels for f in range(folds)], "label string, fold int")
    return cells.join(runs.select("label", "fold").distinct(), ["label", "fold"], "left_anti")


def bank_subset(banks: list[DataFrame], expected: DataFrame, id_col: str = "problem_id") -> tuple[DataFrame, DataFrame]:
    """(rows of the expected ids from the union of the banks, issues (id, code): duplicate in the banks or missing)."""
    rows = reduce(DataFrame.unionByName, banks)
    twice = rows.groupBy(F.col(id_col).alias("id")).count().where("count > 1").select("id", F.lit("duplicate").alias("code"))
    absent = expected.select(F.col(id_col).alias("id")).join(rows.select(F.col(id_col).alias("id")), "id", "left_anti").select("id", F.lit("missing").alias("code"))
    return rows.join(expected.select(id_col).distinct(), id_col, "left_semi"), twice.unionByName(absent)


def binding_issues(stored: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field) where a stored row differs from the one derived anew; ``row`` where one of the two is absent."""
    a = stored.select(key, F.struct(*columns).alias("s"), F.lit(True).alias("in_s"))
    b = derived.select(key, F.struct(*columns).alias("d"), F.lit(True).alias("in_d"))
    fields = F.array_compact(F.array(*(F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")), F.lit(c)) for c in columns)))
    odd = F.when(F.col("in_s").isNull() | F.col("in_d").isNull(), F.array(F.lit("row"))).otherwise(fields)
    return a.join(b, key, "full_outer").select(key, F.explode(odd).alias("field"))
