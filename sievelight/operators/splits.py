"""Grouped holdout and balanced folds, as functions of the groups alone (never of row order or partitioning).

The holdout takes groups in a pseudo-random order, each if it brings the size strictly closer to the target. As the
missing size r only shrinks, a group of size s is taken exactly if s < 2r; so a running sum takes all groups up to the
first refusal, and groups as large as that one can be left out at once. A few such passes replace the sequential scan.

Folds are filled largest group first, each group to the fold with the least (size, groups, tie rank). Groups of one size
are interchangeable: fold f offers the slots (size_f + s t, groups_f + t, rank_f), t = 0, 1, ..., and the i-th group
takes the i-th least slot. The order of slots is periodic between the points where another fold joins in, so the driver
derives it from the counts per distinct size, and groups look their fold up by their number within the size.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import stable_rank
from sievelight.operators.ranking import numbered, running
from sievelight.session import settled

HOLDOUT, TRAINED = "final_locked_holdout", "cross_validation"
#: Distinct group sizes that the driver handles (they are at most the square root of twice the records).
MAX_SIZES = 1_000_000


def _rank(namespace: str, seed: int, version: str, value: str) -> str:
    return hashlib.sha256("\0".join((namespace, str(seed), version, value)).encode()).hexdigest()


def choose_holdout(groups: DataFrame, fraction: float, n_folds: int, seed: int, version: str) -> DataFrame:
    """The ``group_id`` of the holdout, from (group_id, size). The double product of rows and fraction is the target."""
    ranked = settled(groups.select("group_id", F.col("size").cast("long"), stable_rank("holdout", seed, version, F.col("group_id")).alias("rank")))
    n_groups, total = ranked.agg(F.count("*"), F.sum("size")).first()
    if n_groups < n_folds + 1:
        raise ValueError(f"{n_groups} groups don't fill {n_folds} folds and a holdout")
    target = Fraction(float(total) * fraction)
    rest, after, taken, parts = target, None, 0, []
    while rest > 0:
        # s < 2 (rest - sum before) as integers: sum up to here + sum before < 2 rest
        limit = -(-2 * rest // 1)  # least integer not below 2 rest
        pool = ranked.where(F.col("size") < int(limit))
        if after is not None:
            pool = pool.where(F.struct("rank", "group_id") > F.struct(F.lit(after[0]).alias("rank"), F.lit(after[1]).alias("group_id")))
        summed = running(pool, ["rank", "group_id"], value=F.col("size"))
        refused = summed.where(2 * F.col("upto") - F.col("size") >= int(limit)).agg(F.min(F.struct("rank", "group_id"))).first()[0]
        ok = pool if refused is None else pool.where(F.struct("rank", "group_id") < F.struct(F.lit(refused[0]).alias("rank"), F.lit(refused[1]).alias("group_id")))
        got = ok.agg(F.sum("size")).first()[0] or 0
        parts.append((after, refused, int(limit)))
        taken, rest = taken + got, rest - got
        if refused is None:
            break
        after = tuple(refused)

    def inside(bounds) -> DataFrame:
        lo, hi, most = bounds
        cond = F.col("size") < most
        key = F.struct("rank", "group_id")
        point = lambda x: F.struct(F.lit(x[0]).alias("rank"), F.lit(x[1]).alias("group_id"))
        if lo is not None:
            cond &= key > point(lo)
        if hi is not None:
            cond &= key < point(hi)
        return ranked.where(cond).select("group_id", "size")

    chosen = None
    if taken:
        for p in parts:
            chosen = inside(p) if chosen is None else chosen.unionByName(inside(p))
    far = lambda x: F.abs(x - F.lit(float(target)))
    if chosen is None:
        chosen = ranked.orderBy(far(F.col("size")), stable_rank("holdout-fallback", seed, version, F.col("group_id"))).limit(1).select("group_id", "size")
    chosen = settled(chosen)
    n_chosen, taken = chosen.agg(F.count("*"), F.sum("size")).first()
    while n_groups - n_chosen < n_folds:  # at most n_folds times: the scan can't take nearly all groups otherwise
        out = chosen.orderBy(far(F.lit(taken) - F.col("size")), stable_rank("holdout-trim", seed, version, F.col("group_id"))).first()
        chosen = settled(chosen.where(F.col("group_id") != out[0]))
        n_chosen, taken = n_chosen - 1, taken - out[1]
    return chosen.select("group_id")


def slot_segments(counts: list[tuple[int, int]], n_folds: int, ties: list[str]) -> list[tuple[int, int, int, list[int]]]:
    """(size, first number, end, folds in turn) from the number of groups of each size; numbers start at 0 in each size."""
    full, groups, out = [0] * n_folds, [0] * n_folds, []
    for s, m in sorted(counts, reverse=True):
        used = [0] * n_folds
        slot = lambda f: (full[f] + s * used[f], groups[f] + used[f], ties[f])  # noqa: B023, E731
        waiting = sorted(range(n_folds), key=slot)
        active: list[int] = []
        at = 0
        while at < m:
            if waiting:
                active.append(waiting.pop(0))
                if waiting and slot(waiting[0])[0] == slot(active[-1])[0]:
                    nxt = waiting[0]
                else:
                    nxt = waiting[0] if waiting else None
            else:
                nxt = None
            turn = sorted(active, key=slot)
            if nxt is None:
                n = m - at
            else:
                goal = slot(nxt)
                n = 0
                for f in active:
                    a = slot(f)
                    if a < goal:
                        q = max(0, (goal[0] - a[0]) // s)  # slots with a smaller size; the one of equal size by groups and rank
                        whole = q if (goal[0] - a[0]) % s else q + ((a[0] + s * q, a[1] + q, a[2]) < goal)
                        n += whole + ((goal[0] - a[0]) % s > 0)
                n = min(n, m - at)
            if n:
                out.append((s, at, at + n, turn))
                for i, f in enumerate(turn):
                    used[f] += n // len(turn) + (i < n % len(turn))
                at += n
        for f in range(n_folds):
            full[f] += s * used[f]
            groups[f] += used[f]
    return out


def assign_folds(groups: DataFrame, n_folds: int, seed: int, version: str) -> DataFrame:
    """(group_id, fold) for (group_id, size)."""
    spark = groups.sparkSession
    ranked = settled(groups.select("group_id", F.col("size").cast("long"), stable_rank("cv-group", seed, version, F.col("group_id")).alias("rank")))
    counts = [tuple(r) for r in ranked.groupBy("size").count().limit(MAX_SIZES + 1).collect()]
    if len(counts) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} distinct group sizes")
    ties = [_rank("fold", seed, version, str(f)) for f in range(n_folds)]
    segments = spark.createDataFrame(slot_segments(counts, n_folds, ties), "size long, lo long, hi long, turn array<int>")
    number = numbered(ranked, ["rank", "group_id"], ["size"])
    small = F.broadcast(segments) if len(counts) <= 50_000 else segments
    joined = number.join(small, "size").where("rn - 1 >= lo AND rn - 1 < hi")
    return joined.select("group_id", F.element_at("turn", (F.pmod(F.col("rn") - 1 - F.col("lo"), F.size("turn")) + 1).cast("int")).alias("fold"))


def make_split(assignments: DataFrame, n_folds: int = 5, fraction: float = 0.1, seed: int = 0, version: str = "v1") -> DataFrame:
    """(record_id, group_id, partition, fold) of every record, from (record_id, group_id); the holdout's fold is null."""
    groups = settled(assignments.groupBy("group_id").agg(F.count("*").alias("size")))
    held = settled(choose_holdout(groups, fraction, n_folds, seed, version).withColumn("held", F.lit(True)))
    folds = assign_folds(groups.join(held, "group_id", "left_anti"), n_folds, seed, version)
    placed = folds.select("group_id", F.lit(TRAINED).alias("partition"), "fold").unionByName(held.select("group_id", F.lit(HOLDOUT).alias("partition"), F.lit(None).cast("int").alias("fold")))
    return assignments.select("record_id", "group_id").join(placed, "group_id").select("record_id", "group_id", "partition", "fold")


def fold_ids(split: DataFrame, fold: int) -> DataFrame:
    return split.where((F.col("partition") == TRAINED) & (F.col("fold") == fold)).select("record_id")


def training_ids(split: DataFrame, fold: int) -> DataFrame:
    """Every record outside the holdout and the validation fold."""
    return split.where((F.col("partition") == TRAINED) & (F.col("fold") != fold)).select("record_id")


def holdout_ids(split: DataFrame) -> DataFrame:
    return split.where(F.col("partition") == HOLDOUT).select("record_id")


def scope(split: DataFrame, name: str, fold: int | None = None) -> DataFrame:
    """Record ids of a scope: all, cv-only, fold-training or fold-validation (the last two need a fold)."""
    if name in ("all", "cv-only"):
        if fold is not None:
            raise ValueError(f"scope {name} takes no fold")
        return split.select("record_id") if name == "all" else split.where(F.col("partition") == TRAINED).select("record_id")
    if fold is None:
        raise ValueError(f"scope {name} needs a fold")
    return {"fold-training": training_ids, "fold-validation": fold_ids}[name](split, fold)


def expand_exclusions(split: DataFrame, excluded: DataFrame) -> DataFrame:
    """All records of the groups that hold an excluded ``record_id``."""
    groups = split.join(excluded.select("record_id").distinct(), "record_id", "left_semi").select("group_id").distinct()
    return split.join(groups, "group_id", "left_semi").select("record_id", "group_id")


def eligible(split: DataFrame, excluded: DataFrame, fold: int, validation: bool = False) -> DataFrame:
    """Training (or validation) records of a fold whose group holds no excluded record."""
    rows = split.where((F.col("partition") == TRAINED) & ((F.col("fold") == fold) if validation else (F.col("fold") != fold)))
    groups = split.join(excluded.select("record_id").distinct(), "record_id", "left_semi").select("group_id").distinct()
    return rows.join(groups, "group_id", "left_anti").select("record_id", "group_id", "fold")


def actual_counts(split: DataFrame, n_folds: int) -> DataFrame:
    """(part, fold, n_records, n_groups) for the holdout and every fold, empty ones included."""
    spark = split.sparkSession
    parts = spark.createDataFrame([(HOLDOUT, None), *((TRAINED, f) for f in range(n_folds))], "part string, fold int")
    got = split.groupBy(F.col("partition").alias("p"), F.col("fold").alias("f")).agg(F.count("*").alias("r"), F.countDistinct("group_id").alias("g"))
    joined = parts.join(got, (parts["part"] == got["p"]) & parts["fold"].eqNullSafe(got["f"]), "left")
    return joined.select("part", "fold", F.coalesce("r", F.lit(0)).alias("n_records"), F.coalesce("g", F.lit(0)).alias("n_groups"))


def split_issues(split: DataFrame, n_folds: int) -> DataFrame:
    """(code, subject): repeated records, groups in more than one part, bad partitions or folds, empty folds."""
    s = lambda c: F.col(c).cast("string")
    repeated = split.groupBy("record_id").count().where("count > 1").select(F.lit("duplicate_record").alias("code"), s("record_id").alias("subject"))
    torn = split.groupBy("group_id").agg(F.min(F.struct("partition", "fold")).alias("a"), F.max(F.struct("partition", "fold")).alias("z")).where(~F.col("a").eqNullSafe(F.col("z"))).select(F.lit("split_group"), s("group_id"))
    bad = split.where(~F.col("partition").isin(HOLDOUT, TRAINED) | ((F.col("partition") == HOLDOUT) & F.col("fold").isNotNull()) | ((F.col("partition") == TRAINED) & ~F.coalesce(F.col("fold").between(0, n_folds - 1), F.lit(False)))).select(F.lit("bad_fold"), s("record_id"))
    empty = actual_counts(split, n_folds).where("n_records = 0").select(F.lit("empty_part"), F.coalesce(F.concat(F.lit("fold "), s("fold")), F.col("part")))
    misnamed = split.groupBy("group_id").agg(F.min("record_id").alias("least")).where(s("group_id") != s("least")).select(F.lit("group_name"), s("group_id"))
    return repeated.union(torn).union(bad).union(empty).union(misnamed)


def source_groups_sha256(split: DataFrame, buckets: int = 256) -> DataFrame:
    """One row: a digest of all (record_id, group_id) in order. Digests of ranges by the record's hash are joined, so no task holds the whole list."""
    pairs = split.select(F.sha2(F.col("record_id").cast("string"), 256).alias("h"), F.to_json(F.array(F.col("record_id").cast("string"), F.col("group_id").cast("string"))).alias("j"))
    cell = pairs.groupBy(F.substring("h", 1, 4).alias("b")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("j"))), 256).alias("d"))
    return cell.agg(F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])), 256).alias("source_groups_sha256"))
