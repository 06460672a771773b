"""Row numbers and running sums over whole tables, without a single-partition window.

Rows are ordered by a digest column (hex, so uniformly spread). Its first characters name a bucket; sums per bucket are
added up first (4,096 buckets for each key), so the large windows only ever run inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_CHARS = 3


def running(df: DataFrame, order: list[str], keys: list[str] | None = None, value: Column | None = None, name: str = "upto") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (1: a row number) over the rows of the same ``keys`` up to this one.

    ``order[0]`` is the digest, the rest breaks its ties; rows equal in all of them are numbered in any order.
    """
    keys = keys or []
    value = F.lit(1) if value is None else value
    work = df.withColumns({"__b": F.substring(order[0], 1, BUCKET_CHARS), "__v": value.cast("long")})
    own = [*keys, "__b"]
    sums = work.groupBy(*own).agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*own, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [work[c].eqNullSafe(base[c]) for c in own]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    inner = work.withColumn("__in", F.sum("__v").over(inside))
    base = base.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(own)), "__base")
    for i, c in enumerate(own):
        part = inner[c].eqNullSafe(base[f"__k{i}"])
        cond = part if i == 0 else cond & part
    joined = inner.join(base, cond)
    return joined.withColumn(name, F.col("__base") + F.col("__in")).select(*df.columns, name)


def meet(rows: DataFrame, groups: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that was grouped by ``key``, so that a key with a large share of the rows may be split.

    The hash beside the key keeps Spark from reusing the grouping's own exchange; both sides then come from exchanges
    that adaptive execution may divide where one partition is too large.
    """
    keys = [key] if isinstance(key, str) else key
    h = F.xxhash64(F.lit(7), *keys)
    return rows.withColumn("__h", h).join(groups.withColumn("__h", h), ["__h", *keys], how).drop("__h")


def numbered(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "rn") -> DataFrame:
    return running(df, order, keys, None, name)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; Spark keeps n rows per task and merges them."""
    return df.orderBy(*order).limit(n)
