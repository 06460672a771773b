"""Clusters of records that share labels or are named as pairs.

Pairs and labels make a graph; its components come from alternating large and small stars, whose rounds grow with the
logarithm of the paths. A label joins its members through the least of them, so a label with a third of all rows makes
a star and never a clique; hubs are only aggregated, and joined where their rows may be divided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.ranking import meet
from sievelight.session import release, settled


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of the component.

    Self-loops and nulls are ignored. Raises if ``max_rounds`` don't suffice (paths beyond 2**30 don't occur).
    """
    e = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = meet(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settled(rest.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        del both, least, large, rest
        release(e.sparkSession)
        if now == seen:
            roots = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        seen = now
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


def _links(pairs: DataFrame | None, labels: DataFrame | None) -> DataFrame:
    """(id, least): the least member of each label that an id shares with others and of each pair that it is in."""
    parts = []
    if labels is not None:
        labels = settled(labels.select("id", "label").where("id IS NOT NULL AND label IS NOT NULL"))  # labels can be long chains of expressions
        least = labels.groupBy("label").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("label", "least")
        parts.append(meet(labels, least, "label").select("id", "least"))
    if pairs is not None:
        least = F.least("a", "b")
        parts += [pairs.where("a <> b").select(F.col(side).alias("id"), least.alias("least")) for side in ("a", "b")]
    return settled(parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts))


def build_clusters(ids: DataFrame, pairs: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(id, group_id) of every id; ``pairs`` (a, b) and equal ``labels`` (id, label) join records, transitively.

    The group is named after its least member. Pairs with an id that isn't in ``ids`` raise.

    Only the least members of labels and pairs are nodes of the graph, and an id in several joins theirs: where most
    ids share one label, the rounds go over the few that tie labels together, not over the table.
    """
    if pairs is not None:
        named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        stray = named.join(ids, "id", "left_anti").select("id").limit(1).collect()
        if stray:
            raise ValueError(f"a pair names an unknown id: {stray[0][0]!r}")
    elif labels is None:
        return ids.select("id", F.col("id").alias("group_id"))
    links = _links(pairs, labels)
    first = settled(links.groupBy("id").agg(F.min("least").alias("first"), F.max("least").alias("last")))
    several = first.where("first <> last").select("id", "first")
    roots = components(meet(links, several, "id").where("least <> first").select(F.col("least").alias("a"), F.col("first").alias("b")))
    found = first.select("id", "first").join(roots, F.col("first") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("root", "first").alias("root"))
    return ids.join(found, ids["id"] == found["node"], "left").select("id", F.coalesce("root", "id").alias("group_id"))


def clusters_by_label(records: DataFrame, label: str, id_col: str = "id") -> DataFrame:
    """(id, group_id) where one label per record decides, without any iteration: the least id of each label.

    The least is taken before rows meet it, so a label with a third of all rows is never held as a whole. Records
    without a label are groups of their own.
    """
    rows = settled(records.select(F.col(id_col).alias("id"), F.col(label).alias("label")))  # labels can be long chains of expressions
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    return meet(rows, least, "label", "left").select("id", F.coalesce("least", "id").alias("group_id"))
