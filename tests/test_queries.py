"""Every query against its SQL on the smallest tables; those without SQL run and have a stable schema."""

from __future__ import annotations

import pytest

from sievelight.plans.all_queries import ORACLE_SQL, QUERIES
from tools.verify import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE_SQL.get(name), sf) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["problem_id", "status", "selected_answer", "share", "verified", "n_candidates", "n_answers"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_partitioning_does_not_matter(spark, sf):
    from pyspark.sql import functions as F

    from sievelight.operators import splits, voting
    from sievelight.plans import inputs

    groups = inputs.records(spark, sf).select(F.col("id").alias("record_id"), F.col("source").alias("group_id"))
    rows = inputs.candidates(spark, sf)
    seen = []
    for n in (1, 4, 13):
        split = splits.make_split(groups.repartition(n), 3, 0.2, 1, "v").collect()
        votes = voting.aggregate_candidates(rows.repartition(n)).collect()
        seen.append((sorted(map(tuple, split), key=str), sorted(map(tuple, votes), key=str)))
    assert seen[0] == seen[1] == seen[2]
