"""What the plans must not hold, and what must reach the scans."""

from __future__ import annotations

import pytest

from sievelight.plans.all_queries import QUERIES

SAMPLE = ("q_dup_summary", "q_cross_overlap_source", "q_quality_flags", "q_strata", "q_vote_status", "q_next_budget", "q_exact_match", "q_contingency", "q_routing_pairs", "q_submission_issues", "q_resolve", "q_ledger_state", "q_latest_valid", "q_run_manifest", "q_corpus_issues", "q_eligible_training", "q_sft_examples", "q_classify")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_products_and_no_row_udfs(spark, sf, name):
    said = plan(QUERIES[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in said


def test_columns_are_pruned(spark, sf):
    said = plan(QUERIES["q_exact_match"](spark, sf))
    assert "o_orderkey" in said and "o_orderdate" not in said and "o_totalprice" not in said
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)]" in plan(QUERIES["q_exclude"](spark, sf))


def test_numbers_do_not_gather(spark):
    """Row numbers over a whole table: only the sums per bucket or partition meet in one place."""
    from pyspark.sql import functions as F

    from sievelight.operators import ranking

    said = plan(ranking.numbered(spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")), ["h"]))
    window = [x for x in said.splitlines() if "Exchange SinglePartition" in x]
    assert len(window) == 1  # over the 4,096 sums
