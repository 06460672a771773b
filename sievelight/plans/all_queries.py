"""Imports every module that registers queries."""

from sievelight.plans import crossfold_queries, eval_queries, io_queries, ledger_queries, manifest_queries, text_queries  # noqa: F401
from sievelight.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
