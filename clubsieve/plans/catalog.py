"""All registered queries: importing a query module registers what it holds."""
from . import (change_queries, filter_queries, join_queries, merge_queries, page_queries,  # noqa: F401
               report_queries, scalar_queries, scoring_queries, source_queries, stream_queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
