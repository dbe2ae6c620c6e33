"""All queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from skein.plans import action_queries, action_sql, claim_queries, claim_sql, gap_queries, gap_sql, merge_queries, merge_sql, report_queries, report_sql, star_queries, star_sql
from skein.plans.star_queries import Query


def queries() -> dict[str, Query]:
    return star_queries.queries() | report_queries.queries() | action_queries.queries() | claim_queries.queries() | merge_queries.queries() | gap_queries.queries()


def oracle_sql() -> dict[str, str]:
    return star_sql.SQL | report_sql.SQL | action_sql.SQL | claim_sql.SQL | merge_sql.SQL | gap_sql.SQL
