"""All registered queries and their SQL."""

from __future__ import annotations

from faultlens.plans import grading_queries, graph_queries, io_queries, lexical_queries, log_queries, mining_queries, rule_queries, vector_queries

GROUPS = [lexical_queries, vector_queries, log_queries, mining_queries, graph_queries, grading_queries, rule_queries, io_queries]


def queries() -> dict:
    out: dict = {}
    for group in GROUPS:
        doubled = out.keys() & group.QUERIES.keys()
        if doubled:
            raise ValueError(f"query registered twice: {sorted(doubled)}")
        out.update(group.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLE.items()}
