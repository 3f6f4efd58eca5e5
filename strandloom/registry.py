"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from strandloom.plans import queries as q


def queries():
    return dict(q.QUERIES)


def oracle_sql():
    return dict(q.SQL)
