"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from foliolith.plans import details, papers, portal, reviewing, workflow

ALL = {**papers.QUERIES, **workflow.QUERIES, **reviewing.QUERIES, **portal.QUERIES, **details.QUERIES}


def queries():
    return {k: v[0] for k, v in ALL.items()}


def oracle_sql():
    return {k: v[1] for k, v in ALL.items() if v[1]}
