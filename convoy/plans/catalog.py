"""All core queries and their SQL by name."""

from __future__ import annotations

from convoy.plans import dispatch, pipeline, pools, problems, reports, store, streams

MODULES = [problems, store, dispatch, pools, reports, pipeline, streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
