"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from evidentia.plans.common import QueryFn

AREAS = ("statistics", "selection", "networks", "anomalies", "synthesis", "causal")


def registered() -> tuple[dict[str, QueryFn], dict[str, str]]:
    queries: dict[str, QueryFn] = {}
    sql: dict[str, str] = {}
    for area in AREAS:
        reg = import_module(f"evidentia.plans.{area}").REG
        queries.update(reg.queries)
        sql.update(reg.sql)
    return queries, sql
