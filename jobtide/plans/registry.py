"""Query registry: each ``q_*`` is a Spark DataFrame job over an adapter or table,
optionally paired with a DuckDB oracle SQL string over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobtide.plans.adapters import ADAPTERS, adapter_sql

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_ADAPTER_REF = re.compile(r"\{\{(\w+)\}\}")


def expand_sql(sql: str) -> str:
    """Replace ``{{adapter}}`` with the adapter's SELECT as a parenthesised subquery."""
    def sub(m):
        name = m.group(1)
        if name not in ADAPTERS:
            raise KeyError(name)
        return "(" + adapter_sql(name) + ")"
    return _ADAPTER_REF.sub(sub, sql).strip()


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = expand_sql(sql)
        return fn
    return deco
