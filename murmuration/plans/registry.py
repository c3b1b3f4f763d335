"""A query's Spark plan and the SQL that states its result, under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan by its function's name; without SQL its rows are only tested."""

    def add(plan: Plan) -> Plan:
        name = plan.__name__
        if name in PLANS:
            raise ValueError(f"two queries are named {name}")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add
