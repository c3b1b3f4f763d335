"""All analytical queries by name, each with the SQL that states its result."""

from __future__ import annotations

from murmuration.plans import classification, evaluation, graph, moderation, relational, scoring, series, text
from murmuration.plans.registry import PLANS, SQL, Plan

MODULES = (relational, series, text, scoring, evaluation, graph, classification, moderation)


def queries() -> dict[str, Plan]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
