"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.plans import analytics, answers, corpus, dashboard, fixtures, interviews, records, services, sessions

_PLANS = (sessions, corpus, analytics, fixtures, answers, records, dashboard, interviews, services)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for plan in _PLANS for f in plan.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for plan in _PLANS for k, v in plan.ORACLE.items()}
