"""Names of the runnable queries, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.session import configure
from assayer.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan(tables)`` under ``name``; ``sql`` is the DuckDB statement it must equal."""

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql.strip()
        return plan

    return add


def runnable(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Tables(configure(spark), sf_dir))
