"""Registry of queries: a name, a plan over the bench frames, and SQL where SQL can say the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.plans.bench import Bench
from ledgerscope.plans.oracles import sql

Plan = Callable[[Bench], DataFrame]
_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan, with its SQL counterpart when there is one."""

    def register(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = plan
        if statement is not None:
            _SQL[name] = statement
        return plan

    return register


def _load() -> None:
    for group in ("ingest", "features", "graph", "investigation", "model", "profile", "stream"):
        importlib.import_module(f"ledgerscope.plans.{group}_queries")


def _bound(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plan(Bench(spark, folder))

    return run


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bound(plan) for name, plan in _PLANS.items()}


def statements() -> dict[str, str]:
    _load()
    return {name: sql(body) for name, body in _SQL.items()}
