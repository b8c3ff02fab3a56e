"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB twin per operator.

Each entry is ``name -> (build(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Names are the SURVEY ids plus the operator name.  Every plan reads the whole
test tables (through the fixture derivations) with the documented default
parameters, except where FIXTURES.md gives a reason (q_goals_fraud.py: floor 100,
hour buckets, unit 10); there are no row caps or id subsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_fixtures

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: list[tuple[str, str]] | None = None):
    """Decorator: register a Spark builder and its oracle SQL body."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_fixtures(sql, ctes)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its decorators run."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")


MODULES = ["q_banking", "q_goals_fraud", "q_telemetry", "q_evaluation", "q_safety", "q_text", "q_projections", "q_misc", "q_core", "q_widgets"]
