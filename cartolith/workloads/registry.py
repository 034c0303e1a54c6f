"""Registry of runnable queries and their check SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolith import workloads
from cartolith.session import configure
from cartolith.workloads.views import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", raw: bool = False):
    """Register a query; ``views`` names the derived views the check SQL reads."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(configure(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql if raw or not views else _attach(sql, views)
        return fn

    return register


def _attach(sql: str, views: str) -> str:
    head = with_views(*views.split())
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return head.rstrip() + ",\n" + body[5:]
    return head + body


def load_all() -> None:
    """Import every module of this package that registers queries."""
    for module in pkgutil.iter_modules(workloads.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{workloads.__name__}.{module.name}")
