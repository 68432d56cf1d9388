"""Registered queries: one Spark plan and (where SQL can say it) one oracle SQL per operator.

Each query reads the driver tables under ``sf_dir`` through ``DriverViews``
and runs an operator over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodgelake import AS_OF_DEFAULT
from lodgelake.plans.oracle_views import with_views
from lodgelake.sources.views import DriverViews

AS_OF = AS_OF_DEFAULT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its optional oracle SQL."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(DriverViews(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = with_views(oracle)
        return fn

    return deco


def _load_all() -> None:
    # importing the plan modules fills QUERIES / ORACLE
    from lodgelake.plans import (  # noqa: F401
        q_accounts,
        q_bookings,
        q_branches,
        q_catalog,
        q_changes,
        q_pricing,
        q_reports,
        q_streaming,
    )


_load_all()
