"""Registry of the queries that run over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from strandlake.session import ship_package


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows, if there is one."""

    def add(run):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")

        def shipped(spark, sf_dir):
            ship_package(spark)
            return run(spark, sf_dir)

        CATALOG[name] = Query(shipped, sql)
        return run

    return add
