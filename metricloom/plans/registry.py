"""Where queries and their SQL statements are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metricloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name; ``covers`` names the survey rows it answers."""

    def register(build):
        name = build.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            STATEMENTS[name] = sql
        return build

    return register
