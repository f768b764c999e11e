"""Registered queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_queries() -> dict[str, Query]:
    from gleaner.plans.registered import corpus, lines, lists, reports, runs, stored, streams, telemetry, vectors

    out: dict[str, Query] = {}
    for module in (lines, corpus, lists, telemetry, vectors, runs, reports, stored, streams):
        out.update(module.QUERIES)
    return out


def all_sql() -> dict[str, str]:
    from gleaner.plans.registered import corpus, lines, lists, reports, runs, stored, streams, telemetry, vectors

    out: dict[str, str] = {}
    for module in (lines, corpus, lists, telemetry, vectors, runs, reports, stored, streams):
        out.update(module.SQL)
    return out
