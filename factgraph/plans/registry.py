"""Queries by name with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.sources.binding import Facts, with_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Facts], DataFrame]], Callable[[Facts], DataFrame]]:
    """Registers a function of the fact tables as a query, with its SQL over the same views."""

    def add(work: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: work(Facts(spark, sf_dir))
        if sql:
            ORACLES[name] = with_facts(sql)
        return work

    return add
