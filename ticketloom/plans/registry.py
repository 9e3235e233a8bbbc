"""The catalogue: name -> runnable query, SQL twin and the inventory items it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None
    covers: tuple[str, ...]


CATALOGUE: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``; ``covers`` lists inventory ids."""

    def wrap(fn: Runner) -> Runner:
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Query(name, fn, sql, tuple(covers.split()))
        return fn

    return wrap
