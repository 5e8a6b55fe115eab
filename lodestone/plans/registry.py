"""The registered queries: a function of (spark, sf_dir), its SQL on the same tables, and the operators it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, *, views: bool = True) -> Callable[[Callable], Callable]:
    """Registers a function of the logical tables (``fixtures.Tables``) under its own name.

    ``sql`` may use the logical views by name; ``views=False`` leaves their definitions out.
    """

    def register(f: Callable[[fixtures.Tables], DataFrame]) -> Callable:
        text = None if sql is None else fixtures.with_views(sql) if views else sql
        QUERIES[f.__name__] = Query(lambda spark, sf_dir: f(fixtures.Tables(spark, sf_dir)), text, tuple(covers.split()))
        return f

    return register
