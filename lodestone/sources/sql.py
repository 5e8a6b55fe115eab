"""SQL text to rows: all as dicts, or batch by batch through a function."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 10_000


def batches(df: DataFrame, size: int = BATCH_ROWS) -> Iterator[list[dict]]:
    """Rows as dicts, ``size`` at a time; the driver holds one partition at most."""
    rows = df.toLocalIterator(prefetchPartitions=False)
    while batch := [r.asDict(recursive=True) for r in itertools.islice(rows, size)]:
        yield batch


def select(spark: SparkSession, sql: str, handle: Callable[[list[dict]], None] | None = None, size: int = BATCH_ROWS, tables: dict[str, DataFrame] | None = None) -> list[dict]:
    """The rows of a query, whose ``tables`` are named in braces; with ``handle`` each batch goes to it and none is returned."""
    df = spark.sql(sql, **(tables or {}))
    if handle is None:
        return [r for b in batches(df, size) for r in b]
    for b in batches(df, size):
        handle(b)
    return []


def retried(work: Callable, tries: int = 5, wait: float = 1.0):
    """What ``work`` returns; after an error it is tried again, up to ``tries`` times, each wait twice the one before."""
    for i in range(tries):
        try:
            return work()
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(wait * 2**i)
    raise ValueError("tries must be one or more")
