"""Counts of documents by one or two dimensions, with gaps filled and axes limited."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: Dimension name to its Column.
DIMENSIONS: dict[str, Callable[[], Column]] = {
    "canonical_name": lambda: F.col("name"),
    "instance_rollup": lambda: F.col("instance_rollup"),
    "category_rollup": lambda: F.col("category_rollup"),
    "domain": lambda: F.col("domain"),
    "doc_type": lambda: F.col("doc_type"),
    "year": lambda: dates.year_of(F.col("doc_date")),
    "title": lambda: F.col("title"),
}


def counts(rows: DataFrame, x: str, y: str | None = None, *, distinct: str | None = None) -> DataFrame:
    """(x[, y], count) of rows, or of distinct values of column ``distinct``; rows without x are left out."""
    for d in (x, y):
        if d is not None and d not in DIMENSIONS:
            raise ValueError(f"no dimension {d}")
    keys = [DIMENSIONS[d]().alias(n) for d, n in ((x, "x"), (y, "y")) if d is not None]
    n = F.count(F.lit(1)) if distinct is None else F.countDistinct("_d")
    base = rows.select(*keys, *([F.col(distinct).alias("_d")] if distinct else [])).filter("x IS NOT NULL")
    return base.groupBy(*(["x", "y"] if y else ["x"])).agg(n.alias("count"))


def gap_filled(report: DataFrame) -> DataFrame:
    """Every x with every y that occurs, missing counts as 0.

    The y axis is one value, a scalar subquery, that each x explodes.
    """
    ys = report.agg(F.array_sort(F.collect_set("y"))).scalar()
    grid = report.select("x").distinct().select("x", F.explode(ys).alias("y"))
    return grid.join(report, ["x", "y"], "left").select("x", "y", F.coalesce("count", F.lit(0)).alias("count"))


def top_of(report: DataFrame, axis: str, n: int, value: str = "count") -> DataFrame:
    """All rows of the n values of ``axis`` with the largest totals, ties by name."""
    best = report.groupBy(axis).agg(F.sum(value).alias("_total")).orderBy(F.col("_total").desc(), axis).limit(n).select(axis)
    return report.join(best, axis, "left_semi")


def by_filters(rows: DataFrame, filters: dict[str, Column], report: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The report of each filter's rows, with the filter's title as column ``report``."""
    return reduce(DataFrame.unionByName, [report(rows.filter(f)).withColumn("report", F.lit(title)) for title, f in filters.items()])


def pivoted(report: DataFrame, values: list) -> DataFrame:
    """One row per x, a column per y of ``values``, 0 where there is none."""
    return report.groupBy("x").pivot("y", values).agg(F.sum("count")).na.fill(0)


def characteristics(matches: DataFrame, heads: DataFrame, tails: DataFrame, head: str, tail: str, head_limit: int = 15, tail_limit: int = 30, with_ids: bool = False) -> DataFrame:
    """(head, tail, count): distinct documents for pairs of a head's and a tail's rollups, over the matching documents.

    Matches are reduced to distinct ids first.  The pairs of the head_limit heads and tail_limit tails in most pairs stay.
    """
    ids = matches.select("doc_id").distinct()
    h = heads.join(ids, "doc_id", "left_semi").select("doc_id", F.col(head).alias("head")).filter("head IS NOT NULL").distinct()
    t = tails.join(ids, "doc_id", "left_semi").select("doc_id", F.col(tail).alias("tail")).filter("tail IS NOT NULL").distinct()
    found = [F.count(F.lit(1)).alias("count"), *([F.array_sort(F.collect_list("doc_id")).alias("doc_ids")] if with_ids else [])]
    pairs = h.join(t, "doc_id").groupBy("head", "tail").agg(*found)

    def best(axis: str, n: int) -> DataFrame:
        return pairs.groupBy(axis).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), axis).limit(n).select(axis)

    return pairs.join(best("head", head_limit), "head", "left_semi").join(best("tail", tail_limit), "tail", "left_semi")


def yearly(rows: DataFrame, keys: list[str], start_year: int, end_year: int, year: str = "year") -> DataFrame:
    """(keys, year, count) with a row for every year from start to end of every key that occurs."""
    n = rows.filter(F.col(year).between(start_year, end_year)).groupBy(*keys, F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("count"))
    spine = rows.select(*keys).distinct().withColumn("year", F.explode(F.sequence(F.lit(start_year).cast("long"), F.lit(end_year).cast("long"))))
    return spine.join(n, [*keys, "year"], "left").select(*keys, "year", F.coalesce("count", F.lit(0)).alias("count"))
