"""Finding companies by their documents' relevance to a vector, with scores that favour recent work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, vectors

#: The latest year with data, and the power by which age counts.
MAX_YEAR, DECAY = 2024, 2


def top_docs(docs: DataFrame, vector: str, query: list[float], k: int, threshold: float | None = None, *, family: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, similarity, ...) of the k nearest, one per family: the largest id of it, with the family's mean similarity.

    A document without a family is a family of its own.
    """
    near = vectors.nearest(docs, vector, query, k, id_col, threshold)
    if family is None:
        return near
    key = F.coalesce(F.concat(F.lit("f"), F.col(family).cast("string")), F.concat(F.lit("d"), F.col(id_col).cast("string")))
    return near.groupBy(key.alias("family")).agg(F.max(id_col).alias(id_col), F.avg("similarity").alias("similarity"), F.min("doc_date").alias("doc_date"), F.count(F.lit(1)).alias("family_size"))


def unpivoted(wide: DataFrame, types: list[str], keep: list[str]) -> DataFrame:
    """(doc_type, doc_id, keep...) of a map with one id column per document type; equi-joins replace an OR over columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("doc_type"), F.col(f"{t}_id").alias("doc_id")) for t in types]))
    return wide.select(*keep, pairs.alias("_p")).select(*keep, "_p.*").filter("doc_id IS NOT NULL")


def recency_score(relevance: Column, year: Column, start_year: int) -> Column:
    """Relevance times the square of how far into the period the year is; nothing before the period."""
    return relevance * F.pow(F.greatest(F.lit(0.0), (year - start_year) / F.lit(float(MAX_YEAR - start_year))), F.lit(float(DECAY)))


def company_metrics(relevant: DataFrame, owners: DataFrame, acquisitions: DataFrame, start_year: int) -> DataFrame:
    """Per owner: document count, ages, relevance and recency score, whether it acquires or competes.

    ``relevant``: owner_id, doc_id, similarity, doc_date.  Owners without acquisitions have none.
    """
    age = F.lit(MAX_YEAR) - dates.year_of(F.col("doc_date"))
    decimal = lambda c: c.cast("decimal(38,12)")
    by_owner = relevant.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(age).alias("min_age"),
        F.round(F.avg(age), 2).alias("avg_age"),
        F.round(F.sum(decimal(F.col("similarity"))).cast("double") / F.count(F.lit(1)), 4).alias("relevance"),
        F.round(F.sum(decimal(recency_score(F.col("similarity"), dates.year_of(F.col("doc_date")), start_year))).cast("double"), 4).alias("score"),
    )
    bought = acquisitions.groupBy("owner_id").agg(F.sum("count").alias("acquisition_count"))
    return by_owner.join(owners, "owner_id").join(bought, "owner_id", "left").select(
        "owner_id", "name", "count", "min_age", "avg_age", "relevance", "score",
        F.coalesce("acquisition_count", F.lit(0)).cast("long").alias("acquisition_count"),
        (F.coalesce("acquisition_count", F.lit(0)) > 0).alias("is_acquirer"),
        F.col("owner_type").isin("INDUSTRY", "INDUSTRY_LARGE").alias("is_competition"),
    )


def exit_scores(companies: DataFrame) -> DataFrame:
    """Shares of the total score that acquirers and competitors hold; 0 where there is no score."""
    total = F.sum(F.col("score").cast("decimal(38,4)")).cast("double")
    part = lambda flag: F.sum(F.when(F.col(flag), F.col("score").cast("decimal(38,4)"))).cast("double")
    share = lambda flag: F.round(F.coalesce(F.when(total > 0, F.coalesce(part(flag), F.lit(0.0)) / total), F.lit(0.0)), 4)
    return companies.agg(share("is_acquirer").alias("exit_score"), share("is_competition").alias("competition_score"))


def is_troubled(financials: DataFrame) -> Column:
    """Below cash, current ratio under 1, debt to equity over 1.5 or return on equity under 0.15; nulls say no."""
    no = F.lit(False)
    tests = (F.col("market_cap") < -F.col("net_debt"), F.col("current_ratio") < 1, F.col("debt_equity_ratio") > 1.5, F.col("return_on_equity") < 0.15)
    out = no
    for t in tests:
        out = out | F.coalesce(t, no)
    return out


def ratios(statements: DataFrame) -> DataFrame:
    """Adds return on equity, current ratio, net debt and debt to equity; null where the divisor is 0 or null."""
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return (
        statements.withColumn("return_on_equity", over("net_income", "equity"))
        .withColumn("current_ratio", over("current_assets", "current_liabilities"))
        .withColumn("net_debt", F.col("total_debt") - F.col("cash"))
        .withColumn("debt_equity_ratio", over("total_debt", "equity"))
    )
