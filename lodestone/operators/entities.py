"""Entity records: about twenty metrics at two grains of rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

# The order of phases, groups of trial states, level thresholds.
PHASE_RANK = {"PRECLINICAL": 0, "EARLY_PHASE_1": 1, "PHASE_1": 1, "PHASE_1_2": 2, "PHASE_2": 2, "PHASE_2_3": 3, "PHASE_3": 3, "APPROVED": 4}
STOPPED = ("WITHDRAWN", "SUSPENDED", "TERMINATED")
INVESTMENT_LEVELS = ((5000, "VERY HIGH"), (1000, "HIGH"), (500, "MEDIUM"))
TRACTION_LEVELS = ((1000, "VERY HIGH"), (500, "HIGH"), (100, "MEDIUM"))


def level_of(value: Column, ladder: tuple, lowest: str = "LOW") -> Column:
    out = F
    for above, name in ladder:
        out = out.when(value > above, name)
    return out.otherwise(lowest)


def dropout_ratio(dropouts: Column, enrolled: Column) -> Column:
    """Dropouts over enrolled, of trials with enrollment above zero and fewer dropouts than it; 0 if none is eligible."""
    fine = (enrolled > 0) & (dropouts < enrolled)
    return F.coalesce(F.sum(F.when(fine, dropouts)) / F.sum(F.when(fine, enrolled)), F.lit(0.0))


def rounded_mean(value: Column) -> Column:
    """The mean, halves to the even number; 0 where all are null."""
    return F.coalesce(F.bround(F.avg(value), 0).cast("long"), F.lit(0))


def share_of(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def top_values(df: DataFrame, keys: list[str], value: str, n: int = 10) -> DataFrame:
    """(keys, value, count) of each key's n commonest values, ties by value."""
    found = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("count").desc(), value))
    return found.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def summary(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity: counts by document type, newest documents, investment and their levels.

    ``mentions``: doc_id, doc_type, doc_date, investment and the key columns; a document counts once per entity.
    """
    once = mentions.select(*keys, "doc_id", "doc_type", "doc_date", "investment").distinct()
    kind = lambda t: F.col("doc_type") == t
    n = lambda t: F.sum(kind(t).cast("int")).cast("long")
    money = F.sum(F.col("investment").cast("decimal(20,4)"))
    newest = lambda t: F.max_by(F.when(kind(t), F.col("doc_id")), F.when(kind(t), F.struct("doc_date", "doc_id")))
    out = once.groupBy(*keys).agg(
        n("patent").alias("patent_count"),
        n("trial").alias("trial_count"),
        n("regulatory_approval").alias("regulatory_approval_count"),
        F.count(F.lit(1)).alias("record_count"),
        F.max(F.when(kind("patent"), F.col("doc_date"))).alias("last_patent_date"),
        newest("trial").alias("most_recent_trial"),
        money.cast("double").alias("investment"),
    )
    return out.withColumn("is_approved", F.col("regulatory_approval_count") > 0).withColumn("investment_level", level_of(F.col("investment"), INVESTMENT_LEVELS))


def two_level(mentions: DataFrame, parent: str = "category_rollup", child: str = "instance_rollup", limit: int = 2000) -> DataFrame:
    """(parent, record_count, children): each rollup's documents and, nested, those of its children by count."""
    once = mentions.select(parent, child, "doc_id").distinct()
    kids = once.groupBy(parent, child).agg(F.countDistinct("doc_id").alias("n"))
    nested = kids.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), F.col(child).alias("name"), F.col("n").alias("count")))).alias("_c"))
    whole = once.groupBy(parent).agg(F.countDistinct("doc_id").alias("record_count"))
    out = whole.join(nested, parent).select(parent, "record_count", F.transform("_c", lambda c: F.struct(c["name"].alias("name"), c["count"].alias("count"))).alias("children"))
    return out.orderBy(F.col("record_count").desc(), parent).limit(limit)


def max_phase(phase: Column, approvals: Column, trials: Column) -> Column:
    """APPROVED with any approval, PRECLINICAL without trials, else the highest phase by rank."""
    ranked = F.struct(F.coalesce(*[F.when(phase == p, F.lit(r)) for p, r in PHASE_RANK.items()], F.lit(-1)).alias("r"), phase.alias("p"))
    return F.when(F.max(approvals) > 0, "APPROVED").when(F.max(trials) == 0, "PRECLINICAL").otherwise(F.max(ranked)["p"])


def activity(docs: DataFrame, keys: list[str], start_year: int, end_year: int, by_type: bool = False) -> DataFrame:
    """(keys, year[, by type], count) per calendar year, zeros included."""
    year = dates.year_of(F.col("doc_date"))
    kinds = ("patent", "trial", "regulatory_approval")
    inside = docs.withColumn("year", year).filter(F.col("year").between(start_year, end_year))
    extra = [F.sum((F.col("doc_type") == k).cast("int")).cast("long").alias(k) for k in kinds] if by_type else []
    n = inside.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("count"), *extra)
    spine = docs.select(*keys).distinct().withColumn("year", F.explode(F.sequence(F.lit(start_year).cast("long"), F.lit(end_year).cast("long"))))
    filled = ["count", *(kinds if by_type else [])]
    return spine.join(n, [*keys, "year"], "left").select(*keys, "year", *[F.coalesce(c, F.lit(0)).alias(c) for c in filled])


def active_years(trials: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(year, count): trials under way, a trial counting from its start's year up to, not including, its end's."""
    first, last = dates.year_of(F.col(start)), dates.year_of(F.col(end)) - 1
    return trials.select(F.explode(dates.year_spine(first, last)).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("count"))
