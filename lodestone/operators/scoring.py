"""Patent scores: suitability by attributes, years left, availability by the assignees' state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

# Weight of each attribute.
SUITABILITY = {
    "CAM": -3, "COMBINATION": -1, "COMPOUND_OR_MECHANISM": 3, "DEVICE": -3, "DIAGNOSTIC": -2, "DISEASE_MODIFYING": 1.5,
    "FORMULATION": -1, "GERIATRIC": 0, "IRRELEVANT": -5, "METHOD": -1, "METHOD_OF_ADMINISTRATION": -1, "NOVEL": 1.5,
    "NUTRITIONAL": -4, "OBSTETRIC": 0, "PALLIATIVE": 0, "PEDIATRIC": 0, "PLATFORM": 0, "PREVENTATIVE": 0, "PROCEDURE": -3,
    "PROCESS": -2, "TREATMENT": 1,
}
AVAILABILITY = {"LIKELY": 0.25, "POSSIBLE": 0.15, "UNLIKELY": -0.5, "UNKNOWN": 0.0}


def _weights() -> Column:
    return F.create_map(*[F.lit(v) for pair in SUITABILITY.items() for v in (pair[0], float(pair[1]))])


def suitability(attributes: Column) -> Column:
    """0 if the weights' sum is negative, else where it lies between the least and the largest possible sum."""
    low, high = sum(v for v in SUITABILITY.values() if v < 0), sum(v for v in SUITABILITY.values() if v > 0)
    found = F.transform(attributes, lambda a: F.coalesce(F.try_element_at(_weights(), F.upper(a)), F.lit(0.0)))
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    return F.when(total < 0, 0.0).otherwise((total - low) / (high - low))


def explanation(attributes: Column) -> Column:
    """"ATTRIBUTE: weight" of the known attributes, joined by commas."""
    known = F.filter(F.transform(attributes, F.upper), lambda a: F.map_contains_key(_weights(), a))
    return F.array_join(F.transform(known, lambda a: F.concat(a, F.lit(": "), F.regexp_replace(F.element_at(_weights(), a).cast("string"), r"\.0$", ""))), ", ")


def availability(assignees: Column, troubled: Column) -> Column:
    """POSSIBLE if any assignee is among the troubled ones, else UNKNOWN."""
    return F.when(F.arrays_overlap(assignees, troubled), "POSSIBLE").otherwise("UNKNOWN")


def scored(patents: DataFrame, as_of_year: int, attributes: str = "attributes", date: str = "doc_date", available: str = "availability") -> DataFrame:
    """Adds patent_years, suitability_score with explanation, availability_score and score."""
    points = F.coalesce(*[F.when(F.col(available) == k, F.lit(v)) for k, v in AVAILABILITY.items()], F.lit(0.0))
    out = patents.withColumn("patent_years", dates.patent_years(F.col(date), as_of_year).cast("long")).withColumn("suitability_score", suitability(F.col(attributes)))
    out = out.withColumn("suitability_score_explanation", explanation(F.col(attributes))).withColumn("availability_score", points)
    return out.withColumn("score", F.col("suitability_score") * F.col("patent_years") / dates.PATENT_LIFE + F.col("availability_score"))


def world_patents(similar: Column) -> Column:
    """Of similar patents those with a WO number."""
    return F.filter(similar, lambda p: p.startswith("WO"))
