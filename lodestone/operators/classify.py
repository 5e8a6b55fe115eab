"""Rules: keyword classes, trial attributes, time frames, owner types."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Fixed values of trial records.
DESIGNS = {"Parallel Assignment": "PARALLEL", "Crossover Assignment": "CROSSOVER", "Factorial Assignment": "FACTORIAL", "Sequential Assignment": "SEQUENTIAL", "Single Group Assignment": "SINGLE_GROUP", "": "NA"}
RANDOMIZATIONS = {"Randomized": "RANDOMIZED", "Non-Randomized": "NON_RANDOMIZED", "N/A": "NA"}
MASKINGS = {"None (Open Label)": "NONE", "Single": "SINGLE", "Double": "DOUBLE", "Triple": "TRIPLE", "Quadruple": "QUADRUPLE"}
PURPOSES = {"Treatment": "TREATMENT", "Prevention": "PREVENTION", "Diagnostic": "DIAGNOSTIC", "Basic Science": "BASIC_SCIENCE", "Supportive Care": "SUPPORTIVE_CARE", "Device Feasibility": "DEVICE", "Educational/Counseling/Training": "OTHER", "Health Services Research": "OTHER", "Screening": "OTHER"}
STATUSES = {"Active, not recruiting": "PRE_ENROLLMENT", "Not yet recruiting": "PRE_ENROLLMENT", "Recruiting": "ENROLLMENT", "Enrolling by invitation": "ENROLLMENT", "Withdrawn": "WITHDRAWN", "Suspended": "SUSPENDED", "Terminated": "TERMINATED", "Completed": "COMPLETED", "Not Applicable": "NA"}
STATUS_GROUPS = {"PRE_ENROLLMENT": "ONGOING", "ENROLLMENT": "ONGOING", "WITHDRAWN": "STOPPED", "SUSPENDED": "STOPPED", "TERMINATED": "STOPPED", "COMPLETED": "COMPLETED"}
PHASES = {"Early Phase 1": "EARLY_PHASE_1", "Phase 1": "PHASE_1", "Phase 1/Phase 2": "PHASE_1_2", "Phase 2": "PHASE_2", "Phase 2/Phase 3": "PHASE_2_3", "Phase 3": "PHASE_3", "Phase 4": "PHASE_4", "Not Applicable": "NA", "Approved": "APPROVED"}
INTERVENTIONS = {"Behavioral": "BEHAVIORAL", "Biological": "PHARMACOLOGICAL", "Combination Product": "COMBINATION", "Device": "DEVICE", "Diagnostic Test": "DIAGNOSTIC", "Dietary Supplement": "DIETARY", "Drug": "PHARMACOLOGICAL", "Genetic": "PHARMACOLOGICAL", "Other": "OTHER", "Procedure": "PROCEDURE", "Radiation": "PROCEDURE"}
INTERVENTION_PRIORITY = ("PHARMACOLOGICAL", "DEVICE", "BEHAVIORAL", "DIAGNOSTIC", "PROCEDURE", "DIETARY")
HYPOTHESES = {"Superiority": "SUPERIORITY", "Superiority or Other": "SUPERIORITY", "Superiority or Other (legacy)": "SUPERIORITY", "Non-Inferiority": "NON_INFERIORITY", "Equivalence": "EQUIVALENCE", "Non-Inferiority or Equivalence": "NON_SUPERIORITY", "Non-Inferiority or Equivalence (legacy)": "NON_SUPERIORITY", "Other": "OTHER"}
DOSE_TERMS = ["dose", "doses", "dosing", "dosage", "dosages", "mad", "sad", "pharmacokinetic", "pharmacokinetics", "pharmacodynamics", "titration", "titrating"]
CONTROL_TERMS = ["placebo", "sham", "best supportive care", "standard", "usual care", "treatment as usual", "care as usual", "sugar pill", "routine", "comparator", "best practice", "no treatment", "saline solution", "conventional", "aspirin", "control", "tablet dosage form", "laboratory biomarker analysis", "drug vehicle", "pharmacological study", "normal saline", "therapeutic procedure", "quality.?of.?life", "questionnaire"]
OWNER_PRIORITY = {"INDUSTRY_LARGE": 1, "HEALTH_SYSTEM": 5, "INDIVIDUAL": 7, "UNIVERSITY": 10, "GOVERNMENTAL": 20, "FOUNDATION": 30, "NON_PROFIT": 40, "INDUSTRY": 50, "OTHER_ORGANIZATION": 100, "OTHER": 1000}
OWNER_WORDS = {
    "UNIVERSITY": ["university", "universitat", "univ", "college", "school", "institute of technology"],
    "INDUSTRY": ["inc", "ltd", "llc", "corp", "gmbh", "pharmaceuticals", "pharma", "biotech", "therapeutics", "laboratories", "company"],
    "GOVERNMENTAL": ["government", "ministry", "department", "federal", "national institute", "veterans"],
    "HEALTH_SYSTEM": ["hospital", "clinic", "medical center", "health system", "cancer center"],
    "FOUNDATION": ["foundation", "trust", "charity"],
    "NON_PROFIT": ["research network", "research center", "society", "association", "council"],
    "INDIVIDUAL": ["dr", "md", "phd"],
}
#: Days of a unit, its spellings, and number words.
UNIT_DAYS = {"second": 1 / 86400, "minute": 1 / 1440, "hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}
UNIT_FORMS = {"second": "seconds?|secs?|s", "minute": "minutes?|mins?", "hour": "hours?|hrs?|hs?", "day": "days?|ds?", "week": "weeks?|wks?|ws?", "month": "months?|mons?|mths?", "year": "years?|yrs?|ys?"}
NUMBER_WORDS = {"first": 1, "one": 1, "second": 2, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}


def mapped(column: Column, values: dict[str, str], otherwise: str = "UNKNOWN") -> Column:
    table = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(otherwise))


def keyword_classes(df: DataFrame, id_col: str, text_col: str, keywords: dict[str, Iterable[str]], otherwise: str, *, strict: bool = False, longest: int = 3, depluralised: bool = False) -> DataFrame:
    """(id, classes): sorted classes of a text's word 1- to 3-grams, [otherwise] where there is none.

    ``strict`` adds ``otherwise`` wherever some n-gram has no class, as well.  ``depluralised`` lets a keyword also stand for its
    plural.  Keywords are compared as words, without the signs between them; one that is in several classes has them all.  The
    keyword table is a plan constant.
    """
    spellings = {(" ".join(re.findall(r"[^\W_]+", form)), kind) for kind, words in keywords.items() for word in words for form in text.expand_pattern(word.lower())}
    if depluralised:
        spellings |= {(term + "s", kind) for term, kind in spellings}
    spark = df.sparkSession
    lookup = F.broadcast(spark.createDataFrame(sorted(spellings), "term string, class string"))
    grams = df.select(F.col(id_col).alias("_id"), F.explode_outer(text.all_ngrams(text.tokens(F.coalesce(F.col(text_col), F.lit(""))), longest)).alias("term"))
    hit = grams.join(lookup, "term", "left").withColumn("class", F.coalesce("class", F.lit(otherwise)) if strict else F.col("class"))
    found = hit.groupBy("_id").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return found.select(F.col("_id").alias(id_col), F.when(F.size("classes") > 0, F.col("classes")).otherwise(F.array(F.lit(otherwise))).alias("classes"))


def is_blinded(masking: Column) -> Column:
    return ~masking.isin("NONE", "UNKNOWN")


def trial_design(design: Column, title: Column, phase: Column, randomization: Column, masking: Column, comparison: Column, arms: Column) -> Column:
    """A phase-1 trial that speaks of doses is DOSING; a single group with a sign of a second one is PARALLEL."""
    dosing = phase.isin("EARLY_PHASE_1", "PHASE_1", "PHASE_1_2") & F.arrays_overlap(F.split(F.lower(title), "[ -]"), F.array(*map(F.lit, DOSE_TERMS)))
    given = mapped(design, DESIGNS)
    several = ~comparison.isin("UNKNOWN", "NO_CONTROL") | (F.coalesce(arms, F.lit(0)) > 1) | is_blinded(masking) | (randomization == "RANDOMIZED")
    return F.when(F.coalesce(dosing, F.lit(False)), "DOSING").when((given == "SINGLE_GROUP") & several, "PARALLEL").otherwise(given)


def intervention_type(types: Column) -> Column:
    """The first of INTERVENTION_PRIORITY among the types, else the first type, else UNKNOWN."""
    found = F.transform(types, lambda t: mapped(t, INTERVENTIONS, "OTHER"))
    out = F
    for kind in INTERVENTION_PRIORITY:
        out = out.when(F.array_contains(found, kind), kind)
    return out.otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit("UNKNOWN")))


def hypothesis_type(values: Column) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, "UNKNOWN").when(F.size(values) == 1, mapped(F.get(values, F.lit(0)), HYPOTHESES, "OTHER")).otherwise("MULTIPLE")


def comparison_type(arm_types: Column, interventions: Column, intervention_names: Column) -> Column:
    """By arm types first, then by names: placebo, active, dose, no treatment, no control."""
    any_arm = lambda word: F.exists(arm_types, lambda a: F.lower(a).contains(word))
    any_name = lambda words: F.exists(intervention_names, lambda n: n.rlike(text.or_pattern(words)))
    return (
        F.when(any_arm("placebo") | any_arm("sham") | any_name(["placebo", "sham", "sugar pill"]), "PLACEBO")
        .when(any_arm("active comparator") & any_name(DOSE_TERMS), "DOSE")
        .when(any_arm("active comparator"), "ACTIVE")
        .when(any_arm("no intervention") | any_name(["no treatment"]), "NO_INTERVENTION")
        .when(F.exists(intervention_names, lambda n: n.rlike(r"(?i)\b(?:" + "|".join(CONTROL_TERMS) + r")\b")), "STANDARD")
        .when(F.size(F.array_distinct(interventions)) == 1, "NO_CONTROL")
        .otherwise("UNKNOWN")
    )


def timeframe_days(description: Column) -> Column:
    """The longest time that a description names, in days, halves to the even number; null where there is none.

    Number then unit ("26-weeks", "one year"), or unit then numbers ("Day 15, 29 and 43").  A fraction counts as two
    numbers.
    """
    units = "|".join(f"(?:{f})" for f in UNIT_FORMS.values())
    number = r"(?:\d+|\b(?:" + "|".join(NUMBER_WORDS) + r")\b)"
    low = F.lower(description)
    before = F.regexp_extract_all(low, F.lit(rf"({number}[ -]?(?:{units})(?![a-z]))"), 1)
    after = F.regexp_extract_all(low, F.lit(rf"(\b(?:{units})[ -]?{number}(?:(?:[-, ±]| to | and )+{number})*)"), 1)

    def days(candidate: Column) -> Column:
        bare = F.regexp_replace(candidate, number, " ")
        unit = F.coalesce(*[F.when(bare.rlike(rf"\b(?:{f})\b"), F.lit(UNIT_DAYS[u])) for u, f in UNIT_FORMS.items()])
        words = F.create_map(*[F.lit(v) for k, n in NUMBER_WORDS.items() for v in (k, float(n))])
        numbers = F.transform(F.regexp_extract_all(candidate, F.lit(f"({number})"), 1), lambda n: F.coalesce(n.try_cast("double"), F.try_element_at(words, n)))
        return F.bround(F.array_max(numbers) * unit, 0)

    return F.array_max(F.filter(F.transform(F.concat(before, after), days), lambda d: d.isNotNull())).cast("long")


def owner_type(df: DataFrame, id_col: str, name_col: str, large: list[str] = ()) -> DataFrame:
    """(id, owner_type): of the classes of a name's words, the one with the least rank."""
    classes = keyword_classes(df, id_col, name_col, OWNER_WORDS | {"INDUSTRY_LARGE": large}, "OTHER")
    rank = F.create_map(*[F.lit(v) for pair in OWNER_PRIORITY.items() for v in pair])
    best = F.array_min(F.transform("classes", lambda c: F.struct(F.element_at(rank, c).alias("r"), c.alias("c"))))
    return classes.select(id_col, best["c"].alias("owner_type"))


def first_known_type(types: Column, known: dict[str, str], preferred: list[str]) -> Column:
    """The entity type of the first preferred semantic type, else of the first known one, else UNKNOWN."""
    wanted = F.filter(types, lambda t: t.isin(preferred))
    any_known = F.filter(types, lambda t: t.isin(list(known)))
    return mapped(F.coalesce(F.get(wanted, F.lit(0)), F.get(any_known, F.lit(0)), F.lit("")), known)
