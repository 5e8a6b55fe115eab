"""Rules on records and terms: reasons why trials end or subjects leave, concepts that are left out, terms cleaned step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Words of a trial's termination, by reason; entries may be patterns.
TERMINATION = {
    "FUTILITY": ["futility", "endpoints?", "lower success rates?", "interim analysis", "lack of effectiveness", "lack of efficacy", "rate of relapse", "lack of response", "lack of performance", "inadequate effect", "no survival benefit", "stopping rule"],
    "SAFETY": ["toxicity", "adverse", "risk/benefit", "detrimental effect", "S?AEs?", "mortality", "unacceptable morbidity", "side effects?", "lost to follow up"],
    "BUSINESS": ["business", "company", "strategic", "sponsor(?:'s)? decision", "management", "stakeholders?", "(?:re)?prioritization"],
    "ENROLLMENT": ["accruals?", "enroll?(?:ment|ed)?", "inclusions?", "recruit(?:ment|ing)?s?", "lack of (?:eligibile )?(?:participants?|subjects?|patients?)"],
    "INVESTIGATOR": ["investigator", "PI"],
    "FUNDING": ["funding", "resources", "budget", "financial"],
    "COVID": ["covid", "coronavirus", "pandemic"],
    "OVERSIGHT": ["IRB", "ethics", "Institutional Review Board", "certification", "FDA"],
    "SUPPLY_CHAIN": ["supply", "unavalaible", "shortage", "manufacturing"],
    "PROTOCOL_REVISION": ["revision", "change in (?:study )?protocol"],
    "FEASIBILITY": ["feasibility"],
    "NOT_SAFETY": ["not a safety issue", "not related to safety", "no safety or efficacy concerns", "no safety concern"],
    "NOT_FUTILITY": ["not related to efficacy", "no safety or efficacy concerns"],
    "LOGISTICS": ["logistics", "logistical"],
}
# Words of a subject's leaving, by reason.
DROPOUT = {
    "ADVERSE_EVENT": ["ae", "sae", "safety", "adverse", "toxicity", "abnormal laboratory", "laboratory abnormality", "hyperglycemia", "dlt"],
    "COMPLIANCE": ["compliance", "noncompliance", "excluded medication", "prohibited", "positive drug screen"],
    "MILD_ADVERSE_EVENT": ["discomfort", "mild adverse event"],
    "DEATH": ["death"],
    "INELIGIBLE": ["ineligible", "not treated", "screen failure", "entry criteria", "entrance criteria", "no longer meets", "eligibility", "ineligibility", "inappropriate enrollment", "selection criteria"],
    "EFFICACY": ["efficacy", "unsatisfactory therapeutic effect", "insufficient clinical response", "treatment failure", "virologic failure", "did not achieve", "non-responder"],
    "INVESTIGATOR": ["investigator", "sponsor"],
    "LOGISTICS": ["administrative problems", "administrative", "technical", "site closed", "logistical"],
    "LOST_TO_FOLLOWUP": ["lost to follow up", "missing", "missed", "failure to return"],
    "OTHER": ["miscellaneous", "other", "not specified", "not reported", "unclassified", "unable to classify"],
    "PHYSICIAN": ["physician", "alternative treatment"],
    "PREGNANCY": ["pregnancy"],
    "PROGRESSION": ["progression", "progressive", "deterioration", "relapse", "condition under investigation worsened", "debilitation", "graft loss", "hospitalization", "invasive intervention"],
    "PROTOCOL_VIOLATION": ["protocol violation", "protocol deviation"],
    "PER_PROTOCOL": ["stopping criteria", "withdrawal criteria", "early termination", "per protocol"],
    "SUBJECT": ["subject", "consent", "no longer willing", "voluntary", "moved", "parent", "personal", "relocation", "refused", "participant request", "incarcerated", "travel", "caregiver", "family emergency", "inconvenience"],
    "TERMINATION": ["termination", "terminated", "site closure"],
}
# Words of a concept's name that suppress it.
SUPPRESSED_WORDS = ["rat", "mouse", "categorized", "category", "preparations", "other", "and", "or", "by", "and/or", "miscellaneous", "product", "wt", "mesh", "headings", "schedule", "affecting", "drugs", "various", "unspecified", "physiology"]
# Parts of terms that go, in this order.
SUBSTITUTIONS = {
    r"\n": " ", "/": " ", r"[.,:;'\"]+$": "", r"^[.,:;'\"]+": "", "©": "", "®": "", "™": "", r"\bcompounds?\b": "", r"\bsubstitutes?d?\b": "", r"\bcandidates?\b": "", r"\breceptors?\b": "", r"\bforms?(?:ulations?)?\b": "", r"\bformulae?s?\b": "", r"\bproducts?\b": "", r"\bcapable\b": "", r"\buseful\b": "", r"\bbinding\b": "",
    r"\bselective\b": "", r"\bpresent\b": "", r"\bseparates?d?\b": "", r"\bgroup\b": "", r"\bstabilized\b": "", r"\bchains?\b": "", r"\bsoluble\b": "", r"\bsalt\b": "", r"\bstrands?\b": "", r"\bmatrix?\b": "", r"\btarget(?:ing)?s?\b": "",
}
# Phrases and what is written for them, in this order.
PHRASES = {
    "associated protein": "protein", "associated illness": "associated disease", "biologic(?:al)? response modifiers?": "modulator", "chimeric[ -]?(?:antigen|antibody)[ -]?receptor": "chimeric antigen receptor", "chimeric[ -]?(?:antigen|antibody)[ -]?(?:t[ -]?cell )receptor": "chimeric antigen receptor t-cell",
    "car[ -]t": "chimeric antigen receptor t-cell", "conditions and disease": "diseases", "disease factors": "diseases", "disease states": "diseases", "diseases? and condition": "diseases", "diseases? and disorder": "diseases", "disorders? and disease": "diseases", "expression disorders?": "diseases", "disease state": "diseases",
    "diseases and condition": "diseases", "pathological condition": "diseases", "induced diseases": "diseases", "mediated condition": "associated disease", "mediated disease": "associated disease", "related condition": "associated disease", "related disease": "associated disease", "related illness": "associated disease",
    "induced condition": "associated disease", "induced illness": "associated disease", "induced disease": "associated disease", "induced by": "associated with", "family member": "family", "family protein": "protein", "formulae": "formula", "g[-]?pcrs?": "gpcr", "non[ -]?steroidal": "nonsteroidal", "re[ -]?uptake": "reuptake",
    "toll[ ]?like": "toll-like", "t cell": "t-cell", "b cell": "b-cell", "([a-z]{1,3}) ([0-9]{1,4})": "$1$2",
}
#: Greek letters, capital and small, their names and the Latin letter for them inside a word.
GREEK = {"Αα": ("alpha", "a"), "βΒ": ("beta", "b"), "γΓ": ("gamma", "g"), "δΔ": ("delta", "d"), "ωΩ": ("omega", "o"), "ηΗ": ("eta", "e"), "κ": ("kappa", "k")}
#: Named characters of markup, the ampersand last.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "omega": "ω", "kappa": "κ", "micro": "µ", "deg": "°", "plusmn": "±", "ndash": "–", "mdash": "—", "rsquo": "’", "lsquo": "‘", "amp": "&"}


def unescaped(value: Column) -> Column:
    """Markup's named characters, and decimal ones below 256, as characters; others stay as they are."""

    def number(part: Column) -> Column:
        code = F.regexp_extract(part, r"^#(\d{1,3});", 1).try_cast("int")
        rest = F.regexp_replace(part, r"^#\d{1,3};", "")
        return F.when(code.between(1, 255), F.concat(F.char(code), rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(value, "&", -1)
    out = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), number), ""))
    for name, sign in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.when(value.contains("&"), out).otherwise(value)


def unparenthesised(value: Column) -> Column:
    """Words in parentheses lose these, between spaces and inside a word."""
    out = F.regexp_replace(value, r"(?i)(?<=[ ,^])\(([a-z0-9, -]+)\)(?=[ ,$])", "$1")
    return F.regexp_replace(out, r"(?i)\(([a-z0-9-]+)\)", "$1")


def rewritten(value: Column) -> Column:
    """Greek letters by their names or Latin ones, then PHRASES, each in turn."""
    out = value
    for letters, (name, latin) in GREEK.items():
        alone = F.regexp_replace(out, rf"(?U)(?<![\w])[{letters}](?![\w])", name)
        out = F.regexp_replace(alone, f"[{letters}]", latin)
    for phrase, words in PHRASES.items():
        out = F.regexp_replace(out, rf"(?i)\b{phrase}s?\b", words)
    return out


def cleaned_term(value: Column, is_chemical: Column | None = None) -> Column:
    """A term in its plain form: markup, first line, outer parentheses, inner ones, substitutions, spaces, dashes, phrases, case.

    A chemical name keeps its parentheses and dashes.
    """
    chemical = F.lit(False) if is_chemical is None else is_chemical
    out = F.regexp_replace(unescaped(value), r"(?s)\n.*$", "")
    out = F.when(out.startswith("(") & out.endswith(")"), F.regexp_replace(out, r"^[()]+|[()]+$", "")).otherwise(out)
    out = F.when(chemical, out).otherwise(unparenthesised(out))
    for pattern, by in SUBSTITUTIONS.items():
        out = F.regexp_replace(out, f"(?i){pattern}", by)
    out = text.squeeze(out)
    out = F.when(chemical, out).otherwise(F.regexp_replace(out, "-", " "))
    return F.lower(text.squeeze(rewritten(out)))


def suppressed(concepts: DataFrame, ids: DataFrame, aliases: DataFrame, bases: DataFrame) -> DataFrame:
    """``concepts`` (id, name, matching_aliases, is_composite) with is_suppressed.

    By its id (``ids``: id), a word of its name in SUPPRESSED_WORDS, an alias that is barred for its id (``aliases``: id, alias),
    or as a base that stands alone (``bases``: id).
    """
    mark = lambda df, name: df.select(F.col("id")).distinct().withColumn(name, F.lit(True))
    barred = aliases.groupBy("id").agg(F.collect_set(F.lower("alias")).alias("_barred"))
    rows = concepts.join(mark(ids, "_by_id"), "id", "left").join(mark(bases, "_base"), "id", "left").join(barred, "id", "left")
    words = F.arrays_overlap(F.split("name", " "), F.array(*map(F.lit, SUPPRESSED_WORDS)))
    alias = F.arrays_overlap(F.transform("matching_aliases", F.lower), "_barred")
    gone = F.col("_by_id") | words | alias | (F.col("_base") & ~F.col("is_composite"))
    return rows.select(*concepts.columns, F.coalesce(gone, F.coalesce(F.col("_by_id"), F.lit(False)) | words | F.coalesce(alias, F.lit(False)) | (F.coalesce(F.col("_base"), F.lit(False)) & ~F.col("is_composite"))).alias("is_suppressed"))
