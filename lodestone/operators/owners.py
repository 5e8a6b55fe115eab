"""Owner names: cleaning, overrides, clusters, and types by the words of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import classify, clustering

OTHER = "other"

# Words of owner names, by kind; entries may be patterns.
LARGE = ["abbott", "abbvie", "amgen", "allergan", "astrazenca", "bayer", "biogen", "boehringer ingelheim", "bristol[ -]?myers squibb", "eli lilly", "lilly", "genentech", "gilead", "glaxo", "glaxo[- ]?smith[- ]?kline", "gsk", "janssen", "merck", "mitsubishi", "novartis", "novo nordisk", "pfizer", "regeneron", "roche", "sanofi", "takeda"]
UNHELPFUL = ["ab", "ag", "as", "a/s", "bv", "b v", "dba", "gmbh", "int", "ind", "intl", "ip", "kg", "kk", "ltda", "nv", "n v", "sa", "s a", "sl", "s l"]
ACRONYMS = [*UNHELPFUL, "co", "corp", "inc", "int", "llc", "llp", "lp", "ltd"]
COMPANY = [
    *ACRONYMS, "adv", "advanced", "agency", "agencies", "associate", "biotechnology", "biotechnologies", "business", "center", "chemical", "coop", "cooperative", "collaboration", "company", "companies", "consumer", "corporation", "dev", "development", "diagnostic", "electronic", "eu", "global", "group", "industries", "industry",
    "innovation", "intellectual", "international", "invest", "investig", "lab", "laboratory", "laboratories", "limited", "ma", "management", "manufacturing", "medicine", "network", "north america", "nutraceutical", "partnership", "pharm", "pharma", "petrochemical", "pharmaceutical", "property", "properties", "services", "system",
    "tech", "techn", "technology", "technologies", "therapeutic", "venture",
]
UNIVERSITY = ["alumni", "college", "education", "inst", "institut", "institute", "nyu", "school", "medicine", "regent", "univ", "university", "universities", "université"]
NON_PROFIT = ["alliance", "council"]
FOUNDATION = ["found", "foundation", "trust"]
HEALTH = ["healthcare", "(?:medical|cancer|health) (?:center|centre|system|hospital)s?", "clinics?", "districts?", "health", "healthcare", "hospital"]
COMMON = [*COMPANY, *UNIVERSITY, *NON_PROFIT, *FOUNDATION, *HEALTH, "animal", "center", "centre", "care", "department", "fund", "human", "medical", "publique", "res", "research", "science", "and", "&"]
INDIVIDUAL = ["m.d.", "md", "d.r.", "dr", "ph.d.", "phd"]
GOVERNMENT = ["city", "government", "govt", "gov", "federal", "national", "governing", "commonwealth", "state", "us health", "veterans affairs", "nih", "nat", "va", "commissariat", "nasa", "prefecture", "european organisation", "eortc", "assistance publique", "fda", "bureau", "authority", "authorities"]
TYPE_WORDS = {"UNIVERSITY": UNIVERSITY, "INDUSTRY_LARGE": LARGE, "INDUSTRY": COMPANY, "GOVERNMENTAL": GOVERNMENT, "HEALTH_SYSTEM": HEALTH, "FOUNDATION": FOUNDATION, "NON_PROFIT": ["research network", "research cent(?:er|re)s?", *NON_PROFIT], "INDIVIDUAL": INDIVIDUAL}
# Whole owners that a name stands for, first match first; keys may be patterns.
OVERRIDES = {
    "genzyme": "sanofi", "smithkline beecham": "glaxosmithkline", "celgene": "bristol-myers squibb", "aventis": "sanofi", "monsanto": "bayer", "covidien": "medtronic", "pharmacia": "pfizer", "shire": "takeda", "actelion": "johnson & johnson", "forest laboratory": "abbvie", "hospira": "pfizer", "sigma[- ]?aldrich": "merck", "immunex": "amgen",
    "medimmune": "astrazeneca", "serono": "merck", "kite pharma": "gilead", "bioverativ": "sanofi", "onyx": "amgen", "allergan": "abbvie", "wyeth": "pfizer", "genentech": "roche",
    "abbott": "abbott", "abbvie": "abbvie", "amgen": "amgen", "bayer": "bayer", "boehringer ingelheim": "boehringer ingelheim", "california inst of techn": "caltech", "du pont": "dupont", "massachusetts inst technology": "massachusetts institute of technology", "roche": "roche", "biogen": "biogen", "boston scient": "boston scientific",
    "boston scimed": "boston scientific", "lilly co eli": "eli lilly", "lilly": "eli lilly", "glaxo": "glaxosmithkline", "glaxosmithkline": "glaxosmithkline", "merck": "merck", "sinai": "mount sinai", "medtronic": "medtronic", "kettering": "sloan kettering", "sanofis?": "sanofi", "basf": "basf", "exxonmobil": "exxonmobil", "3m": "3m",
    "matsushita": "matsushita", "medical res council": "medical research council", "mayo": "mayo clinic", "unilever": "unilever", "general electric": "general electric", "gen eletric": "general electric", "ge healthcare": "general electric", "lg": "lg", "nat cancer ct": "national cancer center", "samsung": "samsung", "verily": "verily",
    "isis": "isis", "broad": "broad institute", "childrens medical center": "childrens medical center", "us gov": "us government", "us health": "us government", "us agriculture": "us government", "united states government": "us government", "koninkl philips": "philips", "koninklijke philips": "philips", "max planck": "max planck",
    "novartis": "novartis", "pfizer": "pfizer", "gilead": "gilead", "dow": "dow inc", "procter .{1,4} gamble": "procter and gamble", "regeneron": "regeneron", "takeda": "takeda", "jnj": "johnson & johnson", "johnson & johnson": "johnson & johnson", "janssen": "johnson & johnson", "johns? hopkins?": "johns hopkins", "mitsubishi": "mitsubishi",
    "dana[- ]?farber": "dana farber", "novo nordisk": "novo nordisk", "astrazeneca": "astrazeneca", "alexion": "astrazeneca", "bristol[- ]?myers squibb": "bristol-myers squibb", "ucb": "ucb", "syngenta": "syngenta", "teva": "teva", "uop": "honeywell", "kimberly clark": "kimberly clark", "dainippon": "dainippon", "scimed life": "scimed life",
    "fujifilm": "fujifilm", "olympus": "olympus", "sumitomo": "sumitomo", "siemens": "siemens", "national cancer institute": "national cancer institute", "nci": "national cancer institute", "centre nat rech scient": "centre national de la recherche scientifique", "cnrs": "centre national de la recherche scientifique", "harvard": "harvard",
    "u.s. army": "us army", "united states army": "us army", "us dept veterans affairs": "us veterans affairs", "sun pharmaceutical": "sun pharmaceutical", "sun pharma": "sun pharmaceutical", "sun chemical": "sun chemical", "advanced cardiovascular system": "advanced cardiovascular systems", "va office": "veterans affairs",
    "nyu": "new york university", "national institutes of health": "national institutes of health", "nih": "national institutes of health", "walter reed": "walter reed", "oxford university": "oxford university", "gore enterprise holdings inc": "gore", "rice university": "rice university",
}
# Spellings of words in owner names, applied in this order.
SPELLINGS = {
    "labs?": "laboratory", "laboratories": "laboratory", "univ": "university", "inst": "institute", "govt?": "government", "nat": "national", "u[ .]?s[ .]?(?:a[.]?)?": "united states", "corporation": "corp", "chem": "chemical", "hosp": "hospital", "limited": "ltd", "instr": "instrument", "incorporated": "inc", "company": "co",
    "dept?": "department", "depart[a-z]*": "department", "(?:bio)?pharm[a-z]*": "pharmaceutical", "r[ ]?(?:&|and)[ ]?d": "research and development", "res": "research", "dev": "development", "eng": "engineering", "biotech": "biotechnology", "bio[- ]*tech(?:nology)?": "biotechnology", "bio[- ]*pharmaceuticals?": "biopharmaceutical",
    "biotechnologies": "biotechnology", "techn?": "technology", "hldgs?": "holdings", "grp": "group", "serv": "services", "found": "foundation", "mfg": "manufacturing", "scienc": "science", "scient": "scientific",
}
#: Words and share classes that say nothing of an owner.
SUPPRESSED = [*UNHELPFUL, "internat[a-z]*", r"(?:class [a-z]? )?(?:(?:[0-9](?:\.[0-9]*)% )?(?:convertible |american )?(?:common|ordinary|preferred|voting|deposit[ao]ry) (?:stock|share|sh)s?|warrants?).*"]


def cleaned_name(name: Column) -> Column:
    """Suppressed words, a leading article and what is in parentheses off; words in their usual spelling; no dots; lower case."""
    words = "|".join(rf"\b(?:{w})s?\b" for w in SUPPRESSED)
    out = F.regexp_replace(name, rf"(?i)(?:{words})*(?:^the\b|\(.+\))?", "")
    out = F.regexp_replace(out, r"^[&., )(]+|[&., )(]+$", "")
    for pattern, spelling in SPELLINGS.items():
        out = F.trim(F.regexp_replace(out, rf"(?i)\b(?:{pattern})\b", f" {spelling} "))
    return F.lower(text.squeeze(F.regexp_replace(out, "[.,]+", "")))


def override(name: Column) -> Column:
    """What the first key of OVERRIDES that the name contains as words stands for; null where there is none."""
    return F.coalesce(*[F.when(name.rlike(rf"(?i)\b(?:{key})\b"), F.lit(owner)) for key, owner in OVERRIDES.items()])


def canonical_owners(names: DataFrame, *, overrides: bool = True, cluster: bool = True) -> DataFrame:
    """(name, cleaned, canonical) of ``names`` (name, count).

    The override of the name or its cleaned form, else the commonest member of the cleaned form's cluster, else ``other``;
    without ``cluster`` the cleaned form itself.
    """
    rows = names.select("name", "count", cleaned_name(F.col("name")).alias("cleaned"))
    known = F.coalesce(override(F.col("name")), override(F.col("cleaned"))) if overrides else F.lit(None).cast("string")
    if not cluster:
        return rows.select("name", "cleaned", F.coalesce(known, F.nullif("cleaned", F.lit("")), F.lit(OTHER)).alias("canonical"))
    common = sorted({w + s for w in COMMON for s in ("", "s")})
    groups = clustering.term_clusters(rows.filter("cleaned <> ''").groupBy(F.col("cleaned").alias("term")).agg(F.sum("count").alias("count")), common=common, other=OTHER)
    joined = rows.join(groups.select(F.col("term").alias("cleaned"), F.col("canonical").alias("_c")), "cleaned", "left")
    return joined.select("name", "cleaned", F.coalesce(known, "_c", F.lit(OTHER)).alias("canonical"))


def owner_types(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id, owner_type): of the classes of a name's words, the one with the least rank."""
    classes = classify.keyword_classes(df, id_col, name_col, TYPE_WORDS, "OTHER", depluralised=True)
    rank = F.create_map(*[F.lit(v) for pair in classify.OWNER_PRIORITY.items() for v in pair])
    best = F.array_min(F.transform("classes", lambda c: F.struct(F.element_at(rank, c).alias("r"), c.alias("c"))))
    return classes.select(id_col, F.when(F.array_contains("classes", OTHER), "OTHER").otherwise(best["c"]).alias("owner_type"))
