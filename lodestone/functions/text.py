"""Text as Columns: tokens, lexemes, n-grams, trigrams, cleaning.

The tokeniser's contract: lower case, runs of letters and digits.  Lexemes drop stop words and strip English endings by
rules; they stand for a search engine's dictionary and are the same on both sides of a match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed word list.
STOP_WORDS = "a an and are as at be by for from in into is it its of on or that the their this to was were with".split()
#: Ending, replacement; applied in order to words of four letters or more.
STEM_RULES = (("(ies)$", "y"), ("(sses)$", "ss"), ("([^su])s$", "$1"), ("^(.{3,})(?:ing|ed)$", "$1"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    out = word
    for pattern, by in STEM_RULES:
        out = F.when(F.length(out) >= 4, F.regexp_replace(out, pattern, by)).otherwise(out)
    return out


def lexemes(*parts: Column) -> Column:
    """Distinct stems of all parts; a null part counts as empty."""
    words = F.filter(tokens(F.concat_ws(" ", *parts)), lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(words, stem))


def query_lexemes(term: str) -> Column:
    return lexemes(F.lit(term))


def matches_all(lexeme_array: Column, term: str) -> Column:
    """Every word of ``term`` is among the lexemes; a term of stop words alone matches nothing."""
    wanted = query_lexemes(term)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, lexeme_array)) == 0)


def matches_terms(lexeme_array: Column, terms: list[str], query_type: str = "AND") -> Column:
    """Terms joined by AND or OR; the words within a term are always joined by AND."""
    out = None
    for term in terms:
        one = matches_all(lexeme_array, term)
        out = one if out is None else (out & one if query_type == "AND" else out | one)
    return F.lit(False) if out is None else out


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` refers to it, inside functions over arrays as well."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space; empty where there are fewer."""

    def runs(w: Column) -> Column:
        many = F.greatest(F.size(w) - n + 1, F.lit(0))
        return F.transform(F.arrays_zip(*[F.slice(w, j + 1, many) for j in range(n)]), lambda z: F.concat_ws(" ", *[z[str(j)] for j in range(n)]))

    return let(words, runs)


def all_ngrams(words: Column, longest: int) -> Column:
    return let(words, lambda w: F.flatten(F.array(*[word_ngrams(w, n) for n in range(1, longest + 1)])))


def trigrams(text: Column) -> Column:
    """The set of three-letter pieces of each word, with two spaces before it and one after."""
    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(tokens(text), of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams, of arrays that ``trigrams`` made; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def chunks(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters; one empty piece of an empty text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))


def url_to_file_name(url: Column) -> Column:
    """Scheme dropped, everything but letters, digits, dot and dash to single underscores, none at the ends."""
    bare = F.regexp_replace(url, r"^[a-z]+://", "")
    return F.trim(F.regexp_replace(bare, r"[^A-Za-z0-9.\-]+", "_"), F.lit("_"))


def fenced_json(text: Column) -> Column:
    """What stands between ```json and ```; the text itself where there is no fence."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def hash_part(value: Column, parts: int) -> Column:
    """A number from 0 below ``parts`` that follows from the value's text alone, in any engine: of the first 32 bits of its MD5."""
    return F.pmod(F.conv(F.left(F.md5(value.cast("string")), F.lit(8)), 16, 10).cast("long"), F.lit(parts)).cast("int")


# Cleaning ----------------------------------------------------------------------------------------------------------

#: Legal signs and spelled-out symbols, in the order in which they are applied.
SUBSTITUTIONS = ((r"[®™©]", ""), (r"&", " and "), (r"[‘’]", "'"), (r"[“”]", '"'), (r"[‐‑‒–—]", "-"))


def squeeze(text: Column) -> Column:
    """One space at most, none before commas or a possessive s, none at the ends."""
    out = F.regexp_replace(text, r"\s{2,}", " ")
    out = F.regexp_replace(out, r"\s+,", ",")
    return F.trim(F.regexp_replace(out, r"' s\b", "'s"))


def substitute(text: Column) -> Column:
    for pattern, by in SUBSTITUTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def before_newline(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\n.*$", "")


def unwrap_parens(text: Column) -> Column:
    """A text that is wholly in parentheses loses them."""
    return F.regexp_replace(text, r"^\(([^()]*)\)$", "$1")


def drop_parentheticals(text: Column) -> Column:
    """Parentheses and what is in them go where a space stands before; those inside a name stay."""
    return F.regexp_replace(text, r"(?<=\s)\([^()]*\)", "")


def clean(text: Column) -> Column:
    """Newline, parentheses, symbols, dashes to spaces, lower case, single spaces: in this order."""
    out = unwrap_parens(before_newline(text))
    out = substitute(drop_parentheticals(out))
    out = F.regexp_replace(out, r"(?<=[A-Za-z])-(?=[A-Za-z])", " ")
    return squeeze(F.lower(out))


def without_words(text: Column, leading: list[str] = (), trailing: list[str] = (), anywhere: list[str] = ()) -> Column:
    """Removes whole words at the begin, at the end or anywhere, repeatedly at the ends."""
    for words, pattern in ((leading, r"(?i)^(?:(?:{})\b\s*)+"), (trailing, r"(?i)(?:\s*\b(?:{}))+$"), (anywhere, r"(?i)\b(?:{})\b")):
        if words:
            text = F.regexp_replace(text, pattern.replace("{}", "|".join(words)), "")
    return squeeze(text)


def without_stop_words(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~F.lower(w).isin(STOP_WORDS)), " ")


def depluralise_last(text: Column) -> Column:
    """The last word in the singular, by the stemmer's plural rules."""
    out = text
    for pattern, by in STEM_RULES[:3]:
        out = F.regexp_replace(out, pattern, by)
    return out


def swap_of(text: Column) -> Column:
    """"inhibitor of kinase" to "kinase inhibitor", for one "of" between plain words."""
    return F.regexp_replace(text, r"^([\w-]+) of ([\w -]+)$", "$2 $1")


def retry_forms(term: Column) -> Column:
    """Other spellings to try where a term isn't found: dashes out, dash to space, before a comma."""
    forms = F.array(F.regexp_replace(term, "-", ""), F.regexp_replace(term, "-", " "), F.regexp_extract(term, r"^([^,]+),", 1))
    return F.array_distinct(F.filter(forms, lambda f: (f != "") & (f != term)))


def or_pattern(words: list[str], *, plural: bool = False, boundary: bool = True) -> str:
    """A case-insensitive alternative of literal words, longest first."""
    import re

    body = "|".join(re.escape(w) + ("s?" if plural else "") for w in sorted(words, key=len, reverse=True))
    return rf"(?i)\b(?:{body})\b" if boundary else rf"(?i)(?:{body})"


def expand_pattern(pattern: str, most: int = 1000) -> list[str]:
    """The strings of a small pattern with groups of alternatives, character classes and optional parts; over ``most`` is an error."""
    import itertools
    import re

    def alternatives(text: str) -> list[str]:
        depth, parts, start = 0, [], 0
        for i, c in enumerate(text):
            depth += (c in "([") - (c in ")]")
            if c == "|" and not depth:
                parts.append(text[start:i])
                start = i + 1
        return [*parts, text[start:]]

    def pieces(text: str) -> list[list[str]]:
        out, i = [], 0
        while i < len(text):
            if text[i] == "(":
                depth, j = 1, i + 1
                while depth:
                    depth += (text[j] == "(") - (text[j] == ")")
                    j += 1
                inner = re.sub(r"^\?:", "", text[i + 1 : j - 1])
                choice, i = expand_pattern(inner, most), j
            elif text[i] == "[":
                j = text.index("]", i)
                choice, i = list(text[i + 1 : j]), j + 1
            else:
                choice, i = [text[i]], i + 1
            if text[i : i + 1] == "?":
                choice, i = ["", *choice], i + 1
            out.append(choice)
        return out

    found = ("".join(p) for a in alternatives(pattern) for p in itertools.product(*pieces(a)))
    strings = list(itertools.islice(found, most + 1))
    if len(strings) > most:
        raise ValueError(f"pattern stands for over {most} strings: {pattern}")
    return list(dict.fromkeys(strings))
