"""Text expressions. Built-in columns wherever Spark has them; Arrow UDFs for compatibility forms and case folding."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python splits on it, for both Java and RE2 patterns.
SPACE = r"\s\x1c-\x1f\p{Z}\x85"
#: A word of the token sets: letters, digits and underscores, with a decimal part.
TOKEN = r"([\p{L}\p{N}_]+(?:\.\p{Nd}+)?)"

# The series of a standard by its thousands digit.
SERIES = {"1": "General Auditing Standards", "2": "Audit Procedures", "3": "Auditor Reporting", "4": "Federal Securities Filings", "6": "Other Audit-Related Matters"}
OTHER_SERIES = "Other"

# Blanks that markup leaves before a stop that ends a word, and inside parentheses.
_seams = re.compile(r" +(?=[.,;:](?: |$))| +(?=\))|(?<=\() +")


def clean_text(text: str) -> str:
    """Compatibility forms unified, white space collapsed, seams closed."""
    return _seams.sub("", " ".join(unicodedata.normalize("NFKC", text).split()))


def folded_text(text: str) -> str:
    """What exact-duplicate questions share: compatibility forms, case folding, single blanks."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def clean(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else clean_text(x))


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else folded_text(x))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def as_number(text: Column) -> Column:
    """'AS 2301' for 'as-2301', 'AS2301' or '2301'; null for anything else."""
    digits = F.regexp_extract(text, rf"(?i)^[{SPACE}]*(?:as[{SPACE}\-_]*)?(\d{{4}})[{SPACE}]*$", 1)
    return F.when(digits != "", F.concat(F.lit("AS "), digits))


def code(text: Column) -> Column:
    """A code in lower case, without padding, any signs between its words as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "_"), "^_+|_+$", "")


def slug(number: Column) -> Column:
    return F.replace(number, F.lit(" "), F.lit(""))


def series(number: Column) -> Column:
    digit = F.substring(number, 4, 1)
    out = F.when(F.lit(False), "")
    for key, name in SERIES.items():
        out = out.when(digit == key, name)
    return out.otherwise(OTHER_SERIES)


def word_count(text: Column) -> Column:
    """Runs of anything but white space; 0 for an empty text."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("bigint")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(rf"[^{SPACE}]"), F.lit(False))


def unigrams(folded_question: Column) -> Column:
    return F.regexp_extract_all(folded_question, F.lit(TOKEN), F.lit(1))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs as one string each; tokens hold no blanks."""
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays of distinct members; 0 when both are empty."""
    both = F.size(F.array_intersect(left, right))
    return F.coalesce(F.try_divide(both, F.size(left) + F.size(right) - both), F.lit(0.0))


def standards_cited(text: Column) -> Column:
    """Distinct 'AS 1234' named in a text in any case; nothing need follow the digits' end."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bAS\s*(\d{4})"), F.lit(1)), lambda d: F.concat(F.lit("AS "), d)))


def labels_cited(text: Column) -> Column:
    """Distinct paragraph labels written after a standard, as 'AS 2301.09'; case matters here."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bAS\s*\d{4}(\.(?:\d{2}[A-Z]?|[A-Z]\d+))\b"), F.lit(1)))


def refers_across(text: Column) -> Column:
    return text.rlike(r"(?i)\bAS\s*\d{4}|\bparagraphs?\b")


def excerpt(text: Column, term: Column, width: int = 140, before: int = 46) -> Column:
    """A window of ``width`` around the first hit; dots where text is left out. Longer texts always end in dots."""
    start = F.greatest(F.lit(0), F.instr(F.lower(text), F.lower(term)) - 1 - before)
    window = trimmed(F.substring(text, start + 1, F.lit(width)))
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.when(start > 0, "...").otherwise(""), window, F.lit("...")))


def length_band(words: Column) -> Column:
    return F.when(words < 194, "short").when(words <= 733, "medium").otherwise("long")


def candidate_limit(words: Column, each: int = 150, most: int = 8) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(words / each))).cast("int")
