"""Spellings: standards, labels and record ids as people write them, read with JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


def narrow(text: Column) -> Column:
    """Full-width ASCII letters, digits and signs as plain ones, every kind of space as a blank."""
    return F.regexp_replace(F.translate(text, _WIDE, _NARROW), r"[\s\p{Z}\x{200B}\x{FEFF}]", " ")


def trimmed_id(text: Column) -> Column:
    """An id without padding, in lower case; null when nothing is left."""
    said = F.lower(F.regexp_replace(narrow(text), r"^ +| +$", ""))
    return F.when(said != "", said)


def label_key(text: Column) -> Column:
    """A label's letters and digits in lower case: 'OB-727B ' and 'ob 727b' agree."""
    return F.regexp_replace(F.lower(narrow(text)), r"[^\p{L}\p{Nd}]", "")


def named_number(text: Column) -> Column:
    """'AS 1234' for a key with a standard's four digits in any spelling, else null.

    The digits stand after A and S ('A.S. 1234', 'docket:AS1234', 'AS1234.05A') or alone ('1234', '1234.').
    """
    plain = F.lower(narrow(text))
    after = F.regexp_extract(plain, r"(?<![\p{L}\p{Nd}])a\.? ?s\.?[^\p{L}\p{Nd}]*(\d{4})(?!\d)", 1)
    alone = F.regexp_extract(plain, r"^[^\p{L}\p{Nd}]*(\d{4})(?:\.(?:\d{2}[a-z]?|[a-z]\d+))?[^\p{L}\p{Nd}]*$", 1)
    digits = F.when(after != "", after).otherwise(alone)
    return F.when(digits != "", F.concat(F.lit("AS "), digits))


def slug(text: Column) -> Column:
    """Names that differ only in case, padding and the signs between words, as one_name."""
    plain = F.lower(narrow(text))
    joined = F.regexp_replace(plain, r"[^\p{L}\p{Nd}]+", "_")
    said = F.regexp_replace(joined, r"^_+|_+$", "")
    return F.when(said != "", said)
