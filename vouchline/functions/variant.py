"""JSON texts as variants: what a text holds, checked and taken apart by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read(text: Column) -> Column:
    """The value of a JSON text; null where the text as a whole isn't JSON, where an object names a key twice or where a
    number is none of JSON's. The reader stops at the end of the first value, so the text is read inside two kinds of
    brackets: what goes on after its value can't close both."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(named.isNotNull() & alone, F.try_variant_get(listed, "$[0]", "variant"))


def fields(value: Column) -> Column:
    """An object's fields as a map; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """A list's items; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_null(value: Column) -> Column:
    """Whether a value is there and is JSON's null."""
    return F.coalesce(F.schema_of_variant(value) == "VOID", F.lit(False))


def string(value: Column) -> Column:
    """A string's text; null for anything else."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def strings(value: Column) -> Column:
    """A list of strings; null for anything else, also for a list with anything else in it."""
    listed = items(value)
    return F.when(F.forall(listed, is_string), F.transform(listed, lambda x: F.try_variant_get(x, "$", "string")))


def has_fields(known: Column, *names: str) -> Column:
    """Whether the keys of a map of fields are exactly these."""
    return F.coalesce((F.size(known) == len(names)) & (F.size(F.array_except(F.array(*map(F.lit, names)), F.map_keys(known))) == 0), F.lit(False))
