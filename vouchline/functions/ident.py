"""Identities: canonical JSON, digests and fingerprints that are the same bit for bit on every run."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_text(value: object) -> str:
    """JSON with sorted keys, no blanks and plain Unicode."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest_of(value: object) -> str:
    return hashlib.sha256(canonical_text(value).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null where a text is no JSON. Needed where floats or free maps occur."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical_text(json.loads(text))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def struct_digest(value: Column) -> Column:
    """Digest of a struct of strings, integers, booleans and arrays whose fields are declared in alphabetical order."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def seeded_digest(seed: int, key: Column) -> Column:
    """Digest of the list [seed, key]: the tie-break of every seeded order."""
    return F.sha2(F.concat(F.lit(f"[{seed},"), F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit("]")), 256)


def corpus_fingerprint(standards: DataFrame) -> DataFrame:
    """standards(as_number, source_sha256) -> one row (fingerprint): over the pages' hashes in the order of the numbers.

    The hashed lines are a small aggregate (a line a standard) by the nature of the corpus manifest.
    """
    line = F.concat("as_number", F.lit(" "), "source_sha256", F.lit("\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("as_number", line.alias("line")))), lambda x: x["line"]), "")
    return standards.agg(F.concat(F.lit("sha256:"), F.sha2(lines, 256)).alias("fingerprint"))
