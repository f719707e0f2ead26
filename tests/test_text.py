from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouchline.functions import ident, text


_blanks = st.text(st.sampled_from(" \t\n\xa0\u2003"), min_size=1, max_size=3)
_word = st.text(st.sampled_from("abcxyzé0123"), min_size=1, max_size=6)


@given(st.lists(st.tuples(_word, st.sampled_from(["", ".", ",", ";", ":"]), st.booleans(), st.booleans(), _blanks), max_size=8), _blanks)
def test_clean_closes_seams_and_collapses_blanks(parts, edge):
    """Words with a stop after some and parentheses around some, blanks put where markup leaves them, come out closed up."""
    raw, want = edge, []
    for word, stop, loose, bracketed, gap in parts:
        inside = f"( {word} )" if bracketed else word
        raw += inside + (gap if loose and stop else "") + stop + gap
        want.append((f"({word})" if bracketed else word) + stop)
    assert text.clean_text(raw) == " ".join(want)


def test_clean_leaves_labels_alone():
    """A stop that begins a word belongs to it."""
    assert [text.clean_text(f"see {n} and {n}") for n in (".07", ".A3", ":x", ";y")] == ["see .07 and .07", "see .A3 and .A3", "see :x and :x", "see ;y and ;y"]
    assert text.clean_text("\ufb01le \uff21\uff33") == "file AS" and text.clean_text("") == ""


@given(st.text(max_size=60))
def test_clean_is_idempotent_and_keeps_words(raw):
    once = text.clean_text(raw)
    assert "  " not in once and once == once.strip()


def test_numbers(spark):
    said = ["AS 2301", "as-2301", " 2301 ", "AS_2301", "AS2301", "23O1", "AS 23011", "", None, "AS 230"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(text.as_number(F.col("s"))).collect()]
    assert got == ["AS 2301"] * 5 + [None] * 5


def test_series(spark):
    got = [r[0] for r in spark.createDataFrame([("AS 1101",), ("AS 2301",), ("AS 3101",), ("AS 4105",), ("AS 5000",), ("AS 6101",)], "s string").select(text.series(F.col("s"))).collect()]
    assert got == ["General Auditing Standards", "Audit Procedures", "Auditor Reporting", "Federal Securities Filings", "Other", "Other Audit-Related Matters"]


def test_word_count_counts_no_empty_text(spark):
    said = ["", " \t", "one", " two\xa0words ", "a b\x1cc", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(text.word_count(F.col("s"))).collect()]
    assert got == [0, 0, 1, 2, 3, None]


def test_tokens_and_jaccard_agree_with_python(spark):
    import re

    said = ["What does AS 2301.09 say?", "naïve café_1 3.5 3.", "", "ΑΒΓ δ", "a a a b"]
    df = spark.createDataFrame([(s,) for s in said], "s string").withColumn("f", text.folded("s"))
    for row in df.select("s", text.unigrams(F.col("f")).alias("u"), text.bigrams(text.unigrams(F.col("f"))).alias("b")).collect():
        want = re.findall(r"\w+(?:\.\d+)?", text.folded_text(row["s"]))
        assert row["u"] == want
        assert row["b"] == [f"{x} {y}" for x, y in zip(want, want[1:], strict=False)]
    pair = spark.sql("select array('a', 'b', 'c') x, array('b', 'c', 'd') y, cast(array() as array<string>) z")
    assert tuple(pair.select(text.jaccard(F.col("x"), F.col("y")), text.jaccard(F.col("z"), F.col("z"))).first()) == (0.5, 0.0)


def test_excerpt(spark):
    long = "a" * 100 + " needle " + "b" * 100
    df = spark.createDataFrame([(long, "needle"), ("short needle", "needle"), ("c" * 150, "c"), (long.upper(), "needle")], "t string, n string")
    got = [r[0] for r in df.select(text.excerpt(F.col("t"), F.col("n"))).collect()]
    start = 101 - 46
    assert got[0] == "..." + long[start : start + 140].strip() + "..."
    assert got[1] == "short needle"
    assert got[2] == "c" * 140 + "..."
    assert "NEEDLE" in got[3]


def test_limits_and_bands(spark):
    df = spark.createDataFrame([(w,) for w in (0, 150, 301, 193, 194, 733, 734, 99999)], "w int")
    got = [tuple(r) for r in df.select(text.candidate_limit(F.col("w")), text.length_band(F.col("w"))).collect()]
    assert got == [(2, "short"), (2, "short"), (3, "medium"), (2, "short"), (2, "medium"), (5, "medium"), (5, "long"), (8, "long")]


def test_citations(spark):
    df = spark.createDataFrame([("see as 1105 and AS2301.09, AS 2301.A1b, as 2301.05",)], "t string")
    assert df.select(text.standards_cited(F.col("t"))).first()[0] == ["AS 1105", "AS 2301"]
    assert df.select(text.labels_cited(F.col("t"))).first()[0] == [".09"]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_digest_does_not_depend_on_key_order(value):
    again = json.loads(json.dumps(value))
    assert ident.digest_of(value) == ident.digest_of(again)


def test_native_digests_equal_the_canonical_ones(spark):
    df = spark.createDataFrame([("x", 3, ["a", "b"], None, True)], "b string, d int, a array<string>, c string, e boolean")
    got = df.select(ident.struct_digest(F.struct("a", "b", "c", "d", "e")), ident.seeded_digest(42, F.lit('unit:"q"'))).first()
    assert got[0] == ident.digest_of({"a": ["a", "b"], "b": "x", "c": None, "d": 3, "e": True})
    assert got[1] == ident.digest_of([42, 'unit:"q"'])


def test_fingerprint_is_independent_of_row_order(spark):
    a = spark.createDataFrame([("AS 2", "y"), ("AS 1", "x")], "as_number string, source_sha256 string")
    want = "sha256:" + hashlib.sha256(b"AS 1 x\nAS 2 y\n").hexdigest()
    assert ident.corpus_fingerprint(a).first()[0] == want == ident.corpus_fingerprint(a.orderBy("as_number")).first()[0]
    assert ident.corpus_fingerprint(a.limit(1)).first()[0] != want
