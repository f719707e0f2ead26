"""Problem 8: keyword-stuffed and link-list pages, by pointwise mutual information of neighbouring words.

Neighbouring pairs are counted by occurrence over all documents, each language for itself, and give each pair's PMI
within its language. Words that prose doesn't use are rare there, so the pairs inside keyword phrases, product names and
tags have a high PMI, and the seams between phrases a low one. A link or tag is one sign whatever it says, and the word
beside it counts as any word, so that a list of links is one collocation over and over. Three figures of a page decide:

* its mean PMI, which lies off that of prose when the words are strung together at random (word salad);
* the deviation of PMI within it, which is off when phrases of high PMI meet at seams of low PMI, or nothing varies at all;
* the share of its pairs that are collocations repeated within the page (stuffing).

The prose of the page's language, as the corpus has it, gives the mean and spread of each, and a page is suspect when it
is further from prose than DISTANCE spreads, all taken together. A page without a language's function words is counted
with, and measured by, the commonest language. Of the suspects, those that still read as sentences for the most part (lines
and sentences with the function words of their language) are let off: prose on a rare matter, or with a list at its end.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.llm.defects import LANGUAGES
from vouchline.operators.skew import hot_keys, salted_join
from vouchline.shared import Staging

#: Least share of function words in a piece of prose, by language.
GLUE = {"en": 0.12, "de": 0.15, "fr": 0.25, "es": 0.25, "pt": 0.25, "nl": 0.25}
#: A piece, that is a line or a sentence, has at least so many words, or it is no sentence.
PIECE = 5
#: A word inside a phrase that dominates a page holds no sentence together: its pairs to both sides are that frequent.
DOMINANT, DOMINANT_SHARE = 5, 0.08
#: A collocation is a pair from this PMI on (natural logarithm); it is repeated from so many times on in a page.
COLLOCATION, REPEATED = 4.0, 3
#: How many spreads from prose a page is suspect.
DISTANCE = 2.5
#: A language's figures are trusted from so many pages of prose on, else those of all prose; spreads aren't taken to be less.
TRUSTED, LEAST_SPREAD, LEAST_REPEATED_SPREAD = 20, 0.1, 0.05
#: What counts as a page of prose for these figures.
SENTENCES, LENGTH = 0.1, 30
#: A suspect is let off when less than this share of its words lies outside sentences; one FAR off prose, when still less does.
LOOSE, FAR, LESS_LOOSE = 0.65, 5.0, 0.4
#: Fewer words, links and tags than this make no page.
LEAST = 8
#: A table of so many pairs' PMI (16 bytes each) goes to the pages; a larger one is met by a join over salts.
SMALL = 1_500_000
#: Words that a worker keeps.
CACHE = 500_000

_signs = re.compile(r"(?:https?://|www\.)\S+|(?<!\w)#\w+|\w+(?:\.\d+)?|[.!?](?=\s)|[\n\r  ]")
# Languages in the order in which the first of equal scores is taken.
NAMES = tuple(sorted(LANGUAGES, reverse=True))
_bits: dict[str, int] = {}
for _at, _name in enumerate(NAMES):
    for _word in LANGUAGES[_name].split():
        _bits[_word] = _bits.get(_word, 0) | 1 << _at
_glue = np.array([GLUE[name] for name in NAMES])
# The first codes are signs, not words.
_BREAK, _STOP, _LINK, _TAG, _NUMBER, _ANY = range(6)

_PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())]))
_READ = "doc_id {}, lang int, words int, loose double, pairs array<struct<a: bigint, b: bigint, n: int>>"


class _Words(dict):
    """Signs of folded texts -> their codes; ``hashes`` and ``glue`` are the 64-bit hash and the languages of each code."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.glue = array("Q", range(6)), array("B", [0] * 6)

    def __missing__(self, sign: str) -> int:
        import xxhash

        first = sign[0]
        if first == "#":
            return _TAG
        if sign in ".!?":
            return _STOP
        if first in "\n\r  ":
            return _BREAK
        if first.isdigit():
            return _NUMBER
        if sign.startswith(("http://", "https://", "www.")):
            return _LINK
        out = self[sign] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(sign.encode("utf-8", "surrogatepass")))
        self.glue.append(_bits.get(sign, 0))
        return out


def plain(text: str) -> str:
    """Compatibility forms unified, case folded, accents removed, apostrophes plain; lines stay lines."""
    if text.isascii():
        return text.casefold()
    text = unicodedata.normalize("NFKC", text).casefold().replace("’", "'")
    return text if text.isascii() else "".join([c for c in unicodedata.normalize("NFD", text) if c < "\u0300" or not unicodedata.combining(c)])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _counted(row: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int, codes: int) -> tuple[np.ndarray, ...]:
    """The distinct (row, left, right) in order, and how often each occurs; as one number each where that has room."""
    bits, most = codes.bit_length(), rows.bit_length()
    if 2 * bits + most < 63:
        packed = np.sort((row << 2 * bits) | (left << bits) | right)
        first = np.flatnonzero(_starts(packed))
        count, packed = np.diff(np.append(first, len(packed))), packed[first]
        code = (1 << bits) - 1
        return packed >> 2 * bits, (packed >> bits) & code, packed & code, count
    order = np.lexsort((right, left, row))
    row, left, right = row[order], left[order], right[order]
    first = np.flatnonzero(_starts(row, left, right))
    return row[first], left[first], right[first], np.diff(np.append(first, len(row)))


def pages(texts: list[str], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of each text: (place of its language in NAMES or -1; its words, links and tags; the share of these outside
    sentences; (text, a, b, n) of its distinct neighbouring pairs, by text)."""
    lengths, codes = [], array("i")
    for text in texts:
        found = _signs.findall(plain(text))
        lengths.append(len(found))
        codes.extend(map(words.__getitem__, found))
    code, n = np.array(codes, np.int64), len(texts)
    row = np.repeat(np.arange(n), lengths)
    hashes, glue = np.array(words.hashes, np.uint64), np.array(words.glue, np.uint8)[code]
    said = code > _STOP
    scores = np.stack([np.bincount(row, (glue >> i) & 1, n) for i in range(len(NAMES))])
    language = np.where(scores.max(axis=0) > 0, scores.argmax(axis=0), -1)

    kept = code != _BREAK
    at, sign = row[kept], code[kept]
    together = at[1:] == at[:-1]
    here, left, right = at[1:][together], sign[:-1][together], sign[1:][together]
    marked = [(c == _LINK) | (c == _TAG) for c in (left, right)]
    left, right = np.where(marked[1] & ~marked[0], _ANY, left), np.where(marked[0] & ~marked[1], _ANY, right)
    here, left, right, count = _counted(here, left, right, n, len(hashes))
    a, b = hashes[left], hashes[right]

    total = np.bincount(here, count, n)
    dominant = count >= np.maximum(DOMINANT, DOMINANT_SHARE * total)[here]
    at_home = lambda text, word: word ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inner = np.intersect1d(at_home(here[dominant], a[dominant]), at_home(here[dominant], b[dominant]))
    held = ((glue >> np.maximum(language, 0)[row].astype(np.uint8)) & 1).astype(bool) & (language >= 0)[row]
    if len(inner):
        held &= ~np.isin(at_home(row, hashes[code]), inner)
    opens = _starts(row)
    if len(opens):
        opens[1:] |= ~said[:-1]
    piece = np.cumsum(opens) - 1
    pieces = int(piece[-1]) + 1 if len(piece) else 0
    size, bound, where = np.bincount(piece, said, pieces), np.bincount(piece, held, pieces), row[opens]
    prose = (size >= PIECE) & (bound >= _glue[language[where]] * size)
    units = np.bincount(row, said, n)
    loose = 1 - np.bincount(where, size * prose, n) / np.maximum(1, units)
    return language, units, loose, (here, a, b, count)


def read(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> a row of ``pages`` a document with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            if len(words) > CACHE:
                words = _Words()
            texts = batch.column(1).to_pylist()
            kept = [i for i, text in enumerate(texts) if text is not None and text.strip()]
            language, units, loose, (here, a, b, count) = pages([texts[i] for i in kept], words)
            ends = np.searchsorted(here, np.arange(len(kept) + 1))
            pairs = pa.StructArray.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(count.astype(np.int32))], fields=list(_PAIRS.value_type))
            columns = (batch.column(0).take(pa.array(kept, pa.int64())), pa.array(language.astype(np.int32), mask=language < 0), pa.array(units.astype(np.int32)), pa.array(loose), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs))
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "lang", "words", "loose", "pairs"])

    return documents.select("doc_id", "text").mapInArrow(run, _READ.format(documents.schema["doc_id"].dataType.simpleString()))


def counted(read_pages: DataFrame) -> DataFrame:
    """Pages with a language each (``own``): pages of none are counted with the commonest, found from a row a language."""
    rows = read_pages.filter("lang is not null").groupBy("lang").count().collect()
    commonest = max((r["count"], r["lang"]) for r in rows)[1] if rows else 0
    return read_pages.withColumn("own", F.coalesce("lang", F.lit(commonest)))


def pair_pmi(read_pages: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame, int, int]:
    """Pages(own, pairs) -> ((p, pmi), (p, n: pages with the pair), all n, rows): log of n(ab) n / (n(a·) n(·b)), by occurrence
    and within a language. ``p`` is a 64-bit hash of language and pair."""
    each = read_pages.select("own", F.explode("pairs").alias("x")).select("own", "x.*")
    keyed = each.select(F.xxhash64("own", "a", "b").alias("p"), F.xxhash64("own", "a").alias("a"), F.xxhash64("own", "b").alias("b"), "own", "n")
    counts = staging.put(keyed.groupBy("p").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.min("own").alias("own"), F.sum("n").alias("often"), F.count(F.lit(1)).alias("n")))
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = counts.groupBy("own").agg(F.sum("often").cast("double").alias("size"))
    out = counts.select("p", "a", "b", "own", "often")
    for side in ("a", "b"):
        margin = staging.put(counts.groupBy(side).agg(F.sum("often").alias(f"n_{side}"), F.count(F.lit(1)).alias("n")))
        out = salted_join(out, margin.select(side, f"n_{side}"), side, hot_keys(margin, side, distinct), F.col("p"))
    # A row a language.
    out = out.join(F.broadcast(sizes), "own")
    pmi = staging.put(out.select("p", F.log(F.col("often") * F.col("size") / (F.col("n_a") * F.col("n_b").cast("double"))).alias("pmi")))
    return pmi, counts.select("p", "n"), total, distinct


def features(documents: DataFrame, staging: Staging) -> DataFrame:
    """(doc_id, lang, own, words, loose, pmi, uneven, repeated) of every document with text: the mean and deviation of PMI,
    null without pairs, and the share of repeated collocations."""
    known = staging.put(read(documents).withColumn("row", F.monotonically_increasing_id()))
    known = counted(known)
    pmi, counts, total, distinct = pair_pmi(known, staging)
    each = known.select("row", "own", F.explode("pairs").alias("x")).select("row", F.xxhash64("own", "x.a", "x.b").alias("p"), "x.n")
    if distinct <= SMALL:
        joined = each.join(F.broadcast(pmi), "p")
    else:
        joined = salted_join(each, pmi, "p", hot_keys(counts, "p", total), F.col("row"))
    again = F.when((F.col("n") >= REPEATED) & (F.col("pmi") >= COLLOCATION), F.col("n")).otherwise(0)
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    per = joined.groupBy("row").agg(mean(F.col("pmi")).alias("pmi"), mean(F.col("pmi") * F.col("pmi")).alias("square"), (F.sum(again) / F.sum("n")).alias("repeated"))
    per = per.select("row", "pmi", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("pmi") * F.col("pmi"))).alias("uneven"), "repeated")
    return staging.put(known.drop("pairs").join(per, "row", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0.0))).drop("row"))


def from_prose(known: DataFrame) -> DataFrame:
    """With ``salad``, ``seams`` and ``stuffed``, how many spreads of prose a page's mean PMI and its deviation are off, to
    either side, and its share of repeated collocations above its mean; and ``distance``, all three together. The figures
    come from all pages of prose of a language; a language with too few of them is taken to be like all prose. Without any
    prose, as with a page without pairs, nothing is off."""
    prose = known.filter((F.col("loose") <= SENTENCES) & (F.col("words") >= LENGTH) & F.col("lang").isNotNull())
    figures = (("salad", "pmi", LEAST_SPREAD), ("seams", "uneven", LEAST_SPREAD), ("stuffed", "repeated", LEAST_REPEATED_SPREAD))
    rows = prose.rollup("own").agg(F.count("pmi").alias("n"), *[f(c).alias(f"{c}_{name}") for _, c, _ in figures for name, f in (("mean", F.avg), ("spread", F.stddev_pop))]).collect()
    usual = {r["own"]: r for r in rows if r["n"]}
    off = {name: F.lit(0.0) for name, _, _ in figures}
    if None in usual:
        for name, column, least in figures:
            deviation = F.when(F.lit(False), 0.0)
            for own in [*range(len(NAMES)), None]:
                r = usual[own] if own in usual and usual[own]["n"] >= TRUSTED else usual[None]
                value = (F.col(column) - r[f"{column}_mean"]) / max(r[f"{column}_spread"], least)
                deviation = deviation.when(F.col("own") == own, value) if own is not None else deviation.otherwise(value)
            off[name] = F.coalesce(F.greatest(deviation, F.lit(0.0)) if name == "stuffed" else F.abs(deviation), F.lit(0.0))
    squares = [F.pow(name, F.lit(2)) for name in off]
    return known.withColumns(off).withColumn("distance", F.sqrt(squares[0] + squares[1] + squares[2]))


def judged(documents: DataFrame) -> DataFrame:
    """Every document with text, its figures, its distance from prose and the verdict ``case``."""
    rows = from_prose(features(documents, Staging(documents.sparkSession, "stuffing")))
    suspect = (F.col("distance") > DISTANCE) & (F.col("words") >= LEAST)
    sentences = (F.col("loose") < LOOSE) & ((F.col("distance") <= FAR) | (F.col("loose") < LESS_LOOSE))
    return rows.withColumn("suspect", suspect).withColumn("case", suspect & ~sentences)


def found(documents: DataFrame) -> DataFrame:
    """p8_found(doc_id). Null, empty and blank texts are no pages; repeated texts are judged alike; an id given twice
    comes out once if any of its texts is a case. Other columns aren't read."""
    return judged(documents).filter("case").select("doc_id").distinct()
