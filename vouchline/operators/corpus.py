"""Queries over a parsed corpus: flattening, counting, searching, listing and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vouchline.functions.ident import corpus_fingerprint
from vouchline.functions.text import SPACE, as_number, excerpt, is_blank, series, slug, word_count
from vouchline.sources.tables import PARAGRAPH

# The order of the series in listings, by thousands digit; the label of a numbered paragraph.
SERIES_ORDER = ("1", "2", "3", "4", "6")
LABEL = r"^\.(?:\d{2}[A-Z]?|[A-Z]\d+)$"


def nested(standards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Flat tables -> a row a standard with nested sections; a standard's paragraphs are one document's, so its row is small."""
    sections = paragraphs.groupBy("standard", "section_id").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("paragraphs"))
    one = F.struct(F.element_at("paragraphs", 1)["number"].alias("first"), F.col("section_id").alias("heading"), F.lit(2).alias("level"), "paragraphs")
    whole = sections.groupBy("standard").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s.dropFields("first")).alias("sections"))
    joined = standards.drop("paragraphs").join(whole, standards["as_number"] == whole["standard"], "left").drop("standard")
    return joined.withColumn("sections", F.coalesce("sections", F.array().cast(f"array<struct<heading: string, level: int, paragraphs: array<{PARAGRAPH}>>>"))).withColumn("footnotes", F.array().cast(f"array<{PARAGRAPH}>"))


def flattened(parsed: DataFrame) -> DataFrame:
    """Nested standards -> (as_number, section_pos, heading, paragraph_pos, number, text)."""
    sections = parsed.select("as_number", F.posexplode("sections").alias("section_pos", "section"))
    return sections.select("as_number", "section_pos", F.col("section.heading").alias("heading"), F.posexplode("section.paragraphs").alias("paragraph_pos", "p")).select("as_number", "section_pos", "heading", "paragraph_pos", "p.number", "p.text")


def rendered(parsed: DataFrame) -> DataFrame:
    """(as_number, text): the readable form of each standard."""
    lines = lambda ps: F.transform(ps, lambda p: F.concat(p["number"], F.lit("  "), p["text"]))
    sections = F.transform("sections", lambda s: F.array_join(F.concat(F.array(s["heading"]), lines(s["paragraphs"])), "\n\n"))
    notes = F.when(F.size("footnotes") > 0, F.concat(F.array(F.lit("Footnotes")), lines(F.col("footnotes")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat("as_number", F.lit(": "), "title"), F.concat(F.lit("Source: "), "url"), F.lit(""))
    text = F.regexp_replace(F.array_join(F.concat(head, sections, notes), "\n\n"), rf"^[{SPACE}]+|[{SPACE}]+$", "")
    return parsed.select("as_number", F.concat(text, F.lit("\n")).alias("text"))


def paragraph_counts(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("standard").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_distinct("section_id").alias("sections"))


def standard_words(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("standard").agg(F.sum(word_count(F.col("text"))).alias("words"))


def blank_issues(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.filter(is_blank(F.col("text"))).select("standard", F.col("id").alias("paragraph_id"), F.lit("empty_source_text").alias("reason"))


def manifest_rows(standards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A row a standard, as the manifest lists it; standards without paragraphs count 0."""
    counts = paragraph_counts(paragraphs)
    joined = standards.drop("paragraphs").join(counts, standards["as_number"] == counts["standard"], "left")
    return joined.select("as_number", "title", series(F.col("as_number")).alias("series"), "url", F.col("source_sha256").alias("sha256"), F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


def search(paragraphs: DataFrame, term: str) -> DataFrame:
    """Paragraphs that hold the term, in any case, literally; with an excerpt around the first hit."""
    needle = term.strip()
    if not needle:
        raise ValueError("nothing to search for")
    hits = paragraphs.filter(F.contains(F.lower("text"), F.lit(needle.lower())))
    return hits.select(F.col("standard").alias("as_number"), F.col("number").alias("paragraph"), "text", excerpt(F.col("text"), F.lit(needle)).alias("excerpt"))


def series_rank(number: Column) -> Column:
    digit, out = F.substring(number, 4, 1), F.when(F.lit(False), 0)
    for i, key in enumerate(SERIES_ORDER):
        out = out.when(digit == key, i)
    return out.otherwise(len(SERIES_ORDER))


def listed(standards: DataFrame) -> DataFrame:
    """Standards by series and number, with their position in the list. The list is one line a standard."""
    ranked = standards.select("as_number", "title", series(F.col("as_number")).alias("series"), series_rank(F.col("as_number")).alias("rank"))
    return ranked.withColumn("position", F.row_number().over(W.orderBy("rank", "as_number"))).drop("rank")


def lookup(standards: DataFrame, spelled: list[str]) -> DataFrame:
    """(asked, as_number, title): title is null for a number that isn't in the corpus, both for what is no number."""
    asked = standards.sparkSession.createDataFrame([(s,) for s in spelled], "asked string").withColumn("as_number", as_number(F.col("asked")))
    return asked.join(standards.select("as_number", "title"), "as_number", "left").select("asked", "as_number", "title")


def inventory(listed_numbers: DataFrame, held: DataFrame) -> DataFrame:
    """(as_number, missing_from): numbers on one side only."""
    left, right = listed_numbers.select("as_number").distinct().withColumn("a", F.lit(True)), held.select("as_number").distinct().withColumn("b", F.lit(True))
    both = left.join(right, "as_number", "full_outer").filter("a is null or b is null")
    return both.select("as_number", F.when(F.col("a").isNull(), "manifest").otherwise("files").alias("missing_from"))


def violations(standards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(code, as_number): what is wrong with a corpus; no row means nothing is."""
    counts = paragraph_counts(paragraphs)
    found = [
        standards.groupBy("as_number").count().filter("count > 1").select(F.lit("duplicate_manifest_entry").alias("code"), "as_number"),
        standards.join(counts, standards["as_number"] == counts["standard"], "left").filter(F.coalesce(counts["paragraphs"], F.lit(0)) != standards["paragraphs"]).select(F.lit("paragraph_count").alias("code"), "as_number"),
        paragraphs.filter(~F.coalesce(F.col("number").rlike(LABEL), F.lit(False))).select(F.lit("paragraph_label").alias("code"), F.col("standard").alias("as_number")),
        paragraphs.groupBy("standard", "number").count().filter("count > 1").select(F.lit("ambiguous_paragraph").alias("code"), F.col("standard").alias("as_number")),
        paragraphs.filter(F.col("id") != F.concat(slug(F.col("standard")), "number")).select(F.lit("paragraph_identity").alias("code"), F.col("standard").alias("as_number")),
        inventory(standards, paragraphs.select(F.col("standard").alias("as_number"))).select(F.lit("inventory").alias("code"), "as_number"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def reference_index(parsed: DataFrame) -> DataFrame:
    """Nested standards without the texts: references and hashes only."""
    bare = F.transform("sections", lambda s: s.withField("paragraphs", F.transform(s["paragraphs"], lambda p: p.dropFields("text"))))
    return parsed.drop("notes").withColumn("sections", bare).withColumn("footnotes", F.transform("footnotes", lambda f: f.dropFields("text")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either reference index that the other lacks; empty if the source is unchanged."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def summary(standards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row (standards, paragraphs, words, fingerprint)."""
    totals = paragraphs.agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(word_count(F.col("text"))).alias("words"))
    return standards.agg(F.count(F.lit(1)).alias("standards")).join(totals).join(corpus_fingerprint(standards))
