"""Source units: one a section with text, their features, their order and the pilot."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vouchline.functions.ident import digest_of, seeded_digest, struct_digest
from vouchline.functions.text import candidate_limit, is_blank, length_band, refers_across, word_count

SEED = 42
FEATURES = ("length", "standard_quartile", "multi_paragraph", "footnotes_in_context", "cross_references")
#: The order is made on the driver from the keys of the sections of one corpus; more are refused.
MOST_UNITS = 200_000


def quartiles(words: DataFrame) -> DataFrame:
    """(standard, words) -> with quartile: place by words and number, times four, over the count; a row a standard."""
    place = F.row_number().over(W.orderBy("words", "standard")) - 1
    ranked = words.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    return ranked.select("standard", "words", F.least(F.lit(3), F.floor(F.col("place") * 4 / F.col("n"))).cast("int").alias("quartile"))


def units(paragraphs: DataFrame, footnotes: DataFrame | None = None, each: int = 150, most: int = 8) -> DataFrame:
    """paragraphs -> a row a section with a paragraph that isn't blank: focus_ids, words, candidate_limit, features, id.

    Words are those of all its paragraphs, blank ones included; focus_ids are those of the others.
    """
    one = F.struct("number", "id", "text", (~is_blank(F.col("text"))).alias("eligible"))
    sections = paragraphs.groupBy("standard", "document_id", "section_id").agg(F.array_sort(F.collect_list(one)).alias("ps"), F.sum(word_count(F.col("text"))).alias("words"))
    sections = sections.withColumn("text", F.array_join(F.transform("ps", lambda p: p["text"]), " ")).withColumn("focus_ids", F.transform(F.filter("ps", lambda p: p["eligible"]), lambda p: p["id"])).filter(F.size("focus_ids") > 0)
    ranks = quartiles(paragraphs.groupBy("standard").agg(F.sum(word_count(F.col("text"))).alias("words"))).select("standard", F.col("quartile").alias("standard_quartile"))
    rows = sections.join(ranks, "standard")
    if footnotes is None:
        rows = rows.withColumn("footnotes_in_context", F.lit(False))
    else:
        has = footnotes.select("standard").distinct().withColumn("has", F.lit(True))
        rows = rows.join(has, "standard", "left").withColumn("footnotes_in_context", F.coalesce("has", F.lit(False)))
    features = F.struct(refers_across(F.col("text")).alias("cross_references"), F.col("footnotes_in_context"), length_band(F.col("words")).alias("length"), (F.size("ps") > 1).alias("multi_paragraph"), F.col("standard_quartile"))
    rows = rows.select("standard", "document_id", "section_id", "focus_ids", F.col("document_id").alias("context_document_id"), F.col("words").cast("int").alias("words"), candidate_limit(F.col("words"), each, most).alias("candidate_limit"), features.alias("features"), F.lit("section-full-standard-v1").alias("strategy"))
    return rows.withColumn("id", F.concat(F.lit("unit:"), struct_digest(F.struct(*sorted(rows.columns)))))


def ordered(planned: DataFrame, seed: int = SEED) -> DataFrame:
    """units -> (id, position): rounds over the standards, least covered quartile first, within one the unit with the
    least represented features, ties by the seeded digest.

    Every choice depends on all before it, so the keys of the units (one a section of the corpus) are ordered on the
    driver; their features and digests are computed where the data is.
    """
    keys = planned.select("id", "standard", F.col("features.standard_quartile").alias("quartile"), *[F.col(f"features.{f}").cast("string").alias(f) for f in FEATURES], seeded_digest(seed, F.col("id")).alias("tie")).limit(MOST_UNITS + 1).collect()
    if len(keys) > MOST_UNITS:
        raise ValueError("too many units to order")
    waiting: dict[str, list] = defaultdict(list)
    for key in keys:
        waiting[key["standard"]].append(key)
    quartile = {key["standard"]: key["quartile"] for key in keys}
    turn = {standard: digest_of([seed, standard]) for standard in waiting}
    used: Counter = Counter()
    covered: Counter = Counter()
    out = []
    while waiting:
        for standard in sorted(waiting, key=lambda s: (covered[quartile[s]], turn[s])):
            pool = waiting[standard]
            best = min(range(len(pool)), key=lambda i: (sum(used[f, pool[i][f]] for f in FEATURES), pool[i]["tie"]))
            unit = pool.pop(best)
            if not pool:
                del waiting[standard]
            out.append((unit["id"], len(out)))
            used.update((f, unit[f]) for f in FEATURES)
            covered[quartile[standard]] += 1
    return planned.sparkSession.createDataFrame(out, "id string, position int")


def pilot(positioned: DataFrame, size: int = 24) -> DataFrame:
    """(id, quartile, position) -> the first ``size`` taken in turn from the quartiles, with their place."""
    turn = F.row_number().over(W.partitionBy("quartile").orderBy("position", "id"))
    first = positioned.withColumn("turn", turn).orderBy("turn", "quartile").limit(size)
    return first.withColumn("place", F.row_number().over(W.orderBy("turn", "quartile"))).select("id", "quartile", "place")


def contexts(planned: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each unit beside its whole standard: (id, section_id, paragraph ids of the standard in order)."""
    whole = paragraphs.groupBy("standard").agg(F.array_sort(F.collect_list("id")).alias("paragraph_ids"))
    return planned.select("id", "standard", "section_id").join(whole, "standard")


def fixture_responses(planned: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The offline provider: each unit's first focus paragraph becomes a question and its answer."""
    first = planned.select(F.col("id").alias("unit_id"), F.element_at("focus_ids", 1).alias("paragraph_id"))
    source = paragraphs.select(F.col("id").alias("paragraph_id"), "citation", F.col("text").alias("answer"))
    return first.join(source, "paragraph_id").select("unit_id", F.concat(F.lit("What does "), "citation", F.lit(" state?")).alias("question"), "answer", F.lit("direct_requirement").alias("task_type"), "paragraph_id")
