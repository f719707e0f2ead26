"""An independent audit of a finished pool: every check is a query for what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.functions.text import as_number, folded, trimmed
from vouchline.operators import dedup, validate
from vouchline.shared import Staging


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys with more than one row; exact, by a map-side combined count."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unmatched(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(candidate_id, missing): candidates without a decision and decisions without a candidate."""
    left = candidates.select(F.col("id").alias("candidate_id")).distinct().withColumn("c", F.lit(True))
    right = decisions.select("candidate_id").distinct().withColumn("d", F.lit(True))
    both = left.join(right, "candidate_id", "full_outer").filter("c is null or d is null")
    return both.select("candidate_id", F.when(F.col("c").isNull(), "candidate").otherwise("decision").alias("missing"))


def near_accepted(read: DataFrame, accepted: DataFrame) -> DataFrame:
    """Parsed candidates and accepted(candidate_id, record_id) -> the near pairs among the accepted records' questions."""
    sound = read.filter("schema_reason is null").select(F.col("id").alias("candidate_id"), "question")
    records = accepted.filter("record_id is not null").select("candidate_id", "record_id").distinct()
    questions = sound.join(records, "candidate_id").select(F.col("record_id").alias("id"), "question").dropDuplicates(["id"])
    return dedup.near_pairs(dedup.token_sets(questions, folded(F.col("question"))))


def unresolved_pairs(pairs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Near pairs of accepted records that are not recorded as distinct."""
    distinct = dedup.recorded(duplicates).filter("result = 'distinct'").select("left", "right")
    plain = lambda c: F.lower(trimmed(F.col(c)))
    return pairs.select(F.least(plain("left"), plain("right")).alias("left"), F.greatest(plain("left"), plain("right")).alias("right")).join(distinct, ["left", "right"], "left_anti")


def findings(candidates: DataFrame, decisions: DataFrame, units: DataFrame, duplicates: DataFrame, paragraphs: DataFrame | None = None, footnotes: DataFrame | None = None) -> DataFrame:
    """(code, subjects): one row a code that was found, with how many subjects broke the check. With the paragraphs, what
    was accepted is also checked again: its evidence, and its near pairs against the pairs recorded as distinct.

    Every table is read and made distinct once; the checks on its rows are counted by one aggregate each.
    """
    staging = Staging(candidates.sparkSession, "audit")
    fields = ("id", "group_key", "document_id")
    once = staging.put(decisions.select("candidate_id", "unit_id", "standard", F.lower(F.trim("status")).alias("status"), "duplicate_of", *[F.col(f"record.{f}").alias("record_id" if f == "id" else f) for f in fields]).distinct())
    known = units.select(F.col("id").alias("unit_id"), F.col("standard").alias("unit_standard"), F.col("document_id").alias("unit_document"))
    is_accepted, count = F.coalesce(F.col("status") == "accepted", F.lit(False)), lambda c: F.count_if(c)
    same = F.col("group_key").eqNullSafe(F.col("unit_standard")) & as_number(F.col("standard")).eqNullSafe(F.col("unit_standard"))
    by_row = once.join(known, "unit_id", "left").agg(
        count(~F.coalesce(F.col("status").isin("accepted", "rejected"), F.lit(False))).alias("invalid_decision"),
        count(is_accepted & ~same).alias("group_mismatch"),
        count(is_accepted & ~F.col("document_id").eqNullSafe(F.col("unit_document"))).alias("provenance_mismatch"),
        count(is_accepted & F.col("record_id").isNull()).alias("accepted_without_record"),
    )
    delivered = staging.put(candidates.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(validate.forbidden_keys(F.col("raw"))).alias("split")))
    by_candidate = delivered.agg(count(F.col("n") > 1).alias("duplicate_candidate_ids"), count("split").alias("split_fields_present"))
    sides = unmatched(delivered, once)
    by_side = sides.agg(count(F.col("missing") == "decision").alias("missing_candidate_decisions"), count(F.col("missing") == "candidate").alias("decisions_without_candidate"))
    accepted = once.filter("status = 'accepted'")
    twice = repeated(accepted.select("record_id", "candidate_id").distinct(), "record_id").agg(F.count(F.lit(1)).alias("duplicate_accepted_ids"))
    records = once.filter("record_id is not null").select("record_id").distinct()
    orphans = once.filter("duplicate_of is not null").select(F.col("duplicate_of").alias("record_id")).join(records, "record_id", "left_anti").agg(F.count(F.lit(1)).alias("duplicate_of_unknown_record"))
    members = duplicates.select(F.explode(F.array("left", "right")).alias("x")).select(F.lower(trimmed(F.col("x"))).alias("record_id")).distinct()
    strangers = members.join(records, "record_id", "left_anti").agg(F.count(F.lit(1)).alias("pair_of_unknown_record"))
    tables = [by_row, by_candidate, by_side, twice, orphans, strangers]
    if paragraphs is not None:
        read = staging.put(validate.parsed(candidates))
        near = unresolved_pairs(near_accepted(read, accepted), duplicates)
        reasons = validate.evidence_reasons(read, units, validate.evidence(paragraphs, footnotes)).filter(F.size("reasons") > 0)
        failed = reasons.join(accepted.select(F.col("candidate_id").alias("id")).distinct(), "id", "left_semi")
        questions = read.filter("schema_reason is null").join(accepted.select(F.col("candidate_id").alias("id"), "record_id").distinct(), "id").select("record_id", folded(F.col("question")).alias("question")).distinct()
        asked = questions.groupBy("question").agg(F.count_distinct("record_id").alias("n")).filter("n > 1")
        tables += [rows.agg(F.count(F.lit(1)).alias(code)) for code, rows in (("unresolved_accepted_duplicate", near), ("deterministic_failure", failed), ("duplicate_accepted_questions", asked))]
    counted = [table.unpivot([], table.columns, "code", "subjects") for table in tables]
    return reduce(DataFrame.unionByName, counted).filter("subjects > 0")
