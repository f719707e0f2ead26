"""Coverage, concentration and rejection statistics over decisions, and the stratified review sample."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vouchline.functions.ident import seeded_digest
from vouchline.functions.text import as_number, word_count
from vouchline.shared import Staging

SEED = 42


def decided(decisions: DataFrame) -> DataFrame:
    """A row a candidate: of copies delivered again the smallest is kept; status in lower case, standard as a number, reasons
    never null."""
    rows = decisions.select(
        "candidate_id",
        "unit_id",
        as_number(F.col("standard")).alias("standard"),
        "section_id",
        F.lower(F.trim("status")).alias("status"),
        F.col("record.id").alias("record_id"),
        F.coalesce(F.col("record.task_type"), F.lit("malformed")).alias("task_type"),
        F.col("record.complexity").alias("complexity"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )
    told = rows.filter("candidate_id is not null").distinct()
    return told.groupBy("candidate_id").agg(F.min(F.struct(*told.columns[1:])).alias("x")).select("candidate_id", "x.*")


def acceptance(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: raw candidates, accepted, rejected, pending and the acceptance rate (0 without candidates)."""
    raw = candidates.agg(F.count_distinct("id").alias("raw_candidates"))
    counts = rows.agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count(F.lit(1)).alias("n"))
    rate = F.coalesce(F.try_divide("accepted", "raw_candidates"), F.lit(0.0))
    return raw.join(counts).select("raw_candidates", "accepted", "rejected", (F.col("raw_candidates") - F.col("n")).alias("pending"), rate.alias("acceptance_rate"))


def accepted_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter("status = 'accepted'").groupBy(key).agg(F.count(F.lit(1)).alias("accepted"))


def rejection_reasons(rows: DataFrame) -> DataFrame:
    return rows.filter("status = 'rejected'").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rejections"))


def planned(units: DataFrame) -> DataFrame:
    return units.groupBy("standard").agg(F.count(F.lit(1)).alias("planned_units"), F.sum("candidate_limit").alias("candidate_ceiling"))


def coverage(standards: DataFrame, paragraphs: DataFrame, units: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a standard, also those with nothing accepted: accepted, its share, the source's word and section shares, and
    what is planned. The aggregates have a row a standard; totals are windows over them."""
    source = paragraphs.groupBy("standard").agg(F.sum(word_count(F.col("text"))).alias("words"), F.count_distinct("section_id").alias("sections"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    joined = standards.select(F.col("as_number").alias("standard")).join(source, "standard", "left").join(accepted_by(rows.filter("standard is not null"), "standard"), "standard", "left").join(planned(units), "standard", "left")
    filled = joined.select("standard", zero("accepted").alias("accepted"), zero("words").alias("words"), zero("sections").alias("sections"), zero("planned_units").alias("planned_units"), zero("candidate_ceiling").alias("candidate_ceiling"))
    total = lambda c: F.sum(c).over(W.partitionBy())
    share = lambda c: F.coalesce(F.try_divide(F.col(c), total(c)), F.lit(0.0))
    return filled.select("standard", "accepted", share("accepted").alias("share"), share("words").alias("source_word_share"), share("sections").alias("source_section_share"), "planned_units", "candidate_ceiling")


def section_coverage(paragraphs: DataFrame, rows: DataFrame) -> DataFrame:
    sections = paragraphs.select("standard", "section_id").distinct()
    return sections.join(accepted_by(rows, "section_id"), "section_id", "left").select("standard", "section_id", F.coalesce("accepted", F.lit(0)).alias("accepted"))


def uncovered(standards: DataFrame, rows: DataFrame) -> DataFrame:
    return standards.select(F.col("as_number").alias("standard")).join(rows.filter("status = 'accepted'").select("standard"), "standard", "left_anti")


def concentration(covered: DataFrame) -> DataFrame:
    """One row: shares of the largest and of the five largest standards, and the flag."""
    ranked = covered.withColumn("rank", F.row_number().over(W.orderBy(F.desc("accepted"), "standard"))).filter("rank <= 5")
    top = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    sums = ranked.agg(F.sum("accepted").alias("_n"), top("share").alias("largest_standard_share"), top("source_word_share").alias("_words"), F.sum("share").alias("top_five_share"), F.sum("source_word_share").alias("top_five_source_word_share"), F.sum("source_section_share").alias("top_five_source_section_share"))
    flag = (F.col("_n") > 0) & ((F.col("largest_standard_share") > F.greatest(F.lit(0.10), 2 * F.col("_words"))) | (F.col("top_five_share") > 0.50))
    return sums.select("largest_standard_share", "top_five_share", "top_five_source_word_share", "top_five_source_section_share", F.coalesce(flag, F.lit(False)).alias("concentration_flag"))


def unit_outcomes(units: DataFrame, candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(unit_id, outcome): accepted if anything of the unit is, else rejection, else pending, else unattempted."""
    per = rows.groupBy("unit_id").agg(F.max((F.col("status") == "accepted").cast("int")).alias("a"), F.max((F.col("status") == "rejected").cast("int")).alias("r"))
    tried = candidates.select("unit_id").distinct().withColumn("tried", F.lit(True))
    joined = units.select(F.col("id").alias("unit_id")).join(tried, "unit_id", "left").join(per, "unit_id", "left")
    return joined.select("unit_id", F.when(F.col("a") == 1, "accepted").when(F.col("r") == 1, "rejection").when(F.col("tried"), "pending").otherwise("unattempted").alias("outcome"))


def statuses(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct("task_type").alias("task_types"))


def _stratum() -> list[Column]:
    return [F.coalesce("standard", F.lit("")).alias("s0"), F.col("task_type").alias("s1"), F.coalesce(F.to_json("complexity"), F.lit("{}")).alias("s2"), F.to_json("reasons").alias("s3")]


def review_sample(rows: DataFrame, size: int = 40, seed: int = SEED) -> DataFrame:
    """(candidate_id, status, place): three quarters accepted, a quarter rejected, then whatever is left, each time the
    decision of the least drawn standard, then of the least drawn other traits, ties by the seeded digest.

    Decisions that agree in all traits differ by their digest only, so of each such stratum the ``size`` smallest digests
    suffice; they are found in two steps, by bucket and over the buckets. Strata grow with the data, so each draw is an
    aggregate over them, and one row a draw comes to the driver.
    """
    spark = rows.sparkSession
    keys = ["status", "s0", "s1", "s2", "s3"]
    tied = rows.filter(F.col("status").isin("accepted", "rejected")).select("candidate_id", "status", *_stratum(), seeded_digest(seed, F.col("candidate_id")).alias("tie"))
    least = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*keys, *by).orderBy("tie"))).filter(F.col("rank") <= size).drop("rank")
    best = Staging(spark, "review").put(least(least(tied.withColumn("bucket", F.pmod(F.xxhash64("candidate_id"), F.lit(64))), "bucket").drop("bucket")))
    drawn: list[str] = []
    used = {key: Counter() for key in keys}
    out: list[tuple[str, str, int]] = []

    def times(key: str) -> Column:
        # As a constant map, so that the draws share one compiled plan.
        counts = F.create_map(*[F.lit(x) for pair in (used[key] or {"": 0}).items() for x in pair])
        return F.coalesce(F.try_element_at(counts, F.col(key)), F.lit(0))

    def draw(allowed: tuple[str, ...]) -> bool:
        cost = F.struct(times("s0").alias("c0"), (times("s1") + times("s2") + times("s3")).alias("c1"), "tie", "candidate_id", *keys)
        row = best.filter(F.array_contains(F.array(*map(F.lit, allowed)), F.col("status")) & ~F.array_contains(F.array(*map(F.lit, drawn)).cast("array<string>"), F.col("candidate_id"))).agg(F.min(cost).alias("x")).first()["x"]
        if row is None:
            return False
        drawn.append(row["candidate_id"])
        out.append((row["candidate_id"], row["status"], len(out)))
        for key in keys[1:]:
            used[key][row[key]] += 1
        return True

    for status, aim in (("accepted", (size * 3 + 3) // 4), ("rejected", size // 4)):
        for _ in range(aim):
            if not draw((status,)):
                break
    while len(out) < size and draw(("accepted", "rejected")):
        pass
    return spark.createDataFrame(out, "candidate_id string, status string, place int")


def review_rows(sample: DataFrame, rows: DataFrame, candidates: DataFrame, units: DataFrame, standards: DataFrame) -> DataFrame:
    """The sample beside its candidate, unit and standard."""
    wanted = F.broadcast(sample)
    texts = candidates.select(F.col("id").alias("candidate_id"), "raw").join(wanted.select("candidate_id"), "candidate_id", "left_semi").dropDuplicates(["candidate_id"])
    return wanted.join(rows.select("candidate_id", "unit_id", "standard", "section_id"), "candidate_id").join(texts, "candidate_id").join(units.select(F.col("id").alias("unit_id"), "words"), "unit_id", "left").join(standards.select(F.col("as_number").alias("standard"), "title"), "standard", "left")


def as_html(rows: list[dict], title: str) -> str:
    """A self-contained page of a few rows, every text escaped."""
    import html

    names = list(rows[0]) if rows else []
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if r[n] is None else str(r[n]))}</td>" for n in names) + "</tr>\n" for r in rows)
    return f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body><table><tr>{head}</tr>\n{body}</table></body></html>\n'
