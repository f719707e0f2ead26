"""The engine's own queries by name, with DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from vouchline.functions import ident, text
from vouchline.operators import audit, corpus, dedup, pipeline, planning, report, validate
from vouchline.shared import Staging
from vouchline.sources import html
from vouchline.sources.tables import table

FLAGSHIP = "coverage_by_standard"
TERM = "going-concern forecasts"
ASKED = ["AS 2147", "as-1600", "AS3224", "9999", "no number", " 4558 ", "AS_2695"]

Query = Callable[[SparkSession, str], DataFrame]


def _of(build: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, folder: build(*(table(spark, folder, n) for n in names))



def _questions(candidates: DataFrame, kept: str = "id") -> DataFrame:
    """(id, question) of the candidates with a sound schema."""
    return validate.parsed(candidates).filter("schema_reason is null").select(kept, "question")


def _coverage(standards: DataFrame, paragraphs: DataFrame, units: DataFrame, decisions: DataFrame) -> DataFrame:
    rows = report.coverage(standards, paragraphs, units, report.decided(decisions))
    return rows.select("standard", "accepted", *[F.round(c, 9).alias(c) for c in ("share", "source_word_share", "source_section_share")], "planned_units", "candidate_ceiling")


def _concentration(standards: DataFrame, paragraphs: DataFrame, units: DataFrame, decisions: DataFrame) -> DataFrame:
    one = report.concentration(report.coverage(standards, paragraphs, units, report.decided(decisions)))
    return one.select(*[F.round(c, 9).alias(c) if c.endswith("share") else F.col(c) for c in one.columns])


def _acceptance(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    one = report.acceptance(report.decided(decisions), candidates)
    return one.withColumn("acceptance_rate", F.round("acceptance_rate", 9))


def _evidence(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """build(citations, known) over the sound candidates' citations."""

    def run(candidates: DataFrame, units: DataFrame, paragraphs: DataFrame) -> DataFrame:
        return build(validate.cited(validate.parsed(candidates), units), validate.evidence(paragraphs))

    return run


def _reasons(candidates: DataFrame, units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    rows = validate.evidence_reasons(validate.parsed(candidates), units, validate.evidence(paragraphs))
    return rows.select("id", F.array_join("reasons", ",").alias("reasons"))


def _sound_reasons(candidates: DataFrame, units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The evidence reasons of the candidates with a sound schema."""
    read = validate.parsed(candidates).filter("schema_reason is null")
    return validate.evidence_reasons(read, units, validate.evidence(paragraphs)).select("id", F.array_join("reasons", ",").alias("reasons"))


def _focus(candidates: DataFrame, units: DataFrame) -> DataFrame:
    sound = validate.parsed(candidates).filter("schema_reason is null").select("id", "unit_id", F.explode("paragraph_ids").alias("paragraph_id"))
    focus = units.select(F.col("id").alias("unit_id"), F.explode("focus_ids").alias("paragraph_id"))
    return sound.join(focus, ["unit_id", "paragraph_id"], "left_semi").select("id", "paragraph_id")


def _first_valid(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events are the candidates with a sound schema; an event is valid if its decision has no reason against it but those
    of near duplicates, which are found only after the exact pass."""
    against = F.filter("reasons", lambda r: ~F.coalesce(text.code(r).isin("near_duplicate", "near_duplicate_uncertain"), F.lit(False)))
    said = decisions.select(F.col("candidate_id").alias("id"), F.col("record.id").alias("record_id"), F.coalesce(F.size(against), F.lit(0)).alias("n"))
    valid = said.groupBy("id").agg(F.max("record_id").alias("record_id"), (F.max("n") <= 0).alias("sound"))
    events = _questions(candidates).join(valid, "id").select("id", text.folded(F.col("question")).alias("question_key"), (F.col("sound") & F.col("record_id").isNotNull()).alias("valid"), "record_id")
    return dedup.first_valid(events).filter("duplicate_of is not null").select("id", "duplicate_of")


def _occurrences(candidates: DataFrame) -> DataFrame:
    items = candidates.select("id", F.col("generation_request").alias("request"), F.sha2("raw", 256).alias("content")).distinct().withColumn("pos", F.col("id"))
    return dedup.occurrences(items).select("id", "request", F.col("occurrence").cast("int").alias("occurrence"))


def _tokens(candidates: DataFrame) -> DataFrame:
    sets = dedup.token_sets(_questions(candidates), text.folded(F.col("question")))
    return sets.select(F.explode("uni").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("questions"))


def _near(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Near pairs among the questions of accepted records, by record id."""
    rows = report.decided(decisions).filter("status = 'accepted' and record_id is not null").select(F.col("candidate_id").alias("id"), "record_id")
    questions = _questions(candidates).join(rows, "id").select(F.col("record_id").alias("id"), "question").dropDuplicates(["id"])
    return dedup.near_pairs(dedup.token_sets(questions, text.folded(F.col("question"))))


def _resolved(duplicates: DataFrame) -> DataFrame:
    return dedup.resolved(dedup.recorded(duplicates))


def _units(paragraphs: DataFrame) -> DataFrame:
    rows = planning.units(paragraphs)
    return rows.select("section_id", "standard", F.array_join("focus_ids", ",").alias("focus_ids"), "words", "candidate_limit", "features.length", "features.standard_quartile", "features.multi_paragraph", "features.cross_references")


def _pilot(units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    ranks = planning.quartiles(corpus.standard_words(paragraphs)).select("standard", "quartile")
    return planning.pilot(units.select("id", "standard", F.col("id").alias("position")).join(ranks, "standard").select("id", "quartile", "position"), 24)


def _nested(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda standards, paragraphs: build(corpus.nested(standards, paragraphs))


def _html(standards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Pages rendered from the tables, parsed again and flattened."""
    read = html.parse_pages(html.render_pages(standards, paragraphs)).filter("ok")
    return corpus.flattened(read).select("as_number", F.col("heading").alias("section_id"), "number", "text")


def _numbers(decisions: DataFrame) -> DataFrame:
    spelled = decisions.select("standard").distinct().withColumn("as_number", text.as_number(F.col("standard")))
    return spelled.select(F.col("standard").alias("spelled"), "as_number", text.slug(F.col("as_number")).alias("slug"), F.when(F.col("as_number").isNotNull(), text.series(F.col("as_number"))).alias("series"))


def _review(decisions: DataFrame, candidates: DataFrame, units: DataFrame, standards: DataFrame) -> DataFrame:
    rows = report.decided(decisions)
    return report.review_rows(report.review_sample(rows), rows, candidates, units, standards)


def _cited_standards(candidates: DataFrame) -> DataFrame:
    said = validate.parsed(candidates).filter("schema_reason is null").select("id", F.concat_ws(" ", "question", "answer").alias("said"))
    return said.select("id", F.explode(text.standards_cited(F.col("said"))).alias("cited"))


def _critic(decisions: DataFrame) -> DataFrame:
    return pipeline.critic_of(decisions.filter("semantic_result is not null").select(F.col("candidate_id").alias("id"), F.col("semantic_result").alias("result")))


def _decided(candidates: DataFrame, decisions: DataFrame, units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Every candidate decided again from its text, its evidence and the critic's result on record."""
    return pipeline.decided(candidates, units, validate.evidence(paragraphs), _critic(decisions))


def _redecided(candidates: DataFrame, decisions: DataFrame, units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    rows = _decided(candidates, decisions, units, paragraphs)
    return rows.select("candidate_id", "status", F.array_join("reasons", ",").alias("reasons"), F.col("duplicate_of").isNotNull().alias("is_copy"))


def _validated(candidates: DataFrame, decisions: DataFrame, units: DataFrame, paragraphs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The same after near pairs: the records on file have ids of their own, so a pair judged there is looked up by its
    candidates."""
    rows = _decided(candidates, decisions, units, paragraphs)
    staged = Staging(rows.sparkSession, "validated").put(rows)
    named = decisions.filter("record.id is not null").select("candidate_id", F.lower(text.trimmed(F.col("record.id"))).alias("filed")).distinct().join(staged.filter("record_id is not null").select("candidate_id", "record_id"), "candidate_id").groupBy("filed").agg(F.min("record_id").alias("record_id"))
    judged = dedup.recorded(duplicates)
    for side in ("left", "right"):
        judged = judged.join(named.select(F.col("filed").alias(side), F.col("record_id").alias(f"new_{side}")), side)
    out = pipeline.settled(staged, judged.select(F.col("new_left").alias("left"), F.col("new_right").alias("right"), "result"))
    return out.select("candidate_id", "status", F.array_join("reasons", ",").alias("reasons"), "duplicate_of")


def _fixture_run(units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A whole run of the offline provider, whose critic passes everything and finds every near pair distinct."""
    known = validate.evidence(paragraphs)
    happened = pipeline.events(pipeline.envelopes(pipeline.fixture(units, paragraphs), units))
    critic = happened.select("id", F.array().cast("array<string>").alias("verdict"))
    rows = pipeline.decided(happened, units, known, critic)
    return rows.select("candidate_id", "unit_id", "status", F.array_join("reasons", ",").alias("reasons"), F.col("duplicate_of").isNotNull().alias("is_copy"))


def _requests(candidates: DataFrame) -> DataFrame:
    """The generation requests that the candidates name, a row a unit and request, all complete."""
    return candidates.filter("unit_id is not null").select(F.col("unit_id").alias("key"), F.lit("generate").alias("stage"), F.lit("complete").alias("state"), F.lit(None).cast("string").alias("malformed"), F.lit(None).cast("string").alias("abstention")).distinct()


def _gates(candidates: DataFrame, decisions: DataFrame, units: DataFrame) -> DataFrame:
    return pipeline.gates(candidates, decisions, units, _requests(candidates))


def _statistics(standards: DataFrame, paragraphs: DataFrame, units: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    rows = pipeline.statistics(standards, paragraphs, units, candidates, decisions)
    return rows.withColumn("value", F.round("value", 9))


def _damaged(standards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The integrity checks over tables damaged by rule, so that each check has something to find."""
    last = F.substring("id", -1, 1)
    bent = paragraphs.withColumn("number", F.when(last == "7", F.lit("7")).otherwise(F.col("number"))).withColumn("id", F.when(last == "3", F.lower("id")).otherwise(F.col("id"))).filter(F.substring("standard", -1, 1) != "9")
    return corpus.violations(standards.unionByName(standards.filter(F.substring("as_number", -1, 1) == "1")), bent)


def _pages_with_notes(standards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Footnotes: the standards' notes, put on their pages, read from them again."""
    read = html.parse_pages(html.render_pages(standards, paragraphs, with_notes=True)).filter("ok")
    return html.footnotes(read).select("standard", "number", "citation", "text", "id")


def _eligible(candidates: DataFrame, units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Citations of nothing that has a text: blank paragraphs are no evidence here."""
    return validate.unresolved(validate.cited(validate.parsed(candidates), units), validate.evidence(paragraphs.filter(~text.is_blank(F.col("text")))))


QUERIES: dict[str, Query] = {
    "decided_again": _of(_redecided, "candidates", "decisions", "units", "paragraphs"),
    "validated_again": _of(_validated, "candidates", "decisions", "units", "paragraphs", "duplicates"),
    "fixture_run": _of(_fixture_run, "units", "paragraphs"),
    "finalize_gates": _of(_gates, "candidates", "decisions", "units"),
    "statistics_document": _of(_statistics, "standards", "paragraphs", "units", "candidates", "decisions"),
    "unanswered_units": _of(lambda u, c: pipeline.unanswered(u.select("id", "standard"), _requests(c).select(F.col("key").alias("id"), "state")), "units", "candidates"),
    "rejected_with_candidates": _of(lambda d, c: pipeline.rejected(report.decided(d), c).select("candidate_id", F.array_join("reasons", ",").alias("reasons"), F.sha2("raw", 256).alias("raw_sha256")), "decisions", "candidates"),
    "damaged_corpus_violations": _of(_damaged, "standards", "paragraphs"),
    "html_footnotes": _of(_pages_with_notes, "standards", "paragraphs"),
    "evidence_unresolved_eligible": _of(_eligible, "candidates", "units", "paragraphs"),
    "coverage_by_standard": _of(_coverage, "standards", "paragraphs", "units", "decisions"),
    "paragraphs_flattened": _of(_nested(corpus.flattened), "standards", "paragraphs"),
    "paragraph_counts": _of(corpus.paragraph_counts, "paragraphs"),
    "word_counts": _of(corpus.standard_words, "paragraphs"),
    "blank_paragraph_issues": _of(corpus.blank_issues, "paragraphs"),
    "source_fingerprint": _of(ident.corpus_fingerprint, "standards"),
    "manifest_rows": _of(corpus.manifest_rows, "standards", "paragraphs"),
    "corpus_violations": _of(corpus.violations, "standards", "paragraphs"),
    "text_rendering": _of(_nested(corpus.rendered), "standards", "paragraphs"),
    "search_substring": _of(lambda p: corpus.search(p, TERM), "paragraphs"),
    "series_list_order": _of(corpus.listed, "standards"),
    "point_lookup": _of(lambda s: corpus.lookup(s, ASKED), "standards"),
    "normalised_numbers": _of(_numbers, "decisions"),
    "size_quartiles": _of(lambda p: planning.quartiles(corpus.standard_words(p)), "paragraphs"),
    "unit_features": _of(_units, "paragraphs"),
    "units_greedy_order": _of(lambda p: planning.ordered(planning.units(p)), "paragraphs"),
    "pilot_round_robin": _of(_pilot, "units", "paragraphs"),
    "unit_contexts": _of(lambda u, p: planning.contexts(u, p).select("id", "standard", "section_id", F.array_join("paragraph_ids", ",").alias("paragraph_ids")), "units", "paragraphs"),
    "fixture_responses": _of(planning.fixture_responses, "units", "paragraphs"),
    "candidate_schema_reasons": _of(lambda c: validate.parsed(c).groupBy("schema_reason").agg(F.count(F.lit(1)).alias("candidates")), "candidates"),
    "evidence_reasons": _of(_reasons, "candidates", "units", "paragraphs"),
    "evidence_reasons_sound": _of(_sound_reasons, "candidates", "units", "paragraphs"),
    "evidence_unresolved": _of(_evidence(validate.unresolved), "candidates", "units", "paragraphs"),
    "support_ordered": _of(_evidence(lambda c, k: validate.support(c, k).select("id", F.array_join(F.transform("support", lambda s: s["citation"]), ";").alias("support"))), "candidates", "units", "paragraphs"),
    "focus_overlap": _of(_focus, "candidates", "units"),
    "standards_cited": _of(_cited_standards, "candidates"),
    "complexity": _of(lambda c: validate.complexity(validate.parsed(c)).select("id", "complexity.*"), "candidates"),
    "exact_dup_first_valid": _of(_first_valid, "candidates", "decisions"),
    "occurrence_number": _of(_occurrences, "candidates"),
    "unigram_tokens": _of(_tokens, "candidates"),
    "near_pairs": _of(_near, "candidates", "decisions"),
    "near_resolve": _of(_resolved, "duplicates"),
    "acceptance_summary": _of(_acceptance, "decisions", "candidates"),
    "accepted_by_standard": _of(lambda d: report.accepted_by(report.decided(d), "standard"), "decisions"),
    "accepted_by_section": _of(lambda p, d: report.section_coverage(p, report.decided(d)), "paragraphs", "decisions"),
    "accepted_by_task_type": _of(lambda d: report.accepted_by(report.decided(d), "task_type"), "decisions"),
    "rejection_reasons": _of(lambda d: report.rejection_reasons(report.decided(d)), "decisions"),
    "planned_by_standard": _of(report.planned, "units"),
    "zero_coverage": _of(lambda s, d: report.uncovered(s, report.decided(d)), "standards", "decisions"),
    "top5_concentration": _of(_concentration, "standards", "paragraphs", "units", "decisions"),
    "unit_outcomes": _of(lambda u, c, d: report.unit_outcomes(u, c, report.decided(d)), "units", "candidates", "decisions"),
    "status_counts": _of(lambda d: report.statuses(report.decided(d)), "decisions"),
    "review_sample": _of(lambda d: report.review_sample(report.decided(d)), "decisions"),
    "review_rows": _of(_review, "decisions", "candidates", "units", "standards"),
    "inventory_diff": _of(lambda u, d: corpus.inventory(u.select(F.col("standard").alias("as_number")), report.decided(d).filter("standard is not null").select(F.col("standard").alias("as_number"))), "units", "decisions"),
    "uniqueness_violations": _of(lambda c: audit.repeated(c, "id"), "candidates"),
    "decision_bijection": _of(audit.unmatched, "candidates", "decisions"),
    "findings_union": _of(audit.findings, "candidates", "decisions", "units", "duplicates", "paragraphs"),
    "html_round_trip": _of(_html, "standards", "paragraphs"),
    "nfkc_normalize": _of(lambda c: _questions(c).select("id", text.folded(F.col("question")).alias("question_key")), "candidates"),
    "canonical_digest": _of(lambda c: c.select("id", F.sha2(ident.canonical(F.col("raw")), 256).alias("digest")).distinct(), "candidates"),
}

# What several statements below share.
_SPACE = r"[^\s\x1c-\x1f\p{Z}\x{85}]+"
_NUMBER = r"'AS ' || nullif(regexp_extract(standard, '(?i)^[\s\x1c-\x1f\p{Z}\x{85}]*(?:as[\s\x1c-\x1f\p{Z}\x{85}\-_]*)?(\d{4})[\s\x1c-\x1f\p{Z}\x{85}]*$', 1), '')"
_DECIDED = f"""decided AS (
    SELECT candidate_id, any_value(unit_id) AS unit_id, any_value({_NUMBER}) AS standard, any_value(section_id) AS section_id,
        any_value(lower(trim(status))) AS status, any_value(coalesce(record.task_type, 'malformed')) AS task_type,
        any_value(coalesce(reasons, [])) AS reasons
    FROM decisions WHERE candidate_id IS NOT NULL GROUP BY candidate_id)"""
_WORDS = f"len(regexp_extract_all(text, '{_SPACE}'))"
_SERIES = "CASE substr({0}, 4, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SERIES.items()) + f" ELSE '{text.OTHER_SERIES}' END"
_COVERAGE = f"""{_DECIDED},
    source AS (SELECT standard, sum({_WORDS}) AS words, count(DISTINCT section_id) AS sections FROM paragraphs GROUP BY 1),
    acc AS (SELECT standard, count(*) AS accepted FROM decided WHERE status = 'accepted' GROUP BY 1),
    plan AS (SELECT standard, count(*) AS planned_units, sum(candidate_limit) AS candidate_ceiling FROM units GROUP BY 1),
    filled AS (SELECT as_number AS standard, coalesce(accepted, 0)::BIGINT AS accepted, coalesce(words, 0)::BIGINT AS words, coalesce(sections, 0)::BIGINT AS sections,
        coalesce(planned_units, 0)::BIGINT AS planned_units, coalesce(candidate_ceiling, 0)::BIGINT AS candidate_ceiling
        FROM standards LEFT JOIN source ON source.standard = as_number LEFT JOIN acc ON acc.standard = as_number LEFT JOIN plan ON plan.standard = as_number),
    covered AS (SELECT standard, accepted, coalesce(accepted / nullif(sum(accepted) OVER (), 0), 0) AS share,
        coalesce(words / nullif(sum(words) OVER (), 0), 0) AS source_word_share, coalesce(sections / nullif(sum(sections) OVER (), 0), 0) AS source_section_share,
        planned_units, candidate_ceiling FROM filled)"""
_FLAT = """sections AS (SELECT standard, section_id, min(number) AS first FROM paragraphs GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY standard ORDER BY first, section_id) - 1 AS section_pos FROM sections)"""
# The sound candidates as DuckDB reads JSON; what Python's reader and DuckDB's take for JSON agrees on these tables.
_TASKS = ", ".join(f"'{t}'" for t in validate.TASK_TYPES)
_SOUND = rf"""objects AS (
    SELECT DISTINCT id, unit_id, TRY_CAST(raw AS JSON) AS j FROM candidates WHERE json_valid(raw)),
    typed AS (SELECT *, j->>'question' AS question, j->>'answer' AS answer, j->>'task_type' AS task_type FROM objects
        WHERE json_type(j) = 'OBJECT' AND len(list_filter(json_keys(j), lambda k: k NOT IN ('question', 'answer', 'task_type', 'paragraph_ids', 'footnote_ids', 'reasoning_tags'))) = 0
        AND json_type(j->'question') = 'VARCHAR' AND json_type(j->'answer') = 'VARCHAR' AND json_type(j->'task_type') = 'VARCHAR' AND json_type(j->'paragraph_ids') = 'ARRAY'
        AND coalesce(json_type(j->'footnote_ids'), 'ARRAY') = 'ARRAY' AND coalesce(json_type(j->'reasoning_tags'), 'ARRAY') = 'ARRAY'),
    lists AS (SELECT id, unit_id, question, answer, task_type, CAST(j->'paragraph_ids' AS VARCHAR[]) AS paragraph_ids,
        coalesce(TRY_CAST(j->'footnote_ids' AS VARCHAR[]), []) AS footnote_ids, coalesce(TRY_CAST(j->'reasoning_tags' AS VARCHAR[]), []) AS tags FROM typed),
    sound AS (SELECT * FROM lists WHERE regexp_matches(question, '[^\s\x1c-\x1f\p{{Z}}\x{{85}}]') AND regexp_matches(answer, '[^\s\x1c-\x1f\p{{Z}}\x{{85}}]')
        AND NOT regexp_matches(question || answer, '[\x00-\x08\x0b\x0c\x0e-\x1f]') AND task_type IN ({_TASKS})
        AND len(paragraph_ids) > 0 AND len(list_distinct(paragraph_ids)) = len(paragraph_ids) AND NOT list_contains(paragraph_ids, '')
        AND len(list_distinct(footnote_ids)) = len(footnote_ids) AND NOT list_contains(footnote_ids, '')
        AND len(list_distinct(tags)) = len(tags) AND len(list_filter(tags, lambda t: t NOT IN ({_TASKS}))) = 0)"""
_CITED = f"""{_SOUND},
    own AS (SELECT sound.id, units.standard AS own, paragraph_ids, footnote_ids FROM sound JOIN units ON units.id = unit_id),
    cited AS (SELECT id, own, 'paragraph' AS kind, unnest(paragraph_ids) AS evidence_id, generate_subscripts(paragraph_ids, 1) - 1 AS pos FROM own
        UNION ALL SELECT id, own, 'footnote', unnest(footnote_ids), generate_subscripts(footnote_ids, 1) - 1 FROM own)"""

# Full-width signs as plain ones, no-break blanks as blanks: the compatibility forms that these tables hold.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_SPACES = r"[\s\x1c-\x1f\p{Z}\x{85}]+"
_FOLDED = f"lower(replace(trim(regexp_replace(translate(question, '{_WIDE}', '{_PLAIN}'), '{_SPACES}', ' ', 'g')), 'ß', 'ss'))"
_EVIDENCE_REASONS = rf"""{_SOUND},
    own AS (SELECT s.*, u.standard AS own, u.focus_ids, question || ' ' || answer AS said FROM sound s JOIN units u ON u.id = s.unit_id),
    known AS (SELECT standard, list(id) AS ids, list(number) AS labels, list(id) FILTER (NOT regexp_matches(text, '{_SPACE}')) AS blank FROM paragraphs GROUP BY 1),
    judged AS (SELECT id, concat_ws(',',
        CASE WHEN len(list_filter(paragraph_ids, lambda p: NOT list_contains(ids, p))) > 0 THEN 'unresolved_paragraph' END,
        CASE WHEN len(footnote_ids) > 0 THEN 'unresolved_footnote' END,
        CASE WHEN list_has_any(list_concat(paragraph_ids, footnote_ids), coalesce(blank, [])) THEN 'empty_source_evidence' END,
        CASE WHEN NOT list_has_any(paragraph_ids, focus_ids) THEN 'no_focus_evidence' END,
        CASE WHEN len(list_filter(regexp_extract_all(said, '(?i)\bAS\s*(\d{{4}})', 1), lambda d: 'AS ' || d <> own)) > 0 THEN 'cross_standard_citation' END,
        CASE WHEN len(list_filter(regexp_extract_all(said, '\bAS\s*\d{{4}}(\.(?:\d{{2}}[A-Z]?|[A-Z]\d+))\b', 1), lambda l: NOT list_contains(labels, l))) > 0 THEN 'invalid_inline_citation' END) AS reasons
        FROM own JOIN known ON known.standard = own)"""

# The first reason of every candidate, in the order of the contract.
_FIELDS = ", ".join(f"'{n}'" for n in (*validate.TEXTS, *validate.LISTS))


def _broken_text(name: str) -> str:
    return rf"""WHEN coalesce(json_type(j->'{name}'), 'NULL') <> 'VARCHAR' OR NOT regexp_matches(j->>'{name}', '{_SPACE}') THEN 'empty_or_invalid_{name}'
        WHEN regexp_matches(j->>'{name}', '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'control_characters'"""


def _broken_list(name: str) -> str:
    absent = "'ARRAY'" if name in validate.OPTIONAL else "'NULL'"
    held = f"coalesce(CAST(j->'{name}' AS JSON[]), [])"
    return f"""WHEN coalesce(json_type(j->'{name}'), {absent}) <> 'ARRAY' OR len(list_filter({held}, lambda x: json_type(x) <> 'VARCHAR' OR x = '""')) > 0
        OR len(list_distinct(CAST({held} AS VARCHAR[]))) < len({held}) THEN 'invalid_{name}'"""


_REASON = f"""told AS (SELECT DISTINCT id, unit_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN CAST(raw AS JSON) END AS j FROM candidates),
    reasoned AS (SELECT id, unit_id, CASE WHEN j IS NULL THEN 'candidate_not_object'
        WHEN len(list_filter(json_keys(j), lambda k: k NOT IN ({_FIELDS}))) > 0 THEN 'unexpected_fields'
        WHEN NOT list_has_all(json_keys(j), ['question', 'answer', 'task_type', 'paragraph_ids']) THEN 'missing_fields'
        {" ".join(map(_broken_text, validate.TEXTS))}
        WHEN j->>'task_type' NOT IN ({_TASKS}) THEN 'unknown_task_type'
        {" ".join(map(_broken_list, validate.LISTS))}
        WHEN json_array_length(j->'paragraph_ids') = 0 THEN 'missing_paragraph_evidence'
        WHEN len(list_filter(coalesce(CAST(j->'reasoning_tags' AS VARCHAR[]), []), lambda t: t NOT IN ({_TASKS}))) > 0 THEN 'unknown_reasoning_tag' END AS schema_reason FROM told)"""
# Near pairs of the accepted records by counting what any two have in common.
_NEAR = rf"""asked AS (SELECT DISTINCT record_id AS id, regexp_extract_all({_FOLDED}, '[\p{{L}}\p{{N}}_]+(?:\.\p{{Nd}}+)?') AS w
        FROM sound JOIN (SELECT DISTINCT candidate_id, record.id AS record_id FROM decisions WHERE lower(trim(status)) = 'accepted' AND record.id IS NOT NULL) d ON d.candidate_id = sound.id),
    uni AS (SELECT id, unnest(list_distinct(w)) AS t, len(list_distinct(w)) AS n FROM asked),
    grams AS (SELECT id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM asked),
    bi AS (SELECT id, unnest(g) AS t, len(g) AS n FROM grams),
    by_uni AS (SELECT a.id AS l, b.id AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS unigram FROM uni a JOIN uni b ON a.t = b.t AND a.id < b.id GROUP BY ALL),
    by_bi AS (SELECT a.id AS l, b.id AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS bigram FROM bi a JOIN bi b ON a.t = b.t AND a.id < b.id GROUP BY ALL),
    near AS (SELECT l, r, unigram, coalesce(bigram, 0.0) AS bigram FROM by_uni LEFT JOIN by_bi USING (l, r) WHERE unigram >= 0.7 OR bigram >= 0.5)"""

# Candidates decided from reasons, the critic's result and the first sound question that passed.
_DECIDING = f"""{_EVIDENCE_REASONS}, {_REASON},
    critic AS (SELECT candidate_id AS id, max(CASE lower(trim(semantic_result)) WHEN 'pass' THEN '' WHEN 'fail' THEN 'semantic_supported_fail' WHEN 'uncertain' THEN 'semantic_supported_uncertain' ELSE 'malformed_critic_output' END) AS verdict
        FROM decisions WHERE semantic_result IS NOT NULL GROUP BY 1),
    whole AS (SELECT r.id, coalesce(schema_reason, reasons, '') AS reasons, coalesce(verdict, 'malformed_critic_output') AS verdict, q.question_key FROM reasoned r LEFT JOIN judged USING (id) LEFT JOIN critic USING (id)
        LEFT JOIN (SELECT id, {_FOLDED} AS question_key FROM sound) q USING (id)),
    firsts AS (SELECT question_key, min(id) AS first FROM whole WHERE reasons = '' AND verdict = '' GROUP BY 1)"""
_DECIDING_SELECT = "whole.id AS candidate_id, CASE WHEN whole.reasons <> '' THEN whole.reasons WHEN whole.id > first THEN 'exact_duplicate_question' ELSE verdict END AS reasons, coalesce(whole.reasons = '' AND whole.id > first, false) AS is_copy FROM whole LEFT JOIN firsts USING (question_key)"
_STANDARD_DIGIT = "substr(as_number, -1, 1)"

ORACLES: dict[str, str] = {
    "near_resolve": f"""WITH RECURSIVE ends AS (SELECT lower(regexp_replace("left", '^{_SPACES}|{_SPACES}$', '', 'g')) AS x, lower(regexp_replace("right", '^{_SPACES}|{_SPACES}$', '', 'g')) AS y,
            regexp_replace(lower(regexp_replace(result, '^{_SPACES}|{_SPACES}$', '', 'g')), '[\\s\\p{{Z}}]*\\.$', '') AS z FROM duplicates),
        said AS (SELECT least(x, y) AS a, greatest(x, y) AS b, coalesce(max(z) FILTER (z IN ('duplicate', 'distinct', 'uncertain')), 'uncertain') AS verdict FROM ends WHERE x <> y GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (ORDER BY b, a) AS n FROM said WHERE verdict <> 'distinct'),
        s(i, gone, hit) AS (
            SELECT 0::BIGINT, []::VARCHAR[], false
            UNION ALL SELECT i + 1, CASE WHEN list_has_any(gone, [a, b]) THEN gone WHEN verdict = 'duplicate' THEN list_append(gone, b) ELSE list_concat(gone, [a, b]) END, NOT list_has_any(gone, [a, b]) FROM s JOIN o ON n = i + 1)
        SELECT b AS record, CASE verdict WHEN 'duplicate' THEN 'near_duplicate' ELSE 'near_duplicate_uncertain' END AS reason, CASE verdict WHEN 'duplicate' THEN a END AS duplicate_of FROM o JOIN s ON n = i WHERE hit
        UNION ALL SELECT a, 'near_duplicate_uncertain', NULL FROM o JOIN s ON n = i WHERE hit AND verdict = 'uncertain'""",
    "decided_again": f"WITH {_DECIDING}, final AS (SELECT {_DECIDING_SELECT}) SELECT candidate_id, CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status, reasons, is_copy FROM final",
    "finalize_gates": """WITH c AS (SELECT DISTINCT id FROM candidates), d AS (SELECT DISTINCT candidate_id FROM decisions)
        SELECT 'undecided_candidate' AS gate, id AS subject FROM c WHERE id NOT IN (SELECT candidate_id FROM d WHERE candidate_id IS NOT NULL)
        UNION ALL SELECT 'decision_without_candidate', candidate_id FROM d WHERE candidate_id NOT IN (SELECT id FROM c)
        UNION ALL SELECT 'conflicting_decisions', candidate_id FROM decisions GROUP BY 2 HAVING count(DISTINCT coalesce(lower(trim(status)), '')) > 1
        UNION ALL SELECT 'unattempted_unit', id FROM units WHERE id NOT IN (SELECT unit_id FROM candidates WHERE unit_id IS NOT NULL)
        UNION ALL SELECT 'nothing_accepted', 'run' FROM decisions HAVING count(*) FILTER (lower(trim(status)) = 'accepted') = 0""",
    "unanswered_units": "SELECT id, standard, false AS blocked FROM units WHERE id NOT IN (SELECT unit_id FROM candidates WHERE unit_id IS NOT NULL)",
    "rejected_with_candidates": f"WITH {_DECIDED}, c AS (SELECT id, min(raw) AS raw FROM candidates GROUP BY 1) SELECT candidate_id, array_to_string(reasons, ',') AS reasons, sha256(raw) AS raw_sha256 FROM decided JOIN c ON id = candidate_id WHERE status = 'rejected'",
    "statistics_document": f"""WITH {_COVERAGE}, ranked AS (SELECT *, row_number() OVER (ORDER BY accepted DESC, standard) AS rank FROM covered),
        top AS (SELECT sum(accepted) AS n, max(share) FILTER (rank = 1) AS largest, max(source_word_share) FILTER (rank = 1) AS words, sum(share) AS five, sum(source_word_share) AS five_words, sum(source_section_share) AS five_sections FROM ranked WHERE rank <= 5),
        c AS (SELECT count(DISTINCT id) AS n, count(DISTINCT unit_id) AS u FROM candidates),
        t AS (SELECT count(*) AS n, count(*) FILTER (status = 'accepted') AS yes, count(*) FILTER (status = 'rejected') AS no FROM decided),
        rows AS (
            SELECT 'totals' AS section, unnest(['raw_candidates', 'accepted', 'rejected', 'pending', 'acceptance_rate', 'units_with_candidates']) AS name,
                unnest([c.n::DOUBLE, yes, no, c.n - t.n, coalesce(yes / nullif(c.n, 0), 0), c.u]) AS value FROM c, t
            UNION ALL SELECT 'totals', unnest(['planned_units', 'planned_standards', 'candidate_ceiling']), unnest([count(*)::DOUBLE, count(DISTINCT standard), sum(candidate_limit)]) FROM units
            UNION ALL SELECT 'totals', 'zero_coverage_standards', count(*) FILTER (accepted = 0) FROM covered
            UNION ALL SELECT 'concentration', unnest(['largest_standard_share', 'top_five_share', 'top_five_source_word_share', 'top_five_source_section_share', 'concentration_flag']),
                unnest([largest, five, five_words, five_sections, CASE WHEN n > 0 AND (largest > greatest(0.1, 2 * words) OR five > 0.5) THEN 1 ELSE 0 END]) FROM top
            UNION ALL SELECT 'rejection_reasons', reason, count(*) FROM (SELECT unnest(reasons) AS reason FROM decided WHERE status = 'rejected') GROUP BY 2
            UNION ALL SELECT 'task_types', task_type, count(*) FROM decided WHERE status = 'accepted' GROUP BY 2
            UNION ALL SELECT 'accepted', standard, accepted FROM covered
            UNION ALL SELECT 'share', standard, share FROM covered)
        SELECT section, name, round(value, 9) AS value FROM rows""",
    "html_footnotes": """WITH n AS (SELECT as_number AS standard, unnest(notes) AS text, generate_subscripts(notes, 1)::VARCHAR AS number FROM standards WHERE as_number IN (SELECT standard FROM paragraphs))
        SELECT standard, number, standard || ' footnote ' || number AS citation, text, replace(standard, ' ', '') || ':footnote:' || number || ':' || sha256(to_json({'number': number, 'text': text})::VARCHAR) AS id FROM n""",
    "fixture_run": f"""WITH said AS (SELECT u.id AS unit_id, to_json({{'answer': p.text, 'paragraph_ids': [p.id], 'question': 'What does ' || citation || ' state?', 'task_type': 'direct_requirement'}})::VARCHAR AS raw FROM units u JOIN paragraphs p ON p.id = focus_ids[1]),
        candidates AS (SELECT 'candidate:' || sha256('["' || sha256(unit_id) || '","' || sha256(raw) || '",0]') AS id, raw, unit_id FROM said),
        decisions AS (SELECT id AS candidate_id, 'pass' AS semantic_result FROM candidates),
        {_DECIDING}, final AS (SELECT {_DECIDING_SELECT})
        SELECT candidate_id, unit_id, CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status, reasons, is_copy FROM final JOIN candidates ON candidates.id = candidate_id""",
    "damaged_corpus_violations": rf"""WITH s AS (SELECT * FROM standards UNION ALL SELECT * FROM standards WHERE {_STANDARD_DIGIT} = '1'),
        p AS (SELECT standard, CASE WHEN substr(id, -1, 1) = '7' THEN '7' ELSE number END AS number, CASE WHEN substr(id, -1, 1) = '3' THEN lower(id) ELSE id END AS id FROM paragraphs WHERE substr(standard, -1, 1) <> '9'),
        n AS (SELECT as_number, said, count(p.id) AS held FROM (SELECT DISTINCT as_number, paragraphs AS said FROM s) LEFT JOIN p ON p.standard = as_number GROUP BY ALL)
        SELECT 'duplicate_manifest_entry' AS code, as_number FROM s GROUP BY 2 HAVING count(*) > 1
        UNION SELECT 'paragraph_count', as_number FROM n WHERE said <> held
        UNION SELECT 'paragraph_label', standard FROM p WHERE NOT coalesce(regexp_full_match(number, '\.(?:\d{{2}}[A-Z]?|[A-Z]\d+)'), false)
        UNION SELECT 'ambiguous_paragraph', standard FROM (SELECT standard, number FROM p GROUP BY ALL HAVING count(*) > 1)
        UNION SELECT 'paragraph_identity', standard FROM p WHERE id <> replace(standard, ' ', '') || number
        UNION SELECT 'inventory', coalesce(as_number, standard) FROM (SELECT DISTINCT as_number FROM s) FULL JOIN (SELECT DISTINCT standard FROM p) ON as_number = standard WHERE as_number IS NULL OR standard IS NULL""",
    "evidence_unresolved_eligible": f"WITH {_CITED} SELECT own, kind, evidence_id, id, pos::INT AS pos FROM cited WHERE NOT EXISTS (SELECT 1 FROM paragraphs p WHERE p.standard = own AND p.id = evidence_id AND kind = 'paragraph' AND regexp_matches(p.text, '{_SPACE}'))",
    "candidate_schema_reasons": f"WITH {_REASON} SELECT schema_reason, count(*) AS candidates FROM reasoned GROUP BY 1",
    "evidence_reasons": f"WITH {_EVIDENCE_REASONS}, {_REASON} SELECT r.id, coalesce(schema_reason, reasons, '') AS reasons FROM reasoned r LEFT JOIN judged USING (id)",
    "near_pairs": f'WITH {_SOUND}, {_NEAR} SELECT l AS "left", r AS "right", unigram, bigram FROM near',
    "coverage_by_standard": f"WITH {_COVERAGE} SELECT standard, accepted, round(share, 9) AS share, round(source_word_share, 9) AS source_word_share, round(source_section_share, 9) AS source_section_share, planned_units, candidate_ceiling FROM covered",
    "paragraphs_flattened": f"""WITH {_FLAT} SELECT p.standard AS as_number, section_pos::INT AS section_pos, p.section_id AS heading,
        (row_number() OVER (PARTITION BY p.standard, p.section_id ORDER BY number, text) - 1)::INT AS paragraph_pos, number, text
        FROM paragraphs p JOIN placed ON placed.standard = p.standard AND placed.section_id = p.section_id JOIN standards ON as_number = p.standard""",
    "paragraph_counts": "SELECT standard, count(*) AS paragraphs, count(DISTINCT section_id) AS sections FROM paragraphs GROUP BY 1",
    "word_counts": f"SELECT standard, sum({_WORDS})::BIGINT AS words FROM paragraphs GROUP BY 1",
    "blank_paragraph_issues": f"SELECT standard, id AS paragraph_id, 'empty_source_text' AS reason FROM paragraphs WHERE text IS NULL OR NOT regexp_matches(text, '{_SPACE}')",
    "source_fingerprint": r"SELECT 'sha256:' || sha256(string_agg(as_number || ' ' || source_sha256 || chr(10), '' ORDER BY as_number)) AS fingerprint FROM standards",
    "manifest_rows": f"""SELECT as_number, title, {_SERIES.format("as_number")} AS series, url, source_sha256 AS sha256, count(DISTINCT section_id) AS sections, count(p.id) AS paragraphs
        FROM standards s LEFT JOIN paragraphs p ON p.standard = as_number GROUP BY ALL""",
    "corpus_violations": r"""WITH n AS (SELECT as_number, any_value(paragraphs) AS said, count(p.id) AS held FROM standards LEFT JOIN paragraphs p ON p.standard = as_number GROUP BY 1)
        SELECT 'duplicate_manifest_entry' AS code, as_number FROM standards GROUP BY 2 HAVING count(*) > 1
        UNION SELECT 'paragraph_count', as_number FROM n WHERE said <> held
        UNION SELECT 'paragraph_label', standard FROM paragraphs WHERE NOT coalesce(regexp_full_match(number, '\.(?:\d{2}[A-Z]?|[A-Z]\d+)'), false)
        UNION SELECT 'ambiguous_paragraph', standard FROM (SELECT standard, number FROM paragraphs GROUP BY ALL HAVING count(*) > 1)
        UNION SELECT 'paragraph_identity', standard FROM paragraphs WHERE id <> replace(standard, ' ', '') || number
        UNION SELECT 'inventory', coalesce(as_number, standard) FROM (SELECT DISTINCT as_number FROM standards) FULL JOIN (SELECT DISTINCT standard FROM paragraphs) ON as_number = standard WHERE as_number IS NULL OR standard IS NULL""",
    "text_rendering": f"""WITH {_FLAT}, parts AS (
            SELECT p.standard, section_pos, p.section_id || chr(10) || chr(10) || string_agg(number || '  ' || text, chr(10) || chr(10) ORDER BY number, text) AS part
            FROM paragraphs p JOIN placed ON placed.standard = p.standard AND placed.section_id = p.section_id GROUP BY p.standard, section_pos, p.section_id),
        bodies AS (SELECT standard, string_agg(part, chr(10) || chr(10) ORDER BY section_pos) AS body FROM parts GROUP BY 1)
        SELECT as_number, regexp_replace(as_number || ': ' || title || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || chr(10) || chr(10) || coalesce(body, ''), '[\\s\\x1c-\\x1f\\p{{Z}}\\x{{85}}]+$', '') || chr(10) AS text
        FROM standards LEFT JOIN bodies ON standard = as_number""".replace("\\\\", "\\"),
    "search_substring": f"""WITH hits AS (SELECT standard AS as_number, number AS paragraph, text, greatest(0, strpos(lower(text), lower('{TERM}')) - 1 - 46) AS start FROM paragraphs WHERE contains(lower(text), lower('{TERM}')))
        SELECT as_number, paragraph, text, CASE WHEN length(text) <= 140 THEN text ELSE (CASE WHEN start > 0 THEN '...' ELSE '' END) || trim(substr(text, start + 1, 140)) || '...' END AS excerpt FROM hits""",
    "series_list_order": f"""SELECT as_number, title, {_SERIES.format("as_number")} AS series,
        row_number() OVER (ORDER BY coalesce(list_position(['1', '2', '3', '4', '6'], substr(as_number, 4, 1)), 6), as_number)::INT AS position FROM standards""",
    "point_lookup": "WITH asked AS (SELECT unnest([{0}]) AS standard), numbered AS (SELECT standard AS asked, {1} AS as_number FROM asked) SELECT asked, numbered.as_number, title FROM numbered LEFT JOIN standards USING (as_number)".format(", ".join(f"'{a}'" for a in ASKED), _NUMBER),
    "normalised_numbers": f"""WITH spelled AS (SELECT DISTINCT standard FROM decisions), numbered AS (SELECT standard AS spelled, {_NUMBER} AS as_number FROM spelled)
        SELECT spelled, as_number, replace(as_number, ' ', '') AS slug, CASE WHEN as_number IS NOT NULL THEN {_SERIES.format("as_number")} END AS series FROM numbered""",
    "size_quartiles": f"""WITH w AS (SELECT standard, sum({_WORDS})::BIGINT AS words FROM paragraphs GROUP BY 1)
        SELECT standard, words, least(3, floor((row_number() OVER (ORDER BY words, standard) - 1) * 4 / count(*) OVER ()))::INT AS quartile FROM w""",
    "unit_features": rf"""WITH w AS (SELECT standard, sum({_WORDS}) AS words FROM paragraphs GROUP BY 1),
        q AS (SELECT standard, least(3, floor((row_number() OVER (ORDER BY words, standard) - 1) * 4 / count(*) OVER ()))::INT AS standard_quartile FROM w),
        s AS (SELECT section_id, standard, string_agg(id, ',' ORDER BY number, id) FILTER (regexp_matches(text, '{_SPACE}')) AS focus_ids, sum({_WORDS})::INT AS words,
            string_agg(text, ' ' ORDER BY number, id) AS whole, count(*) AS n FROM paragraphs GROUP BY section_id, standard)
        SELECT section_id, standard, focus_ids, words, least(8, greatest(2, ceil(words / 150)))::INT AS candidate_limit,
            CASE WHEN words < 194 THEN 'short' WHEN words <= 733 THEN 'medium' ELSE 'long' END AS length, standard_quartile, n > 1 AS multi_paragraph,
            regexp_matches(whole, '(?i)\bAS\s*\d{{4}}|\bparagraphs?\b') AS cross_references FROM s JOIN q USING (standard) WHERE focus_ids IS NOT NULL""",
    "pilot_round_robin": f"""WITH w AS (SELECT standard, sum({_WORDS}) AS words FROM paragraphs GROUP BY 1),
        q AS (SELECT standard, least(3, floor((row_number() OVER (ORDER BY words, standard) - 1) * 4 / count(*) OVER ()))::INT AS quartile FROM w),
        t AS (SELECT id, quartile, row_number() OVER (PARTITION BY quartile ORDER BY id) AS turn FROM units JOIN q USING (standard))
        SELECT id, quartile, row_number() OVER (ORDER BY turn, quartile)::INT AS place FROM t ORDER BY turn, quartile LIMIT 24""",
    "unit_contexts": "SELECT u.id, u.standard, u.section_id, string_agg(p.id, ',' ORDER BY p.id) AS paragraph_ids FROM units u JOIN paragraphs p ON p.standard = u.standard GROUP BY ALL",
    "fixture_responses": "SELECT u.id AS unit_id, 'What does ' || citation || ' state?' AS question, p.text AS answer, 'direct_requirement' AS task_type, p.id AS paragraph_id FROM units u JOIN paragraphs p ON p.id = focus_ids[1]",
    "evidence_unresolved": f"WITH {_CITED} SELECT own, kind, evidence_id, id, pos::INT AS pos FROM cited WHERE NOT EXISTS (SELECT 1 FROM paragraphs p WHERE p.standard = own AND p.id = evidence_id AND kind = 'paragraph')",
    "support_ordered": f"WITH {_CITED} SELECT cited.id, string_agg(citation, ';' ORDER BY pos) AS support FROM cited JOIN paragraphs p ON p.standard = own AND p.id = evidence_id AND kind = 'paragraph' GROUP BY 1",
    "focus_overlap": f"WITH {_SOUND}, each AS (SELECT id, unit_id, unnest(paragraph_ids) AS paragraph_id FROM sound) SELECT each.id, paragraph_id FROM each SEMI JOIN (SELECT id AS unit_id, unnest(focus_ids) AS paragraph_id FROM units) USING (unit_id, paragraph_id)",
    "standards_cited": rf"WITH {_SOUND} SELECT DISTINCT id, 'AS ' || unnest(regexp_extract_all(question || ' ' || answer, '(?i)\bAS\s*(\d{{4}})', 1)) AS cited FROM sound",
    "complexity": f"WITH {_SOUND} SELECT id, len(paragraph_ids)::INT AS supporting_paragraphs, task_type IN ('scenario', 'application') AS scenario, len(paragraph_ids) > 1 AS synthesis FROM sound",
    "occurrence_number": "SELECT id, request, (row_number() OVER (PARTITION BY request, raw ORDER BY id) - 1)::INT AS occurrence FROM (SELECT DISTINCT id, generation_request AS request, raw FROM candidates)",
    "acceptance_summary": f"""WITH {_DECIDED}, c AS (SELECT count(DISTINCT id) AS n FROM candidates)
        SELECT any_value(n) AS raw_candidates, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, any_value(n) - count(*) AS pending,
            round(coalesce(count(*) FILTER (status = 'accepted') / nullif(any_value(n), 0), 0), 9) AS acceptance_rate FROM decided, c""",
    "accepted_by_standard": f"WITH {_DECIDED} SELECT standard, count(*) AS accepted FROM decided WHERE status = 'accepted' GROUP BY 1",
    "accepted_by_section": f"WITH {_DECIDED}, a AS (SELECT section_id, count(*) AS accepted FROM decided WHERE status = 'accepted' GROUP BY 1) SELECT standard, section_id, coalesce(accepted, 0) AS accepted FROM (SELECT DISTINCT standard, section_id FROM paragraphs) LEFT JOIN a USING (section_id)",
    "accepted_by_task_type": f"WITH {_DECIDED} SELECT task_type, count(*) AS accepted FROM decided WHERE status = 'accepted' GROUP BY 1",
    "rejection_reasons": f"WITH {_DECIDED}, r AS (SELECT unnest(reasons) AS reason FROM decided WHERE status = 'rejected') SELECT reason, count(*) AS rejections FROM r GROUP BY 1",
    "planned_by_standard": "SELECT standard, count(*) AS planned_units, sum(candidate_limit)::BIGINT AS candidate_ceiling FROM units GROUP BY 1",
    "zero_coverage": f"WITH {_DECIDED} SELECT as_number AS standard FROM standards WHERE as_number NOT IN (SELECT standard FROM decided WHERE status = 'accepted' AND standard IS NOT NULL)",
    "top5_concentration": f"""WITH {_COVERAGE}, ranked AS (SELECT *, row_number() OVER (ORDER BY accepted DESC, standard) AS rank FROM covered),
        s AS (SELECT sum(accepted) AS n, max(share) FILTER (rank = 1) AS largest, max(source_word_share) FILTER (rank = 1) AS words, sum(share) AS five, sum(source_word_share) AS five_words, sum(source_section_share) AS five_sections FROM ranked WHERE rank <= 5)
        SELECT round(largest, 9) AS largest_standard_share, round(five, 9) AS top_five_share, round(five_words, 9) AS top_five_source_word_share, round(five_sections, 9) AS top_five_source_section_share,
            n > 0 AND (largest > greatest(0.1, 2 * words) OR five > 0.5) AS concentration_flag FROM s""",
    "unit_outcomes": f"""WITH {_DECIDED}, per AS (SELECT unit_id, bool_or(status = 'accepted') AS a, bool_or(status = 'rejected') AS r FROM decided GROUP BY 1)
        SELECT id AS unit_id, CASE WHEN a THEN 'accepted' WHEN r THEN 'rejection' WHEN id IN (SELECT unit_id FROM candidates WHERE unit_id IS NOT NULL) THEN 'pending' ELSE 'unattempted' END AS outcome
        FROM units LEFT JOIN per ON per.unit_id = id""",
    "status_counts": f"WITH {_DECIDED} SELECT status, count(*) AS decisions, count(DISTINCT task_type) AS task_types FROM decided GROUP BY 1",
    "inventory_diff": f"""WITH {_DECIDED}, d AS (SELECT DISTINCT standard FROM decided WHERE standard IS NOT NULL), u AS (SELECT DISTINCT standard FROM units)
        SELECT coalesce(u.standard, d.standard) AS as_number, CASE WHEN u.standard IS NULL THEN 'manifest' ELSE 'files' END AS missing_from FROM u FULL JOIN d ON u.standard = d.standard WHERE u.standard IS NULL OR d.standard IS NULL""",
    "uniqueness_violations": "SELECT id AS key, count(*) AS n FROM candidates GROUP BY 1 HAVING count(*) > 1",
    "decision_bijection": """WITH c AS (SELECT DISTINCT id FROM candidates), d AS (SELECT DISTINCT candidate_id FROM decisions)
        SELECT coalesce(candidate_id, id) AS candidate_id, CASE WHEN id IS NULL THEN 'candidate' ELSE 'decision' END AS missing FROM c FULL JOIN d ON id = candidate_id WHERE id IS NULL OR candidate_id IS NULL""",
    "html_round_trip": rf"""SELECT standard AS as_number, section_id, number, regexp_replace(trim(regexp_replace(text, '[\s\x1c-\x1f\p{{Z}}\x{{85}}]+', ' ', 'g')), ' +([.,;:])( |$)', '\1\2', 'g') AS text FROM paragraphs""",
    "nfkc_normalize": f"WITH {_SOUND} SELECT id, {_FOLDED} AS question_key FROM sound",
    "unigram_tokens": rf"WITH {_SOUND}, t AS (SELECT DISTINCT id, unnest(regexp_extract_all({_FOLDED}, '[\p{{L}}\p{{N}}_]+(?:\.\p{{Nd}}+)?')) AS token FROM sound) SELECT token, count(*) AS questions FROM t GROUP BY 1",
    "exact_dup_first_valid": f"""WITH {_SOUND}, v AS (SELECT candidate_id AS id, max(record.id) AS record_id, max(coalesce(len(list_filter(reasons, lambda r: coalesce(trim(regexp_replace(lower(r), '[^\\p{{L}}\\p{{Nd}}]+', '_', 'g'), '_'), '') NOT IN ('near_duplicate', 'near_duplicate_uncertain'))), 0)) = 0 AS clean FROM decisions GROUP BY 1),
        e AS (SELECT id, {_FOLDED} AS k, clean AND record_id IS NOT NULL AS valid, record_id FROM sound JOIN v USING (id)),
        f AS (SELECT k, min(id) AS first, arg_min(record_id, id) AS record_id FROM e WHERE valid GROUP BY 1)
        SELECT e.id, f.record_id AS duplicate_of FROM e JOIN f USING (k) WHERE e.id > first""",
    "evidence_reasons_sound": f"WITH {_EVIDENCE_REASONS} SELECT id, reasons FROM judged",
    "findings_union": f"""WITH {_EVIDENCE_REASONS}, {_REASON}, {_NEAR}, once AS (SELECT DISTINCT candidate_id, unit_id, standard, lower(trim(status)) AS status, duplicate_of, record.id AS record_id, record.group_key AS group_key, record.document_id AS document_id FROM decisions),
        acc AS (SELECT once.*, {_NUMBER.replace("(?i)", "(?i)").replace("standard", "once.standard")} AS named, u.standard AS unit_standard, u.document_id AS unit_document FROM once LEFT JOIN units u ON u.id = unit_id WHERE status = 'accepted'),
        ends AS (SELECT lower(regexp_replace("left", '^{_SPACES}|{_SPACES}$', '', 'g')) AS x, lower(regexp_replace("right", '^{_SPACES}|{_SPACES}$', '', 'g')) AS y,
            regexp_replace(lower(regexp_replace(result, '^{_SPACES}|{_SPACES}$', '', 'g')), '[\\s\\p{{Z}}]*\\.$', '') AS z FROM duplicates),
        said AS (SELECT least(x, y) AS a, greatest(x, y) AS b, coalesce(max(z) FILTER (z IN ('duplicate', 'distinct', 'uncertain')), 'uncertain') AS verdict FROM ends WHERE x <> y GROUP BY ALL),
        members AS (SELECT DISTINCT lower(regexp_replace(x, '^{_SPACES}|{_SPACES}$', '', 'g')) AS id FROM (SELECT "left" AS x FROM duplicates UNION ALL SELECT "right" FROM duplicates)),
        counted AS (
            SELECT 'invalid_decision' AS code, count(*) AS subjects FROM once WHERE coalesce(status NOT IN ('accepted', 'rejected'), true)
            UNION ALL SELECT 'duplicate_accepted_ids', count(*) FROM (SELECT record_id FROM (SELECT DISTINCT record_id, candidate_id FROM acc) GROUP BY 1 HAVING count(*) > 1)
            UNION ALL SELECT 'duplicate_candidate_ids', count(*) FROM (SELECT id FROM candidates GROUP BY 1 HAVING count(*) > 1)
            UNION ALL SELECT 'missing_candidate_decisions', count(*) FROM (SELECT DISTINCT id FROM candidates WHERE id NOT IN (SELECT candidate_id FROM decisions WHERE candidate_id IS NOT NULL))
            UNION ALL SELECT 'decisions_without_candidate', count(*) FROM (SELECT DISTINCT candidate_id FROM decisions WHERE candidate_id NOT IN (SELECT id FROM candidates WHERE id IS NOT NULL))
            UNION ALL SELECT 'group_mismatch', count(*) FROM acc WHERE group_key IS DISTINCT FROM unit_standard OR named IS DISTINCT FROM unit_standard
            UNION ALL SELECT 'provenance_mismatch', count(*) FROM acc WHERE document_id IS DISTINCT FROM unit_document
            UNION ALL SELECT 'accepted_without_record', count(*) FROM acc WHERE record_id IS NULL
            UNION ALL SELECT 'duplicate_of_unknown_record', count(*) FROM once WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT record_id FROM once WHERE record_id IS NOT NULL)
            UNION ALL SELECT 'pair_of_unknown_record', count(*) FROM members WHERE id IS NULL OR id NOT IN (SELECT record_id FROM once WHERE record_id IS NOT NULL)
            UNION ALL SELECT 'split_fields_present', count(DISTINCT id) FROM candidates WHERE json_valid(raw) AND len(list_filter(coalesce(TRY(json_keys(TRY_CAST(raw AS JSON))), []), lambda k: contains(k, 'split') OR contains(k, 'holdout') OR k IN ('train', 'test'))) > 0
            UNION ALL SELECT 'deterministic_failure', count(*) FROM reasoned LEFT JOIN judged USING (id) WHERE coalesce(schema_reason, nullif(reasons, '')) IS NOT NULL AND id IN (SELECT candidate_id FROM once WHERE status = 'accepted')
            UNION ALL SELECT 'duplicate_accepted_questions', count(*) FROM (SELECT question_key FROM (SELECT DISTINCT record_id, {_FOLDED} AS question_key FROM sound JOIN once ON candidate_id = sound.id WHERE status = 'accepted') GROUP BY 1 HAVING count(DISTINCT record_id) > 1)
            UNION ALL SELECT 'unresolved_accepted_duplicate', count(*) FROM near WHERE NOT EXISTS (SELECT 1 FROM said WHERE a = l AND b = r AND verdict = 'distinct'))
        SELECT code, subjects FROM counted WHERE subjects > 0""",
}
