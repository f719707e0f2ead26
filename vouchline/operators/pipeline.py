"""From responses to accepted records: envelopes, events, decisions, near pairs, gates, and the statistics of a run.

Each stage is a function from tables to a table; nothing but the critic's and provider's answers comes from outside, and
those are tables too. A stage that is run again reads what is there and asks only for what is missing (``unanswered``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.functions.ident import canonical, struct_digest
from vouchline.functions.text import folded
from vouchline.operators import audit, dedup, report, validate
from vouchline.shared import Staging

# The checks that a decision lists.
CHECKS = ("schema", "source_references", "focus_evidence", "one_standard", "inline_citations", "exact_duplicates")


def request_ids(asked: DataFrame) -> DataFrame:
    """asked(stage, key, payload, prompt, model), the payload and model as JSON texts -> with id: the digest of the list of
    all five. The same question in the same words to the same model is the same request."""
    plain = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    parts = F.concat(F.lit("["), plain("stage"), F.lit(","), plain("key"), F.lit(","), canonical(F.col("payload")), F.lit(","), plain("prompt"), F.lit(","), canonical(F.col("model")), F.lit("]"))
    return asked.withColumn("id", F.sha2(parts, 256))


def unanswered(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """asked(id, ...) that no complete request answers yet, with ``blocked``: a request of that id is there in another
    state, so it must be settled before it may be sent again. answered(id, state)."""
    states = answered.groupBy("id").agg(F.max(F.col("state") == "complete").alias("complete"))
    return asked.join(states, "id", "left").filter(~F.coalesce("complete", F.lit(False))).withColumn("blocked", F.col("complete").isNotNull()).drop("complete")


def envelopes(responses: DataFrame, units: DataFrame) -> DataFrame:
    """responses(request, unit_id, response: JSON of stop_reason and text) -> (request, unit_id, standard, section_id,
    document_id, malformed, abstention, proposed: the candidates as JSON texts)."""
    known = units.select(F.col("id").alias("unit_id"), "standard", "section_id", "document_id", "candidate_limit")
    rows = responses.join(known, "unit_id").withColumn("text", validate.decoded(F.col("response")))
    judged = rows.withColumn("malformed", validate.envelope_reason(F.col("candidate_limit"), F.col("text")))
    sound = F.col("malformed").isNull()
    return judged.select("request", "unit_id", "standard", "section_id", "document_id", "malformed", F.when(sound, validate.abstention(F.col("text"))).alias("abstention"), F.when(sound, validate.proposed(F.col("text"))).alias("proposed"))


def events(read: DataFrame) -> DataFrame:
    """Envelopes -> (id, raw, unit_id, standard, section_id, request): an event a candidate. Equal candidates of a response
    are told apart by their number, so ids are unique and the same on every run."""
    each = read.select("request", "unit_id", "standard", "section_id", F.posexplode("proposed").alias("pos", "raw"))
    hashed = each.withColumn("content", F.sha2(canonical(F.col("raw")), 256))
    numbered = dedup.occurrences(hashed)
    listed = F.concat(F.lit('["'), "request", F.lit('","'), "content", F.lit('",'), F.col("occurrence").cast("string"), F.lit("]"))
    return numbered.select(F.concat(F.lit("candidate:"), F.sha2(listed, 256)).alias("id"), "raw", "unit_id", "standard", "section_id", "request")


def decided(candidates: DataFrame, units: DataFrame, known: DataFrame, critic: DataFrame) -> DataFrame:
    """candidates(id, raw, unit_id), units, evidence and critic(id, verdict: array of reasons) -> (candidate_id, unit_id,
    standard, section_id, deterministic_checks, reasons, record_id, question, duplicate_of, status), before near pairs.

    Of sound candidates with the same question the first that the critic passes keeps it, and later ones are its
    duplicates; the others have the critic's reasons. A candidate without a verdict is malformed.
    """
    staging = Staging(candidates.sparkSession, "decide")
    read = staging.put(validate.parsed(candidates))
    reasons = validate.evidence_reasons(read, units, known)
    cited = validate.support(validate.cited(read, units), known)
    place = units.select(F.col("id").alias("unit_id"), "standard", "section_id", "document_id")
    rows = read.select("id", "unit_id", "question", "answer").join(reasons, "id").join(place, "unit_id", "left").join(cited, "id", "left")
    sound = F.size("reasons") == 0
    asked = folded(F.col("question"))
    record = F.concat(F.lit("qa:"), struct_digest(F.struct("answer", F.col("document_id").alias("document"), asked.alias("question"), "support")))
    keyed = rows.withColumn("question_key", F.when(sound, asked)).withColumn("record_id", F.when(sound, record))
    verdicts = critic.groupBy("id").agg(F.min("verdict").alias("verdict"))
    judged = staging.put(keyed.drop("support", "answer").join(verdicts, "id", "left").withColumn("verdict", F.coalesce("verdict", F.array(F.lit("malformed_critic_output")))))
    firsts = dedup.first_valid(judged.filter(F.size("reasons") == 0).select("id", "question_key", (F.size("verdict") == 0).alias("valid"), "record_id"))
    out = judged.join(firsts.select("id", "duplicate_of"), "id", "left")
    later = F.when(F.col("duplicate_of").isNotNull(), F.array(F.lit("exact_duplicate_question"))).otherwise(F.col("verdict"))
    final = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(later)
    checks = F.array(*map(F.lit, CHECKS)).alias("deterministic_checks")
    return out.select(F.col("id").alias("candidate_id"), "unit_id", "standard", "section_id", checks, final.alias("reasons"), "record_id", "question", "duplicate_of", F.when(F.size(final) == 0, "accepted").otherwise("rejected").alias("status"))


def settled(judged: DataFrame, judgements: DataFrame) -> DataFrame:
    """Decisions and what the critic says of pairs (left, right, result, by record id) -> the decisions after near pairs.
    Only pairs of accepted records that reach a threshold count; one that nobody judged is uncertain."""
    staging = Staging(judged.sparkSession, "settle")
    judged = staging.put(judged)
    accepted = judged.filter("status = 'accepted'")
    questions = accepted.select(F.col("record_id").alias("id"), folded(F.col("question")).alias("question")).dropDuplicates(["id"])
    near = dedup.near_pairs(dedup.token_sets(questions, F.col("question"))).select("left", "right")
    told = near.join(dedup.recorded(judgements), ["left", "right"], "left").withColumn("result", F.coalesce("result", F.lit("uncertain")))
    fates = dedup.resolved(told).groupBy("record").agg(F.min(F.struct("reason", "duplicate_of")).alias("fate")).select(F.col("record").alias("record_id"), "fate")
    hit = F.col("fate").isNotNull() & (F.col("status") == "accepted")
    out = judged.join(fates, "record_id", "left").withColumn("hit", hit)
    return out.select("candidate_id", "unit_id", "standard", "section_id", "deterministic_checks", F.when(F.col("hit"), F.array("fate.reason")).otherwise(F.col("reasons")).alias("reasons"), "record_id", "question", F.when(F.col("hit"), F.col("fate.duplicate_of")).otherwise(F.col("duplicate_of")).alias("duplicate_of"), F.when(F.col("hit"), "rejected").otherwise(F.col("status")).alias("status"))


def gates(candidates: DataFrame, decisions: DataFrame, units: DataFrame, requests: DataFrame) -> DataFrame:
    """(gate, subject) of what keeps a run from being finalized: candidates without a decision and the other way round, more
    than one decision, requests(key, stage, state) that aren't complete, units that were never asked for, nothing accepted."""
    sides = audit.unmatched(candidates, decisions)
    twice = decisions.groupBy("candidate_id").agg(F.count_distinct(F.coalesce(F.lower(F.trim("status")), F.lit(""))).alias("n")).filter("n > 1")
    asked = requests.filter("stage = 'generate'").select(F.col("key").alias("id")).distinct()
    any_accepted = decisions.agg(F.count_if(F.lower(F.trim("status")) == "accepted").alias("n")).filter("n = 0")
    gate = lambda name, rows, subject: rows.select(F.lit(name).alias("gate"), subject.cast("string").alias("subject"))
    found = [
        gate("undecided_candidate", sides.filter("missing = 'decision'"), F.col("candidate_id")),
        gate("decision_without_candidate", sides.filter("missing = 'candidate'"), F.col("candidate_id")),
        gate("conflicting_decisions", twice, F.col("candidate_id")),
        gate("unresolved_request", requests.filter(~F.coalesce(F.col("state") == "complete", F.lit(False))), F.col("key")),
        gate("unattempted_unit", units.select("id").join(asked, "id", "left_anti"), F.col("id")),
        gate("nothing_accepted", any_accepted, F.lit("run")),
    ]
    return reduce(DataFrame.unionByName, found)


def accepted(decisions: DataFrame) -> DataFrame:
    """The accepted records by id, with what validated them."""
    rows = decisions.filter("status = 'accepted'")
    return rows.select(F.col("record_id").alias("id"), "candidate_id", "unit_id", "standard", "section_id", "question", F.struct("status", "deterministic_checks").alias("validation")).orderBy("id")


def rejected(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rejected decisions beside their candidates' raw texts."""
    raw = candidates.groupBy(F.col("id").alias("candidate_id")).agg(F.min("raw").alias("raw"))
    return decisions.filter("status = 'rejected'").join(raw, "candidate_id")


def unit_outcomes(units: DataFrame, requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """(unit_id, outcome), one of seven in this order: a unit that was never asked for is unattempted; a request that isn't
    complete is a failure; then malformed_response, abstention, accepted, rejection, and pending.
    requests(key, state, malformed, abstention) of generation, decisions(unit_id, status)."""
    asked = requests.groupBy(F.col("key").alias("unit_id")).agg(
        F.max(F.coalesce(F.col("state") != "complete", F.lit(True))).alias("failed"), F.max(F.coalesce(F.length("malformed") > 0, F.lit(False))).alias("bad"), F.max(F.coalesce(F.length("abstention") > 0, F.lit(False))).alias("none"), F.lit(True).alias("asked")
    )
    per = decisions.groupBy("unit_id").agg(F.max(F.col("status") == "accepted").alias("yes"), F.max(F.col("status") == "rejected").alias("no"))
    rows = units.select(F.col("id").alias("unit_id")).join(asked, "unit_id", "left").join(per, "unit_id", "left")
    outcome = F.when(F.col("asked").isNull(), "unattempted").when(F.col("failed"), "failure").when(F.col("bad"), "malformed_response").when(F.col("none"), "abstention").when(F.col("yes"), "accepted").when(F.col("no"), "rejection").otherwise("pending")
    return rows.select("unit_id", outcome.alias("outcome"))


def request_counts(requests: DataFrame) -> DataFrame:
    """One row (abstentions, malformed_responses, request_failures): a failure is a request whose fate is unknown; one that
    was never sent is none."""
    return requests.agg(F.count("abstention").alias("abstentions"), F.count_if(F.length("malformed") > 0).alias("malformed_responses"), F.count_if(F.col("state") == "unknown").alias("request_failures"))


def statistics(standards: DataFrame, paragraphs: DataFrame, units: DataFrame, candidates: DataFrame, decisions: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(section, name, value) of the whole statistics document of a run, as one table: totals, reasons, task types, coverage
    by standard and its concentration; with the requests also their outcomes."""
    staging = Staging(decisions.sparkSession, "statistics")
    rows = staging.put(report.decided(decisions))
    covered = staging.put(report.coverage(standards, paragraphs, units, rows))
    wide = lambda section, df: df.unpivot([], df.columns, "name", "value").select(F.lit(section).alias("section"), "name", "value")
    real = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    keyed = lambda section, df, key, value: df.select(F.lit(section).alias("section"), F.col(key).alias("name"), F.col(value).cast("double").alias("value"))
    planned = units.agg(F.count(F.lit(1)).alias("planned_units"), F.count_distinct("standard").alias("planned_standards"), F.sum("candidate_limit").alias("candidate_ceiling"))
    parts = [
        wide("totals", real(report.acceptance(rows, candidates))),
        wide("totals", real(planned)),
        wide("totals", real(candidates.agg(F.count_distinct("unit_id").alias("units_with_candidates")))),
        wide("totals", real(covered.agg(F.count_if(F.col("accepted") == 0).alias("zero_coverage_standards")))),
        wide("concentration", real(report.concentration(covered))),
        keyed("rejection_reasons", report.rejection_reasons(rows), "reason", "rejections"),
        keyed("task_types", report.accepted_by(rows, "task_type"), "task_type", "accepted"),
        keyed("accepted", covered, "standard", "accepted"),
        keyed("share", covered, "standard", "share"),
    ]
    if requests is not None:
        outcomes = unit_outcomes(units, requests, rows).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
        parts += [keyed("unit_outcomes", outcomes, "outcome", "n"), wide("requests", real(request_counts(requests)))]
    return reduce(DataFrame.unionByName, parts)


def fixture(units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Responses of the offline provider: (request, unit_id, response). Each unit's first focus paragraph becomes a question
    and its answer; the same unit gets the same response."""
    from vouchline.operators.planning import fixture_responses

    said = fixture_responses(units, paragraphs)
    one = F.struct("question", "answer", "task_type", F.array("paragraph_id").alias("paragraph_ids"))
    text = F.to_json(F.struct(F.array(one).alias("candidates"), F.lit(None).cast("string").alias("abstention_reason")), {"ignoreNullFields": "false"})
    response = F.to_json(F.struct(F.lit("end_turn").alias("stop_reason"), text.alias("text")))
    return said.select(F.sha2("unit_id", 256).alias("request"), "unit_id", response.alias("response"))


def run(responses: DataFrame, units: DataFrame, known: DataFrame, critic: DataFrame, judgements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, decisions) of a whole run: responses to envelopes to events to decisions, and these after near pairs."""
    staging = Staging(units.sparkSession, "run")
    happened = staging.put(events(envelopes(responses, units)))
    return happened, settled(decided(happened, units, known, critic), judgements)


def critic_of(results: DataFrame) -> DataFrame:
    """results(id, result: pass, fail, uncertain or nothing) -> (id, verdict): a result instead of a whole verdict counts
    as that of the criterion of support; of conflicting ones the worst. What is none of the three is malformed."""
    said = F.lower(F.trim("result"))
    verdict = F.when(said == "pass", F.array().cast("array<string>")).when(said.isin("fail", "uncertain"), F.array(F.concat(F.lit("semantic_supported_"), said))).otherwise(F.array(F.lit("malformed_critic_output")))
    return results.select("id", verdict.alias("verdict")).groupBy("id").agg(F.max("verdict").alias("verdict"))

