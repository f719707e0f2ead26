from __future__ import annotations

import json

from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_core import GOOD, SOURCE, paragraphs
from vouchline.functions.ident import digest_of
from vouchline.operators import pipeline, validate

UNITS = "id string, standard string, section_id string, document_id string, candidate_limit int, focus_ids array<string>"


def units(spark, *ids):
    return spark.createDataFrame([(i, "AS 1001", "s1", "doc:AS 1001", 2, ["AS1001.01"]) for i in ids], UNITS)


def response(candidates, abstention=None, stop="end_turn"):
    return json.dumps({"stop_reason": stop, "text": json.dumps({"candidates": candidates, "abstention_reason": abstention})})


def test_envelopes_become_events_with_ids_of_their_own(spark):
    data = [("r1", "u1", response([GOOD, dict(reversed(GOOD.items()))])), ("r2", "u2", response([], "nothing here")), ("r3", "u3", response([GOOD], stop="max_tokens")), ("r4", "u4", response([1, 2, 3])), ("r5", "u1", None), ("r6", "elsewhere", response([GOOD]))]
    df = spark.createDataFrame(data, "request string, unit_id string, response string")
    read = pipeline.envelopes(df, units(spark, "u1", "u2", "u3", "u4"))
    got = {r["request"]: (r["malformed"], r["abstention"]) for r in read.collect()}
    assert got == {"r1": (None, None), "r2": (None, "nothing here"), "r3": ("incomplete_model_response", None), "r4": ("invalid_candidate_count", None), "r5": ("incomplete_model_response", None)}
    happened = pipeline.events(read).collect()
    assert [r["unit_id"] for r in happened] == ["u1", "u1"] and all(json.loads(r["raw"]) == GOOD for r in happened)
    assert {r["id"] for r in happened} == {"candidate:" + digest_of(["r1", digest_of(GOOD), n]) for n in (0, 1)}
    assert pipeline.events(read.limit(0)).count() == 0


def test_requests_are_known_by_what_they_ask(spark):
    data = [("generate", "u1", '{"b": 1, "a": [0.5]}', "say", '{"m": 1e-05}'), ("generate", "u1", '{"a":[0.5],"b":1}', "say", '{"m":0.00001}'), ("generate", "u2", "{}", "say", "{}"), ("semantic", 'c"1', "{}", "say", "{}")]
    asked = pipeline.request_ids(spark.createDataFrame(data, "stage string, key string, payload string, prompt string, model string"))
    ids = [r["id"] for r in asked.collect()]
    assert ids[0] == ids[1] == digest_of(["generate", "u1", {"a": [0.5], "b": 1}, "say", {"m": 1e-05}]) and ids[3] == digest_of(["semantic", 'c"1', {}, "say", {}])
    answered = spark.createDataFrame([(ids[0], "complete"), (ids[2], "unknown")], "id string, state string")
    assert {r["id"]: r["blocked"] for r in pipeline.unanswered(asked, answered).collect()} == {ids[2]: True, ids[3]: False}


def test_a_run_from_candidates_to_records(spark):
    """An invalid first copy blocks nothing, later copies are duplicates, near pairs follow the critic's judgement and an
    unjudged one rejects both."""
    long = "Which notes does the lead auditor test again in the first week of the year"
    asked = {"a": "Who signs?", "b": "who  SIGNS?", "c": "Who signs?", "d": f"{long}?", "e": f"{long} now?", "f": "Who dates the long report of the year now?", "g": "Who dates the long report of the year?", "x": "Who?"}
    c = spark.createDataFrame([(i, json.dumps({**GOOD, "question": q, "answer": f"That {i}." , **({"paragraph_ids": ["AS2002.01"]} if i == "x" else {})}), "u1") for i, q in asked.items()] + [("a", json.dumps({**GOOD, "question": "Who signs?", "answer": "That a."}), "u1")], "id string, raw string, unit_id string")
    u, known = units(spark, "u1"), validate.evidence(paragraphs(spark, SOURCE))
    critic = pipeline.critic_of(spark.createDataFrame([("a", "fail"), *[(i, " Pass ") for i in "bcdefg"], ("b", "pass")], "id string, result string"))
    before = pipeline.decided(c, u, known, critic)
    ids = {r["candidate_id"]: r["record_id"] for r in before.collect()}
    judged = spark.createDataFrame([(ids["e"], ids["d"], "Duplicate.")], "left string, right string, result string")
    after = pipeline.settled(before, judged)
    got = {r["candidate_id"]: (r["status"], r["reasons"], r["duplicate_of"]) for r in after.collect()}
    loser, winner = sorted("de", key=lambda i: ids[i])[::-1]
    assert got["a"] == ("rejected", ["semantic_supported_fail"], None) and got["b"] == ("accepted", [], None) and got["c"] == ("rejected", ["exact_duplicate_question"], ids["b"])
    assert got[loser] == ("rejected", ["near_duplicate"], ids[winner]) and got[winner][0] == "accepted"
    assert got["f"] == got["g"] == ("rejected", ["near_duplicate_uncertain"], None) and got["x"][1] == ["unresolved_paragraph", "no_focus_evidence"] and ids["x"] is None
    kept = pipeline.accepted(after).collect()
    assert [r["id"] for r in kept] == sorted([ids["b"], ids[winner]]) and kept[0]["validation"]["deterministic_checks"] == list(pipeline.CHECKS)
    assert {r["candidate_id"] for r in pipeline.rejected(after, c).filter("raw is not null").collect()} == set(asked) - {"b", winner}
    assert pipeline.settled(pipeline.decided(c.limit(0), u, known, critic), judged).count() == 0
    requests = spark.createDataFrame([("u1", "generate", "complete"), ("u9", "generate", "unknown")], "key string, stage string, state string")
    found = rows(pipeline.gates(c.unionByName(c.limit(1).withColumn("id", F.lit("new"))), after.unionByName(after.filter("candidate_id = 'a'").withColumn("status", F.lit("accepted"))), units(spark, "u1", "u2"), requests))
    assert found == [("conflicting_decisions", "a"), ("unattempted_unit", "u2"), ("undecided_candidate", "new"), ("unresolved_request", "u9")]
    assert ("nothing_accepted", "run") in rows(pipeline.gates(c, after.filter("status = 'rejected'"), u, requests))


def test_seven_outcomes(spark):
    u = units(spark, *[f"u{i}" for i in range(7)])
    requests = spark.createDataFrame([("u1", "unknown", None, None), ("u2", "complete", "bad", None), ("u3", "complete", None, "none"), *[(f"u{i}", "complete", None, None) for i in (4, 5, 6)], ("u9", "not_submitted", None, None)], "key string, state string, malformed string, abstention string")
    decisions = spark.createDataFrame([("u4", "accepted"), ("u4", "rejected"), ("u5", "rejected"), ("u1", "accepted")], "unit_id string, status string")
    got = [r["outcome"] for r in pipeline.unit_outcomes(u, requests, decisions).orderBy("unit_id").collect()]
    assert got == ["unattempted", "failure", "malformed_response", "abstention", "accepted", "rejection", "pending"]
    assert tuple(pipeline.request_counts(requests).first()) == (1, 1, 1)


def test_the_offline_provider_runs_through(spark):
    p = paragraphs(spark, [("AS 1001", "s1", ".01", "The notes are tested."), ("AS 1001", "s2", ".02", "The file is kept.")])
    u = spark.createDataFrame([("u1", "AS 1001", "s1", "doc:AS 1001", 2, ["AS1001.01"]), ("u2", "AS 1001", "s2", "doc:AS 1001", 2, ["AS1001.02"])], UNITS)
    critic = spark.createDataFrame([], "id string, verdict array<string>")
    happened, decided = pipeline.run(pipeline.fixture(u, p), u, validate.evidence(p), critic, spark.createDataFrame([], "left string, right string, result string"))
    assert happened.count() == 2 and {tuple(r["reasons"]) for r in decided.collect()} == {("malformed_critic_output",)}
