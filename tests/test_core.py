from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vouchline.functions import text
from vouchline.functions.ident import digest_of
from vouchline.operators import audit, corpus, dedup, planning, report, validate
from vouchline.operators.skew import hot_keys, running_total, salted_join
from vouchline.plans import queries
from vouchline.shared import Staging
from vouchline.sources import tables


def paragraphs(spark, data):
    return spark.createDataFrame([(s, f"doc:{s}", sec, f"{s.replace(' ', '')}{n}", n, f"{s}{n}", t) for s, sec, n, t in data], "standard string, document_id string, section_id string, id string, number string, citation string, text string")


SOURCE = [("AS 1001", "s1", ".01", "one two three"), ("AS 1001", "s1", ".02", " "), ("AS 1001", "s2", ".03", "see paragraph .01"), ("AS 2002", "s3", ".01", "word " * 200), ("AS 2002", "s4", ".02", "")]


def test_running_total_is_exact_across_parts(spark):
    random.seed(1)
    data = [(random.choice("abc"), i, random.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, k int, v int")
    staging = Staging(spark, "test")
    got = {r["k"]: r["before"] for r in running_total(df, ["k"], "v", "before", staging, parts=7).collect()}
    total = 0
    for _, k, v in data:
        assert got[k] == total
        total += v
    inner = {r["k"]: r["before"] for r in running_total(df, ["k"], "v", "before", staging, within="g", parts=7).collect()}
    sums = dict.fromkeys("abc", 0)
    for g, k, v in data:
        assert inner[k] == sums[g]
        sums[g] += v


def test_salted_join_equals_a_join(spark):
    many = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    one = spark.createDataFrame([("hot", "H"), ("k3", "3"), ("zz", "z")], "k string, v string")
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "k", 300, parts=10)
    assert rows(hot.select("k")) == [("hot",)]
    for how in ("inner", "left"):
        got = salted_join(many, one, "k", hot, F.xxhash64("i"), how).select("k", "i", "v")
        assert rows(got) == rows(many.join(one, "k", how).select("k", "i", "v"))


def test_corpus(spark):
    p = paragraphs(spark, SOURCE)
    s = spark.createDataFrame([("AS 1001", "A", "u", "h1", 3), ("AS 2002", "B", "u", "h2", 2), ("AS 3003", "C", "u", "h3", 0)], "as_number string, title string, url string, source_sha256 string, paragraphs int")
    assert rows(corpus.blank_issues(p)) == [("AS 1001", "AS1001.02", "empty_source_text"), ("AS 2002", "AS2002.02", "empty_source_text")]
    assert rows(corpus.standard_words(p)) == [("AS 1001", 6), ("AS 2002", 200)]
    assert rows(corpus.violations(s, p)) == [("inventory", "AS 3003")]
    assert rows(corpus.search(p, " THREE ").select("as_number", "paragraph")) == [("AS 1001", ".01")]
    assert corpus.search(p, "%").count() == 0
    with pytest.raises(ValueError):
        corpus.search(p, " ")
    assert rows(corpus.lookup(s, ["2002", "9999", "x"])) == [("2002", "AS 2002", "B"), ("9999", "AS 9999", None), ("x", None, None)]
    nested = corpus.nested(s, p)
    flat = corpus.flattened(nested)
    assert flat.count() == 5 and rows(flat.filter("heading = 's2'").select("section_pos", "number")) == [(1, ".03")]
    index = corpus.reference_index(nested)
    assert "text" not in index.schema.simpleString()
    assert corpus.changed(index, index).count() == 0
    other = corpus.reference_index(corpus.nested(s.withColumn("source_sha256", F.lit("x")), p))
    assert corpus.changed(index, other).count() == 6
    assert corpus.rendered(nested).filter("as_number = 'AS 3003'").first()["text"] == "AS 3003: C\n\nSource: u\n"
    assert corpus.summary(s, p).first()["paragraphs"] == 5


def test_units(spark):
    got = {r["section_id"]: r for r in planning.units(paragraphs(spark, SOURCE)).collect()}
    assert set(got) == {"s1", "s2", "s3"}
    assert got["s1"]["focus_ids"] == ["AS1001.01"] and got["s1"]["words"] == 3 and got["s1"]["features"]["multi_paragraph"]
    assert got["s2"]["features"]["cross_references"] and not got["s1"]["features"]["cross_references"]
    assert got["s3"]["candidate_limit"] == 2 and got["s3"]["features"]["length"] == "medium"
    unit = got["s1"].asDict(recursive=True)
    assert unit.pop("id") == "unit:" + digest_of(unit)


def test_unit_order_obeys_the_rule(spark):
    """Read back from the result: in every place no unit of the standard was to be preferred, and in every round each
    standard with units left has one, the less covered quartiles before the others."""
    random.seed(4)
    data = [(f"AS {1000 + random.randint(0, 6)}", f"s{i}", f".{i:02d}", "w " * random.choice([5, 300, 900]) + random.choice(["", "paragraph"])) for i in range(30)]
    planned = planning.units(paragraphs(spark, data))
    units = {r["id"]: r.asDict(recursive=True) for r in planned.collect()}
    order = [units[r["id"]] for r in planning.ordered(planned, 7).orderBy("position").collect()]
    assert len(order) == len(units) == len({u["id"] for u in order})
    traits = lambda u: set(u["features"].items())
    for place, unit in enumerate(order):
        before = [t for u in order[:place] for t in traits(u)]
        rank = lambda u: (sum(before.count(t) for t in traits(u)), digest_of([7, u["id"]]))  # noqa: B023, E731
        assert rank(unit) == min(rank(u) for u in order[place:] if u["standard"] == unit["standard"])
    turns, place = max(sum(u["standard"] == s for u in order) for s in {u["standard"] for u in order}), 0
    for turn in range(turns):
        due = {s for s in {u["standard"] for u in order} if sum(u["standard"] == s for u in order) > turn}
        round_ = order[place : place + len(due)]
        covered = [u["features"]["standard_quartile"] for u in order[:place]]
        keys = [(covered.count(u["features"]["standard_quartile"]), digest_of([7, u["standard"]])) for u in round_]
        assert {u["standard"] for u in round_} == due and keys == sorted(keys)
        place += len(due)


def test_pilot_takes_turns(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 2), ("d", 3, 3), ("e", 3, 4)], "id string, quartile int, position int")
    assert [r["id"] for r in planning.pilot(df, 4).orderBy("place").collect()] == ["a", "c", "d", "b"]


GOOD = {"question": "What?", "answer": "That.", "task_type": "definition", "paragraph_ids": ["AS1001.01"]}


@pytest.mark.parametrize(
    ("change", "reason"),
    [({}, None), ([], "candidate_not_object"), ({"split": 1}, "unexpected_fields"), ({"answer": " "}, "empty_or_invalid_answer"), ({"question": 3}, "empty_or_invalid_question"), ({"question": "a\x01"}, "control_characters"), ({"task_type": "x"}, "unknown_task_type"), ({"paragraph_ids": ["a", "a"]}, "invalid_paragraph_ids"), ({"footnote_ids": None}, "invalid_footnote_ids"), ({"paragraph_ids": []}, "missing_paragraph_evidence"), ({"reasoning_tags": ["x"]}, "unknown_reasoning_tag"), ({"question": None, "answer": ""}, "empty_or_invalid_question")],
)
def test_schema_reasons(spark, change, reason):
    raw = json.dumps({**GOOD, **change} if isinstance(change, dict) else change)
    df = spark.createDataFrame([(raw, "missing_fields")], "raw string, other string").select(validate.schema_reason(F.col("raw")), validate.schema_reason(F.lit('{"question": "q"}')))
    assert tuple(df.first()) == (reason, "missing_fields")


def test_only_whole_json_is_read(spark):
    good = json.dumps(GOOD)
    texts = [good, f"  {good}\n", good + " x", good + "]", good + "}", good + "]{}", good + "}{}", good + "," + good, "", " ", None, "null", "{", good[:-1] + ', "answer": "again"}', good.replace('"That."', "NaN")]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "raw string").select(validate.schema_reason(F.col("raw"))).collect()]
    assert got == [None, None] + ["candidate_not_object"] * 13


def test_evidence_reasons(spark):
    p = paragraphs(spark, SOURCE)
    units = spark.createDataFrame([("u1", "AS 1001", ["AS1001.01"])], "id string, standard string, focus_ids array<string>")
    cases = {"good": GOOD, "foreign": {**GOOD, "paragraph_ids": ["AS2002.01"]}, "blank": {**GOOD, "paragraph_ids": ["AS1001.01", "AS1001.02"]}, "cites": {**GOOD, "answer": "as 2002 and AS 1001.99"}, "note": {**GOOD, "footnote_ids": ["f"]}, "bad": []}
    c = spark.createDataFrame([(k, "u1", json.dumps(v)) for k, v in cases.items()] + [("null", "u1", None), ("good", "u1", json.dumps(GOOD))], "id string, unit_id string, raw string")
    read = validate.parsed(c)
    got = {r["id"]: r["reasons"] for r in validate.evidence_reasons(read, units, validate.evidence(p)).collect()}
    assert got == {"good": [], "foreign": ["unresolved_paragraph", "no_focus_evidence"], "blank": ["empty_source_evidence"], "cites": ["cross_standard_citation", "invalid_inline_citation"], "note": ["unresolved_footnote"], "bad": ["candidate_not_object"], "null": ["candidate_not_object"]}
    known, cited = validate.evidence(p), validate.cited(read, units)
    assert rows(validate.unresolved(cited, known).select("id", "evidence_id")) == [("foreign", "AS2002.01"), ("note", "f")]
    assert [x["id"] for x in validate.support(cited, known).filter("id = 'blank'").first()["support"]] == ["AS1001.01", "AS1001.02"]


def test_envelopes_and_verdicts(spark):
    one = json.dumps({"candidates": [1], "abstention_reason": None})
    cases = [(2, one, None), (0, one, "invalid_candidate_count"), (2, "{", "malformed_generation_envelope"), (2, '{"candidates": [], "abstention_reason": " "}', "missing_abstention_reason"), (2, '{"candidates": [1], "abstention_reason": "x"}', "contradictory_abstention"), (2, '{"candidates": [], "abstention_reason": "x"}', None)]
    df = spark.createDataFrame([c[:2] for c in cases], "n int, t string")
    assert [r[0] for r in df.select(validate.envelope_reason(F.col("n"), F.col("t"))).collect()] == [c[2] for c in cases]
    sound = {k: {"result": "pass", "reason": "r", "evidence_ids": ["e"]} for k in validate.CRITERIA}
    doubt = {**sound, "supported": {"result": "uncertain", "reason": "r", "evidence_ids": []}, "complete": {"result": "fail", "reason": "r", "evidence_ids": []}}
    bare = {**sound, "answerable": {"result": "pass", "reason": "r", "evidence_ids": []}}
    foreign = {**sound, "answerable": {"result": "pass", "reason": "r", "evidence_ids": ["z"]}}
    wants = [(sound, []), (doubt, ["semantic_supported_uncertain", "semantic_complete_fail"]), (bare, ["critic_missing_evidence"]), (foreign, ["malformed_critic_output"]), ({}, ["malformed_critic_output"])]
    df = spark.createDataFrame([(json.dumps({"checks": c}), ["e"]) for c, _ in wants], "t string, k array<string>")
    assert [r[0] for r in df.select(validate.verdict_reasons(F.col("t"), F.col("k"))).collect()] == [w for _, w in wants]
    df = spark.createDataFrame([('{"a": [{"train": 1}]}',), ('{"a": "train"}',), (None,)], "t string")
    assert [r[0] for r in df.select(validate.forbidden_keys(F.col("t"))).collect()] == [True, False, False]


def test_first_valid_equals_the_sequence(spark):
    random.seed(3)
    events = [(f"e{i:03d}", random.choice("abcd"), random.random() < 0.4, f"r{i}") for i in range(80)]
    got = {r["id"]: r["duplicate_of"] for r in dedup.first_valid(spark.createDataFrame(events, "id string, question_key string, valid boolean, record_id string")).collect()}
    seen: dict = {}
    for one, key, valid, record in events:
        assert got[one] == seen.get(key)
        if valid:
            seen.setdefault(key, record)


def test_near_duplicates_stay_first_valid(spark, tmp_path):
    said = [("a1", "x", ["near_duplicate"]), ("a2", "x", None), ("b1", "y", ["Near-Duplicate-Uncertain ", "NEAR DUPLICATE"]), ("b2", "y", ["exact_duplicate_question"]), ("c1", "z", ["near_duplicate", "no_focus_evidence"]), ("c2", "z", []), ("c3", "z", []), ("d1", "w", [None]), ("d2", "w", [])]
    spark.createDataFrame([(i, "u", json.dumps({**GOOD, "question": q})) for i, q, _ in said], "id string, unit_id string, raw string").write.parquet(str(tmp_path / "candidates.parquet"))
    spark.createDataFrame([(i, r, (f"qa:{i}",)) for i, _, r in said], "candidate_id string, reasons array<string>, record struct<id: string>").write.parquet(str(tmp_path / "decisions.parquet"))
    assert rows(queries.QUERIES["exact_dup_first_valid"](spark, str(tmp_path))) == [("a2", "qa:a1"), ("b2", "qa:b1"), ("c3", "qa:c2")]


def test_near_pairs_equal_all_pairs(spark):
    random.seed(5)
    vocabulary = ["the", "of", "a", *[f"w{i}" for i in range(40)]]
    base = [[random.choice(vocabulary) for _ in range(random.randint(1, 14))] for _ in range(25)]
    said = [" ".join(b) for b in base] + [" ".join(random.choice(vocabulary) if random.random() < 0.15 else w for w in random.choice(base)) for _ in range(60)] + ["", "?!", base[0][0]]
    data = [(f"q{i:03d}", s) for i, s in enumerate(said)]
    df = spark.createDataFrame(data, "id string, question string")
    got = {(r["left"], r["right"]): (r["unigram"], r["bigram"]) for r in dedup.near_pairs(dedup.token_sets(df, text.folded(F.col("question")))).collect()}
    want = {}
    sets = {i: (set(s.split()) - {"?!"}, set(zip(s.split(), s.split()[1:], strict=False))) for i, s in data}
    for a in sets:
        for b in sets:
            if a < b:
                scores = tuple(len(x & y) / len(x | y) if x | y else 0.0 for x, y in zip(sets[a], sets[b], strict=True))
                if scores[0] >= 0.7 or scores[1] >= 0.5:
                    want[a, b] = scores
    assert got == want and want


def test_near_pairs_meet_only_where_they_can(spark, monkeypatch):
    """Blocks in slabs and tiles give what rows one after another give, and few rows of a common word meet: of these questions
    every two share words of their prefixes, but only the last two of a group can be near."""
    random.seed(8)
    said = [" ".join([*(f"g{i // 3}n{k}" for k in range(i % 3 * 9, 9 if i % 3 == 0 else 18)), *(f"c{random.randrange(8)}x{k}" for k in range(12)), "all"]) for i in range(240)]
    said += [" ".join(f"c{random.randrange(2)}x{k}" for k in range(12)) for _ in range(60)]
    df = spark.createDataFrame([(f"q{i:03d}", s) for i, s in enumerate(said)], "id string, question string")
    sets = dedup.token_sets(df, F.col("question"))
    seen = []
    for short, slab, wide, tile, held in ((256, 64, 4096, 1 << 17, 200_000), (4, 3, 5, 16, 50)):
        for name, value in (("SHORT", short), ("SLAB", slab), ("WIDE", wide), ("TILE", tile), ("HELD", held)):
            monkeypatch.setattr(dedup, name, value)
        seen.append(rows(dedup.near_pairs(sets)))
    words = {f"q{i:03d}": s.split() for i, s in enumerate(said)}
    want = []
    for a in words:
        for b in words:
            if a < b:
                both = [(set(words[a]), set(words[b])), *[tuple(set(zip(words[x], words[x][1:], strict=False)) for x in (a, b))]]
                uni, bi = (len(x & y) / len(x | y) for x, y in both)
                if uni >= 0.7 or bi >= 0.5:
                    want.append((a, b, uni, bi))
    assert seen[0] == seen[1] == sorted(want, key=repr) and want
    # The same for the rows of blocks as such, on either side of a split block or not.
    draw = np.random.default_rng(1)
    made = np.stack([draw.integers(0, 3, 900), draw.integers(0, 3, 900), draw.integers(8, 14, 900), draw.integers(0, 5, 900)])
    block, side, n, at = made[:, np.lexsort(made[::-1])]
    k = [draw.integers(0, 1 << 8, 900) for _ in "01"]
    met = []
    for short, slab, wide in ((1000, 64, 4096), (4, 3, 5)):
        for name, value in (("SHORT", short), ("SLAB", slab), ("WIDE", wide)):
            monkeypatch.setattr(dedup, name, value)
        met.append(sorted(tuple(sorted(p)) for l, r in dedup._Rows([block, side, n, at, np.arange(900), *k], 0.5).pairs() for p in zip(l.tolist(), r.tolist(), strict=True)))
    assert met[0] == met[1] and met[0]
    # One word that 2,000 sets of 30 words hold at their twelfth place: none of the two million pairs can reach the threshold.
    at = np.full(2000, 11, np.int32)
    columns = [np.zeros(2000, np.int64), np.full(2000, 2, np.int8), np.full(2000, 30, np.int32), at, np.arange(2000), np.zeros(2000, np.int64), np.zeros(2000, np.int64)]
    assert sum(len(l) for l, _ in dedup._Rows(columns, 0.7).pairs()) == 0
    # Parities whose highest bit is set count like others.
    columns = [np.zeros(2, np.int64), np.full(2, 2, np.int8), np.full(2, 30, np.int32), np.zeros(2, np.int32), np.arange(2), np.array([-1, -2]), np.array([-1, -1])]
    assert sum(len(l) for l, _ in dedup._Rows(columns, 0.7).pairs()) == 1


def test_resolution_equals_the_sequence(spark):
    random.seed(6)
    for size, n in ((6, 12), (30, 60), (12, 50)):
        pairs = {}
        for _ in range(n):
            a, b = sorted(random.sample(range(size), 2))
            pairs[f"r{a:02d}", f"r{b:02d}"] = random.choice(["duplicate", "distinct", "uncertain"])
        pairs.update({(f"r{i:02d}", f"r{i + 1:02d}"): "duplicate" for i in range(0, size - 1, 2)})
        df = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "left string, right string, result string")
        got, again = ({r["record"]: (r["reason"], r["duplicate_of"]) for r in dedup.resolved(df, few).collect()} for few in (dedup.FEW, size // 6))
        want: dict = {}
        for left, right in sorted(pairs, key=lambda p: (p[1], p[0])):
            if left in want or right in want:
                continue
            if pairs[left, right] == "duplicate":
                want[right] = ("near_duplicate", left)
            elif pairs[left, right] == "uncertain":
                want[left] = want[right] = ("near_duplicate_uncertain", None)
        assert got == want == again
    assert dedup.resolved(spark.createDataFrame([], "left string, right string, result string")).count() == 0


def test_recorded_pairs_in_any_order_and_spelling(spark):
    data = [("b", "a", "duplicate"), ("C ", " a", "Duplicate.\n"), ("a", "d", "duplicate?"), ("e", "a", None), ("f", "a", "not duplicate"), ("a", "g", "distinct ."), ("g", "a", None), ("h", "i", "distinct"), ("i", "h", "uncertain"), ("h", "i", "duplicate"), ("j", "J ", "duplicate"), (None, "a", "duplicate")]
    got = rows(dedup.recorded(spark.createDataFrame(data, "left string, right string, result string")))
    assert got == [("a", "b", "duplicate"), ("a", "c", "duplicate"), ("a", "d", "uncertain"), ("a", "e", "uncertain"), ("a", "f", "uncertain"), ("a", "g", "distinct"), ("h", "i", "uncertain")]


def test_near_resolve_reads_every_row(spark, tmp_path):
    data = [("q", "p", "duplicate"), ("r", "s", " DUPLICATE."), ("t", "u", "duplicate?"), ("v", "w", "distinct.")]
    spark.createDataFrame(data, "left string, right string, result string").write.parquet(str(tmp_path / "duplicates.parquet"))
    got = rows(queries.QUERIES["near_resolve"](spark, str(tmp_path)))
    assert got == sorted([("q", "near_duplicate", "p"), ("s", "near_duplicate", "r"), ("t", "near_duplicate_uncertain", None), ("u", "near_duplicate_uncertain", None)], key=repr)


def decisions(spark, n=80):
    random.seed(2)
    kind = "struct<id: string, schema_version: int, task_type: string, group_key: string, document_id: string, complexity: struct<supporting_paragraphs: int, scenario: boolean, synthesis: boolean>>"
    data = []
    for i in range(n):
        ok = i % 4 != 0
        record = (f"qa:{i}", 1, random.choice(["definition", "scenario"]), "AS 1001", "doc:AS 1001", (1, False, False)) if i % 10 else None
        data.append((f"c{i:02d}", f"u{i % 7}", f"AS {1001 + i % 5}", "s1", "accepted" if ok else "rejected", None, None if ok else random.choice([["x"], ["x", "y"], []]), record))
    return spark.createDataFrame(data, f"candidate_id string, unit_id string, standard string, section_id string, status string, duplicate_of string, reasons array<string>, record {kind}")


def test_review_sample_equals_the_rule(spark):
    rows_ = report.decided(decisions(spark))
    got = [r["candidate_id"] for r in report.review_sample(rows_, 40, 42).orderBy("place").collect()]
    full = rows_.withColumn("s2", F.coalesce(F.to_json("complexity"), F.lit("{}"))).withColumn("s3", F.to_json("reasons")).collect()
    used: dict = {}
    want, left = [], list(full)

    def draw(allowed):
        pool = [r for r in left if r["status"] in allowed]
        if not pool:
            return False
        best = min(pool, key=lambda r: (used.get(r["standard"], 0), used.get((1, r["task_type"]), 0) + used.get((2, r["s2"]), 0) + used.get((3, r["s3"]), 0), digest_of([42, r["candidate_id"]])))
        left.remove(best)
        want.append(best["candidate_id"])
        for k in (best["standard"], (1, best["task_type"]), (2, best["s2"]), (3, best["s3"])):
            used[k] = used.get(k, 0) + 1
        return True

    for status, aim in (("accepted", 30), ("rejected", 10)):
        for _ in range(aim):
            draw((status,))
    while len(want) < 40 and draw(("accepted", "rejected")):
        pass
    assert got == want and len(got) == 40
    assert "<b>" not in report.as_html([{"a": "<b>&"}], "t") and report.as_html([], "t")


def test_report_guards_zero(spark):
    none = report.decided(decisions(spark).limit(0))
    p = paragraphs(spark, SOURCE)
    s = spark.createDataFrame([("AS 1001",), ("AS 3003",)], "as_number string")
    u = spark.createDataFrame([("u1", "AS 1001", 3)], "id string, standard string, candidate_limit int")
    covered = report.coverage(s, p, u, none)
    assert rows(covered.select("standard", "accepted", "share", "planned_units")) == [("AS 1001", 0, 0.0, 1), ("AS 3003", 0, 0.0, 0)]
    assert report.concentration(covered).first()["concentration_flag"] is False
    one = report.acceptance(none, spark.createDataFrame([], "id string")).first()
    assert one["acceptance_rate"] == 0 and one["pending"] == 0
    assert rows(report.uncovered(s, report.decided(decisions(spark)))) == [("AS 3003",)]


def test_findings(spark):
    d = decisions(spark)
    c = spark.createDataFrame([(r["candidate_id"], "{}") for r in d.collect()] + [("extra", '{"split": 1}'), ("c01", "{}")], "id string, raw string")
    u = spark.createDataFrame([(f"u{i}", "AS 1001", "doc:AS 1001") for i in range(7)], "id string, standard string, document_id string")
    pairs = spark.createDataFrame([("qa:1 ", "QA:2"), ("qa:1", "qa:unknown")], "left string, right string")
    got = {r["code"]: r["subjects"] for r in audit.findings(c, d, u, pairs).collect()}
    assert got["duplicate_candidate_ids"] == 1 and got["missing_candidate_decisions"] == 1 and got["split_fields_present"] == 1 and got["pair_of_unknown_record"] == 1
    assert "invalid_decision" not in got and got["group_mismatch"] > 0


def test_findings_check_accepted_pairs_and_evidence_again(spark):
    asked = ["Which notes does the lead auditor test again?", "Which notes does the lead auditor test again now?", "Which notes does the lead auditor test again here?", "Who signs?", "Who dates the report?"]
    c = spark.createDataFrame([(f"c{i}", "u1", json.dumps({**GOOD, "question": q, "paragraph_ids": ["AS1001.01" if i < 4 else "AS2002.01"]})) for i, q in enumerate(asked)] + [("c5", "u1", "{}"), ("c6", "u1", "{}")], "id string, unit_id string, raw string")
    data = [(f"c{i}", "u1", "AS 1001", "accepted" if i < 6 else "rejected", None, (f"qa:{i}", "AS 1001", "doc:AS 1001")) for i in range(7)]
    d = spark.createDataFrame(data, "candidate_id string, unit_id string, standard string, status string, duplicate_of string, record struct<id: string, group_key: string, document_id: string>")
    u = spark.createDataFrame([("u1", "AS 1001", "doc:AS 1001", ["AS1001.01"])], "id string, standard string, document_id string, focus_ids array<string>")
    p = paragraphs(spark, SOURCE)
    codes = lambda *pairs: {r["code"]: r["subjects"] for r in audit.findings(c, d, u, spark.createDataFrame(pairs, "left string, right string, result string"), p).collect()}
    assert codes(("qa:0", "qa:1", "duplicate"), ("QA:2 ", "qa:0", "Distinct.")) == {"unresolved_accepted_duplicate": 2, "deterministic_failure": 2}
    assert codes(("qa:1", "qa:0", "distinct"), ("qa:0", "qa:2", "distinct"), ("qa:2", "qa:1", "distinct")) == {"deterministic_failure": 2}


def test_row_files(spark, tmp_path):
    odd = "a b\u0085c"
    df = spark.createDataFrame([("l", "r", 0.5, None, odd, None, "q")], tables.DUPLICATE)
    where = str(tmp_path / "rows")
    tables.write_rows(df, where)
    assert rows(tables.read_rows(spark, where, tables.DUPLICATE)) == rows(df)
    assert tables.file_hashes(spark, where).count() >= 1
    (tmp_path / "v" / "2026-01").mkdir(parents=True)
    (tmp_path / "v" / "2026-02").mkdir()
    (tmp_path / "v" / "2026-02" / "manifest.json").write_text("{}")
    assert tables.versions(spark, str(tmp_path / "v")) == ["2026-02"] and tables.versions(spark, str(tmp_path / "none")) == []
