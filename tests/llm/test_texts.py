"""Tokens, mixing, sampling, defects and stuffed pages."""

from __future__ import annotations

import json
import os
import random
from collections import Counter
from math import ceil, floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tests.conftest import rows
from vouchline.llm import defects, mixing, sampling, stuffing, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="needs the public vocabularies")


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.model_bytes(tokens.read_ranks(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")))


@pytest.fixture(scope="module")
def plain():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens.read_ranks(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"), special_tokens={})


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_is_that_of_the_ranks_and_goes_back(encoder, plain, text):
    ids = encoder.encode(text)
    assert ids == plain.encode_ordinary(text)
    assert encoder.decode(ids) == text


@needs_vocabulary
def test_encoded_documents(spark):
    data = [(1, "a <|endoftext|> b", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 30_000, "x"), (4, "word " * 30_000, "x"), (None, "▁\x00", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = tokens.encoded(df)
    by = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert got.count() == 6 and by[2] == [] == by[3] and 50256 not in by[1] and len(by[4]) == 30_001
    back = {r["doc_id"]: r["text"] for r in tokens.decoded(got).collect()}
    assert back == {d: t or "" for d, t, _ in data}
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.sized(df).collect()}
    assert sizes == {d: len(i) for d, i in by.items()}
    assert tokens.encoded(df.limit(0)).count() == 0


def test_model_refuses_gaps():
    with pytest.raises(ValueError):
        tokens.model_bytes({b"a": 0, b"b": 2})


def test_schedule_deviates_by_less_than_a_block():
    random.seed(1)
    for _ in range(30):
        given_ = {f"s{i}": random.randint(0, 5000) for i in range(random.randint(1, 9))}
        total = sum(given_.values())
        block = max(1, ceil(total / 200))
        plan = mixing.schedule(given_, block)
        assert len({slot for _, _, slot in plan}) == len(plan)
        done: Counter = Counter()
        for source, k, slot in sorted(plan, key=lambda x: x[2]):
            assert k == done[source]
            done[source] += 1
            if slot < total // block:
                assert all(abs(done[s] - n / total * (slot + 1)) < 1 + 1e-9 for s, n in given_.items())
        assert all(done[s] == -(-n // block) for s, n in given_.items())


def test_filling_respects_caps():
    got = mixing.filled({"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3), "d": (0.0, 1)}, {"a": 100, "b": 1000, "c": 1000}, 1000)
    assert got["a"] == 100 and got["d"] == 0 and got["b"] == 540 and got["c"] == 360
    assert mixing.filled({"a": (1.0, 2)}, {}, 0) == {"a": 0}


@needs_vocabulary
def test_mix(spark):
    random.seed(2)
    data = [(i, " ".join(["word"] * random.randint(1, 40)), s) for i, s in enumerate(["big"] * 200 + ["Small One"] * 10 + [" small-one "] * 10 + [None] * 5)] + [(900, None, "big"), (901, "", "big"), (5, "again and again", "BIG")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string").selectExpr("*", "1 as key", "2 as n_tokens")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small_one", 0.4, 3), ("none_there", 0.1, 9)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(docs, targets)
    report = {r["source"]: r for r in mix.report().collect()}
    assert {s for s, r in report.items() if r["short"]} == {"small_one", "none_there"} == {r[0] for r in mixing.found(docs, targets).collect()}
    got = mix.rows().toPandas()
    assert got[got.source == "small_one"].groupby("doc_id")["pass"].nunique().max() <= 3
    assert got.groupby("source").n_tokens.sum().to_dict() == {s: r["mixed_tokens"] for s, r in report.items() if r["mixed_tokens"]}
    assert mixing.Mix(docs.limit(0), targets).rows().count() == 0
    assert mixing.Mix(docs, targets.limit(0)).rows().count() == 0 == mixing.found(docs, targets.limit(0)).count()


@needs_vocabulary
def test_mix_stays_within_a_block_of_its_shares(spark, monkeypatch):
    """Also with documents longer than a block; parts join up to whole documents in the order of slot and place."""
    monkeypatch.setattr(mixing, "BLOCKS", 40)
    random.seed(3)
    data = [(i, " ".join(["word"] * random.choice([1, 5, 20, 400])), random.choice("aabbbc")) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.3, 1), ("c", 0.2, 9)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(docs, targets)
    got = mix.rows().toPandas().sort_values(["slot", "at"])
    assert max(len(t.split()) for _, t, _ in data) > mix.block
    ends = got["at"] + got.n_tokens
    assert (got["at"].groupby(got.slot).min() == 0).all() and ends.max() <= mix.block and (ends.groupby(got.slot).shift(fill_value=0) == got["at"]).all()
    total, done, mixed = sum(mix.given.values()), Counter(), 0
    for _, part in got.groupby("slot"):
        for s, n in part.groupby("source").n_tokens.sum().items():
            done[s] += n
            mixed += n
        assert all(abs(done[s] - mixed * n / total) <= mix.block * 1.5 for s, n in mix.given.items())
    whole = got.groupby(["source", "pass", "doc_id"]).agg(n=("n_tokens", "sum"), first=("first_token", "min"))
    sizes = {r["doc_id"]: r["n_tokens"] for r in mix.sizes.collect()}
    cut = sum(n != sizes[doc] for (_, _, doc), n in whole.n.items())
    assert (whole["first"] == 0).all() and cut <= len(mix.given)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 5)), st.floats(0, 30, allow_nan=False), max_size=25))
def test_rounding_keeps_both_margins(table):
    got = sampling.rounded(table)
    near = lambda n, x: floor(x + 1e-9) <= n <= ceil(x - 1e-9)
    assert set(got) == set(table) and all(near(got[k], x) for k, x in table.items())
    for side in (0, 1):
        for key in {k[side] for k in table}:
            assert near(sum(n for k, n in got.items() if k[side] == key), sum(x for k, x in table.items() if k[side] == key))


def sampled(spark, decisions, targets):
    d = spark.createDataFrame(decisions, "candidate_id string, standard string, reasons array<string>, record struct<task_type: string>").selectExpr("*", "1 as id", "'x' as task", "3 as target_id")
    t = spark.createDataFrame(targets, "target_id int, plan_id int, standard string, task_type string, reason string, target_share double, min_rows int, sample_fraction double").selectExpr("*", "1 as n", "2 as share")
    return d, t, spark.createDataFrame([("OB 1", "AS 1001")], "former_label string, as_number string")


def test_sample(spark):
    random.seed(5)
    decisions = [(f"c{i}", random.choice(["AS 1001", "as-1001", "OB-1", "AS 2002", None]), random.choice([None, [], ["x-Y"], ["X_y", "z"], [None]]), random.choice([None, ("Definition ",), ("scenario",), (None,)])) for i in range(400)]
    targets = [(1, 1, "AS 1001", None, None, 0.6, 2, 0.5), (2, 1, "AS 2002", None, None, 0.4, 2, 0.5), (3, 2, None, "definition", None, 0.3, 1, 0.2), (4, 2, None, "malformed", None, 0.7, 1, 0.2), (5, 3, None, None, "x_y", 0.5, 1, 0.3), (6, 3, None, None, "z", 0.3, 1, 0.3), (7, 3, None, None, "never", 0.2, 1, 0.3), (8, 4, None, None, None, 1.0, 1, 0.1), (9, 5, "AS 2002", "scenario", "z", 0.0, 999, 0.1)]
    d, t, former = sampled(spark, [*decisions, *decisions[:9]], targets)
    sample = sampling.Sample(d, t, former)
    report = {r["target_id"]: r for r in sample.report().collect()}
    first = lambda s: s in ("AS 1001", "as-1001", "OB-1")
    assert report[1]["available"] == sum(first(s) for _, s, _, _ in decisions)
    assert report[4]["available"] == sum(r is None for *_, r in decisions) and report[8]["available"] == 400
    assert {k for k, r in report.items() if r["short"]} == {r[0] for r in sampling.found(d, t, former).collect()} >= {7, 9}
    got = sample.rows().toPandas()
    assert not got.duplicated(["plan_id", "candidate_id"]).any()
    assert got.groupby("target_id").size().to_dict() == {k: r["quota"] for k, r in report.items() if r["quota"]}
    assert got[got.plan_id == 8 - 4].shape[0] == 40
    assert rows(sample.rows()) == rows(sampling.Sample(d, t, former).rows())
    d, t, former = sampled(spark, [], targets)
    assert sampling.Sample(d, t, former).rows().count() == 0
    d, t, former = sampled(spark, decisions[:3], [])
    assert sampling.found(d, t, former).count() == 0


def test_overlapping_categories_share_their_decisions(spark):
    """All decisions are in both categories: each still gets what it asks for; asking for more than there is is reported."""
    decisions = [(f"c{i}", "AS 1001", ["x", "y"], ("definition",)) for i in range(100)]
    targets = [(1, 1, None, None, "x", 0.5, 10, 0.5), (2, 1, None, None, "y", 0.5, 10, 0.5), (3, 2, None, None, "x", 0.5, 80, 1.0), (4, 2, None, None, "y", 0.5, 60, 1.0)]
    d, t, former = sampled(spark, decisions, targets)
    sample = sampling.Sample(d, t, former)
    report = {r["target_id"]: r for r in sample.report().collect()}
    assert report[1]["quota"] == report[2]["quota"] == 25 and not any(report[i]["short"] or report[i]["unmet"] for i in (1, 2))
    assert report[3]["quota"] + report[4]["quota"] == 100 and report[3]["unmet"] | report[4]["unmet"] and not report[3]["short"]
    plans = {r["plan_id"]: r for r in sample.plans().collect()}
    assert (plans[1]["wanted"], plans[1]["reached"], plans[1]["unmet"]) == (50, 50, 0) and (plans[2]["reached"], plans[2]["unmet"]) == (100, 1 + (report[3]["unmet"] and report[4]["unmet"]))
    got = sample.rows().toPandas()
    assert not got.duplicated(["plan_id", "candidate_id"]).any() and got.groupby("target_id").size().to_dict() == {k: r["quota"] for k, r in report.items()}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.frozensets(st.integers(0, 4), min_size=1).map(lambda s: tuple(sorted(s)))), st.integers(1, 30), max_size=12), st.lists(st.floats(0, 40), min_size=5, max_size=5))
def test_sharing_out_gives_as_much_as_can_be_given(supply, amounts):
    asked = dict(enumerate(amounts))
    got = sampling.shared_out(supply, asked)
    per = lambda i: {k: sum(n for key, n in got.items() if key[i] == k) for k in {key[i] for key in got}}
    assert all(n <= supply[k] + 1e-6 for k, n in per(1).items()) and all(n <= asked[t] + 1e-6 for t, n in per(0).items())
    # The most that can be given, by the smallest cut: of each set of categories, what they ask or what their kinds have.
    most = min(sum(asked[t] for t in asked if not cut >> t & 1) + sum(n for k, n in supply.items() if any(cut >> t & 1 for t in k[-1])) for cut in range(32))
    assert abs(sum(got.values()) - most) < 1e-6
    whole = sampling.rounded({(t, k[0], k[1]): n for (t, k), n in got.items()}, supply)
    for k, n in supply.items():
        assert sum(q for (_, *kind), q in whole.items() if tuple(kind) == k) <= n


ASK = "Which duties over aged credit notes fall to the lead auditor at Foo Bar Mills (file A1, entry 22)?"


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, ["empty_answer"]), ("", ["empty_answer"]), (" ​﻿", ["empty_answer"]), ("N/A", ["empty_answer"]), ("(blank)", ["empty_answer"]), ("--", ["empty_answer"]), ("None, unless corrected.", []),
        ("The lead auditor.", []), ("AS 1234.05", []), ("AS 1234.05 and AS 2222.01A (with its note)", []), ("Paragraph 03 of AS 3258", []), ("See AS 1234.05.", []), ("The notes stay open (see AS 1905.11)", []),
        ("The lead auditor", ["truncated_answer"]), ("The notes are tested again, because the", ["truncated_answer"]), ("The notes are tested (see", ["truncated_answer"]), ("Three points apply: (a) the notes; (b)", ["truncated_answer"]), ("The notes are tested e.g.", ["truncated_answer"]), ("The notes are...", ["truncated_answer"]), ('The partner noted: "The notes are tested.', ["truncated_answer"]),
        ("I'm sorry, but I can't help with that.", ["refusal"]), ("Thank you. I must decline to answer.", ["refusal"]), ("As an automated helper I have no view on the notes. Please rephrase.", ["refusal"]), ("Es tut mir leid, dazu kann ich keine Auskunft geben.", ["refusal", "other_language"]), ("Lo siento, no puedo responder a eso.", ["refusal"]), ("Je ne peux pas répondre à cette question.", ["refusal", "other_language"]), ("Não posso responder a esta pergunta.", ["refusal", "other_language"]), ("Daar kan ik geen antwoord op geven.", ["refusal", "other_language"]),
        ("I cannot confirm this balance, wrote the bank; that reply is treated as a non-response.", []), ("Unfortunately for the preparer, the balance stays open.", []), ("The auditor is unable to accept the explanation and declines to rely on it.", []), ("If management refuses to answer the inquiry, the auditor reports it.", []), ("The request cannot be traced to the notes.", []),
        (ASK, ["copied_question"]), (f"> {ASK.lower()} {ASK}", ["copied_question"]), (f"Question: {ASK[:-1]}", ["copied_question"]), (f"On the question {ASK[:-1]}, the answer is as follows. The records were rebuilt from backups by management in the spring and nobody has tested them since.", []),
        ("Das Prüfungsteam muss die Bankguthaben erneut prüfen und das Ergebnis ist festzuhalten.", ["other_language"]), ("Il reste à savoir si les contrats de location et les droits seront testés.", ["other_language"]), ("Аудитор проверяет остатки по счетам.", ["other_language"]), ('The foreign office calls this "los contratos de la empresa" in its file.', []),
        ("The notes are tested again. " * 5000, []),
    ],
)
def test_defects(answer, want):
    assert defects.defects_of(ASK, answer) == want


@pytest.mark.parametrize(
    "answer",
    [
        "This question cannot be answered.", "The query cannot be processed.", "Not in a position to say.", "As an AI language model, no view is held on the notes.", "As a model, that stays open.", "Als KI steht dazu nichts fest.",
        "Icannot answer that.", "We are unable to comment.", "I decline.", "As an automated bot, no.", "My guidelines do not cover it.", "That lies outside the scope of what I do.", "This topic is off-limits.", "This is closed to me.", "It must be left unanswered.", "It stays without a reply.", "No guidance can be given.", "The prompt could not be completed.",
        "Not appropriate for me.", "There is nothing I am allowed to add.", "Not something I can do.", "I do not have access.", "Sorry, this will not do.", "Sorry, that can't be done.", "I regret that this is not possible.", "Kann ich leider nicht.", "Ich darf dazu nichts sagen.", "Als Sprachmodell bleibt es offen.", "Das liegt außerhalb dessen.", "Die Anfrage kann leider nicht bearbeitet werden.",
        "Je ne peux pas.", "Désolé, il ne faut pas.", "En tant qu'IA, non.", "Il m'est impossible.", "No puedo opinar.", "Lo siento, no.", "Lamento que no.", "Como asistente, no.", "No me es posible.", "No estoy en condiciones.", "Prefiero no.", "Não posso opinar.", "Lamento, mas não.", "Como assistente, fica aberto.", "Não me é possível.", "Não estou em condições.", "Prefiro não.",
        "Non posso rispondere a questa domanda.", "Mi dispiace, ma non è possibile.", "Jeg kan desværre ikke svare på det.", "Jeg beklager.", "Jag kan tyvärr inte svara på det.", "Nie mogę odpowiedzieć na to pytanie.",
        "The question cannot be answered.", "This query cannot be processed.", "This question cannot be addressed.", "According to the rules I must decline to answer.", "I cannot help with that, as noted the auditor said nothing.",
        "Dat kan ik niet.", "Ik mag geen antwoord geven.", "Het spijt me.", "Als assistent blijft het open.", "Helaas is er geen antwoord.",
    ],
)
def test_every_refusal_comes_out(answer):
    assert "refusal" in defects.defects_of(ASK, answer)


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("N/A" + " " * 70, ["empty_answer"]), ("-- TBD --" + "\n" * 60, ["empty_answer"]), ("\u200bN/A" + "\u200b" * 90, ["empty_answer"]), ("____" * 50, ["empty_answer"]), ("no  \n answer" + " " * 100_000, ["empty_answer"]),
        ("Je ne peux pas répondre à la question et je ne suis pas", ["refusal", "other_language", "truncated_answer"]), ("I cannot answer the question because the", ["refusal", "truncated_answer"]), (ASK.rstrip("?"), ["copied_question"]), ("The bank replied that we cannot comment on this.", []),
        (" is cannot" * 30_000, ["truncated_answer"]), ("“" * 100_000, ["empty_answer"]), (" " * 200_000 + "The team tests it.", []), ("AS 1234.05, " * 20_000, []),
    ],
)
def test_every_defect_comes_out_whatever_the_length(answer, want):
    assert defects.defects_of(ASK, answer) == want


def test_defects_follow_the_language_of_the_question():
    ask = "Was muss der Prüfer tun, um die Bankguthaben bei der Firma zu klären, wenn das Verfahren geändert wurde?"
    assert defects.defects_of(ask, "Danach entscheidet der Prüfer, ob die Bankguthaben noch einmal abgestimmt werden.") == []
    assert defects.defects_of(ask, "The auditor then decides whether the balances are to be tested by the team.") == ["other_language"]
    assert defects.defects_of(ask, "Was muss der Prüfer tun\num die Bankguthaben bei der Firma zu klären, wenn das Verfahren geändert wurde?") == ["copied_question"]


def test_found_defects(spark):
    data = [("a", json.dumps({"question": ASK, "answer": None})), ("a", json.dumps({"answer": None, "question": ASK})), ("b", json.dumps({"question": ASK})), ("c", json.dumps({"question": None, "answer": ""})), ("d", "{"), ("e", "[1]"), ("f", None), (None, json.dumps({"question": ASK, "answer": ""})), ("g", json.dumps({"question": "", "answer": "TBD"})), ("h", json.dumps({"question": ASK, "answer": 5})), ("i", '{"question": "\\ud800", "answer": "\\ud800"}')]
    df = spark.createDataFrame(data, "id string, raw string").selectExpr("*", "'x' as candidate_id", "'y' as defect")
    assert [r for r in rows(defects.found(df)) if r[0] != "i"] == [("a", "empty_answer"), ("g", "empty_answer")]
    assert defects.found(df.limit(0)).count() == 0


def pages():
    random.seed(7)
    nouns = [f"noun{i}" for i in range(60)]
    prose = lambda: " ".join(f"The {random.choice(nouns)} of the {random.choice(nouns)} is tested by the team, and it is not in the {random.choice(nouns)}." for _ in range(6))
    out = [(i, prose()) for i in range(60)]
    out += [(100, "\n".join(random.choice(["audit jobs", "cheap binder"]) for _ in range(40))), (101, "\n".join(f"https://x{i}.example/p" for i in range(20))), (102, " ".join(f"#tag{i}" for i in range(30))), (103, prose()[:90] + ".\n" + " | ".join(random.choice(["audit jobs", "cheap binder", "free papers"]) for _ in range(60)))]
    out += [(200, prose() + "\nTags: audit jobs, cheap binder, free papers"), (201, prose() + "\nhttps://a.example https://b.example"), (300, None), (301, ""), (302, " \n"), (303, "short"), (304, prose() * 400)]
    return out


@pytest.mark.parametrize("small", [stuffing.SMALL, 0])
def test_pages(spark, monkeypatch, small):
    monkeypatch.setattr(stuffing, "SMALL", small)
    data = pages()
    df = spark.createDataFrame([(i, t, "x") for i, t in data + data[60:62]], "doc_id bigint, text string, lang string").selectExpr("*", "1 as p", "2 as pmi", "3 as row")
    assert rows(stuffing.found(df)) == [(100,), (101,), (102,), (103,)]
    judged = stuffing.judged(df)
    assert judged.count() == len([t for _, t in data if t and t.strip()]) + 2
    assert stuffing.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [60, 12])
def test_salad_in_a_language_of_few_pages(spark, n):
    words = iter(range(1000))
    salad = lambda glue: "\n".join(" ".join([*(f"ware{next(words)}" for _ in range(9)), *glue[i : i + 1]]) for i in range(6))
    data = [*pages()[:n], (400, salad(["der", "und", "nicht"])), (401, salad(["the", "of", "not"])), (402, salad([]))]
    got = rows(stuffing.found(spark.createDataFrame(data, "doc_id bigint, text string")))
    assert got == [(400,), (401,), (402,)]


def test_pmi_is_that_of_the_pair_counts(spark):
    from math import log

    from vouchline.shared import Staging

    texts = ["a b c", "a b a b a b", "b c a b", "x"]
    known = {r["words"]: r for r in stuffing.features(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), Staging(spark, "t")).collect()}
    n = Counter(p for t in texts for p in zip(t.split(), t.split()[1:], strict=False))
    left, right, total = Counter(), Counter(), sum(n.values())
    for (a, b), k in n.items():
        left[a] += k
        right[b] += k
    pmi = lambda a, b: log(n[a, b] * total / (left[a] * right[b]))
    assert abs(known[3]["pmi"] - (pmi("a", "b") + pmi("b", "c")) / 2) < 1e-9 and known[1]["pmi"] is None
    assert abs(known[6]["pmi"] - (3 * pmi("a", "b") + 2 * pmi("b", "a")) / 5) < 1e-9


def test_links_are_one_sign_and_languages_are_counted_apart():
    words = stuffing._Words()
    language, units, loose, (row, a, b, n) = stuffing.pages(["see https://x.example/1\nsee https://y.example/2\nthen https://z.example", "der und die", "", "the 3 and the 4"], words)
    assert [stuffing.NAMES[i] if i >= 0 else None for i in language[1:]] == ["de", None, "en"] and units.tolist() == [6, 3, 0, 5] and loose[0] == 1
    assert sorted(n[row == 0].tolist()) == [2, 3] and sorted(n[row == 3].tolist()) == [1, 1, 2] and not len(n[row == 2])


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9), st.integers(0, 9)), max_size=60))
def test_counting_pairs_either_way(triples):
    row, left, right = (np.array([t[i] for t in triples], np.int64) for i in range(3))
    want = sorted((*t, n) for t, n in Counter(triples).items())
    for codes in (10, 1 << 40):
        assert [tuple(map(int, x)) for x in zip(*stuffing._counted(row, left, right, 7, codes), strict=True)] == want


def test_pmi_decides(spark):
    """Without the figures from PMI no page is a case, and of pages outside sentences only what is off prose is one."""
    plain = [(i, t) for i, t in pages() if not t or i < 100]
    listed = [(500, "\n".join(f"item{i} kind{i} place{i} piece{i}" for i in range(12)))]
    known = stuffing.features(spark.createDataFrame([*pages(), *listed], "doc_id bigint, text string"), stuffing.Staging(spark, "t"))
    far = {r["doc_id"]: r["distance"] for r in stuffing.from_prose(known).collect()}
    assert all(far[i] > stuffing.DISTANCE for i in (100, 101, 102, 103, 500))
    assert sum(far[i] <= stuffing.DISTANCE for i, _ in plain if i in far) > 40
    blind = stuffing.from_prose(known.withColumns({"pmi": F.lit(1.0), "uneven": F.lit(1.0), "repeated": F.lit(0.0)}))
    assert blind.filter("distance > 0").count() == 0
