"""Components, splits and near-duplicates against brute force."""

from __future__ import annotations

import json
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import rows
from vouchline.llm import components, keys, neardup, splits
from vouchline.llm.candidates import words
from vouchline.shared import Staging


def union(pairs):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def graphs():
    random.seed(8)
    yield [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(120)]
    yield [("hub", f"leaf{i}") for i in range(150)] + [("leaf0", "z1"), ("z1", "z2")]
    yield [(str(random.randint(0, 200)), str(random.randint(0, 200))) for _ in range(130)] * 2
    yield [("a", "a"), ("b", None), (None, None)]
    yield []


@pytest.mark.parametrize("links", list(graphs()), ids=["chain", "star", "random", "none", "empty"])
def test_components(spark, links):
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "left string, right string, u string")
    got = {r["id"]: r["group_id"] for r in components.connected(df, Staging(spark, "t")).collect()}
    assert got == union(links)


def test_found_components(spark):
    data = [("QA:B ", "qa:a", " Duplicate.\n"), ("qa:b", "qa:c", "duplicate"), ("qa:c", "qa:b", "distinct"), ("qa:d", "qa:e", "non-duplicate"), ("qa:f", "qa:f", "duplicate"), ("qa:g", None, "duplicate"), ("qa:h", "qa:i", None), ("qa:j", "qa:k", "duplicate?"), ("", "qa:a", "duplicate")]
    df = spark.createDataFrame(data + data[:2], "left string, right string, result string").selectExpr("*", "1 as v", "'x' as id")
    assert rows(components.found(df)) == [("qa:a", "qa:a"), ("qa:b", "qa:a"), ("qa:c", "qa:a")]


@pytest.mark.parametrize("links", list(graphs()), ids=["chain", "star", "random", "none", "empty"])
def test_contraction(spark, links):
    df = spark.createDataFrame([(f"id{i}", a, b) for i, (a, b) in enumerate(links)], "id string, key string, other string")
    got = {(r["key"], r["other"]): r["name"] for r in splits.groups(df, Staging(spark, "t")).collect()}
    known = union(links)
    assert got == {(a, b): known.get(a if a is not None else b, a if a is not None else b) for a, b in links}


def decisions(spark, data):
    return spark.createDataFrame([(c, s, None if g == "no record" else (g, "t")) for c, s, g in data], "candidate_id string, standard string, record struct<group_key: string, task_type: string>").selectExpr("*", "'x' as key", "'y' as name", "1 as salt")


FORMER = [("OB 12A", "AS 2002"), ("OB 12A", "AS 2002"), (None, "AS 1")]


def test_found_splits(spark):
    data = [("c1", "AS 1001", "AS 1001"), ("c2", "as_1001.", "ＡＳ 1001"), ("c3", None, "ob-12a"), ("c4", "AS 3003", "docket:AS2002"), ("c5", "n/a", "-"), ("c6", "AS 4004", "no record"), ("c7", "AS 2002", "AS 2002"), ("c1", "AS 1001", "AS 1001"), ("c8", "A.S. 5005", None), (None, "AS 1", "AS 2"), ("c9", "", "AS 1001.07"), ("c10", "6006", "AS 6006")]
    former = spark.createDataFrame(FORMER, "former_label string, as_number string")
    assert rows(splits.found(decisions(spark, data), former)) == sorted([("c2", "AS 1001"), ("c3", "AS 2002"), ("c4", "AS 2002"), ("c6", "AS 4004"), ("c8", "AS 5005"), ("c9", "AS 1001")], key=repr)
    got = rows(splits.splits(decisions(spark, data), former))
    assert len(got) == 10 and {r[2] for r in got} <= set(splits.SHARES) and (r := {c: s for c, _, s in got})["c3"] == r["c4"] == r["c7"]
    told = {r["split"]: r for r in splits.report(decisions(spark, data), former).collect()}
    assert set(told) == set(splits.SHARES) and {s: r["decisions"] for s, r in told.items()} == {s: sum(x[2] == s for x in got) for s in told} and abs(sum(r["actual_share"] for r in told.values()) - 1) < 1e-9
    assert {r["decisions"] for r in splits.report(decisions(spark, data).limit(0), former).collect()} == {0}
    assert rows(splits.found(decisions(spark, data).limit(0), former.limit(0))) == [] == rows(splits.splits(decisions(spark, data).limit(0), former))


def test_splits_keep_groups_and_shares(spark):
    random.seed(3)
    data = [(f"c{i}", f"AS {1000 + min(int(random.expovariate(0.05)), 200)}", None) for i in range(3000)]
    former = spark.createDataFrame(FORMER, "former_label string, as_number string")
    got = splits.splits(decisions(spark, data), former, {"train": 0.7, "validation": 0.2, "test": 0.1}).toPandas()
    assert got.groupby("group_standard").split.nunique().max() == 1
    share = got.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["validation"] - 0.2) < 0.03 and abs(share["test"] - 0.1) < 0.03


@pytest.mark.parametrize(("said", "number"), [("AS 1234", "AS 1234"), (" as-1234 ", "AS 1234"), ("A.S. 1234", "AS 1234"), ("Standard AS 1234", "AS 1234"), ("AS1234.05A", "AS 1234"), ("docket:AS1234:0af98765", "AS 1234"), ("1234", "AS 1234"), ("1234.05", "AS 1234"), ("AS\xa01234", "AS 1234"), ("ＡＳ 1234.", "AS 1234"), ("OB 123", None), ("12345", None), ("AS 12345", None), ("n/a", None), ("", None), (None, None), ("basics 1234 9", None)])
def test_named_numbers(spark, said, number):
    assert spark.createDataFrame([(said,)], "s string").select(keys.named_number(keys.F.col("s"))).first()[0] == number


def near(texts, share=Fraction(7, 10)):
    out = set()
    sets = [(i, set(words(t))) for i, t in texts]
    for i, x in sets:
        for j, y in sets:
            if i < j and x and y and len(x & y) >= share * len(x | y):
                out.add((i, j))
    return out


def questions(n, seed):
    random.seed(seed)
    vocabulary = ["the", "of", "in", *[f"w{i}" for i in range(30)]]
    base = [" ".join(random.sample(vocabulary, random.randint(1, 20))) + f" id{k}" for k in range(8)]
    out = []
    for i in range(n):
        said = random.choice(base).split()
        said = [random.choice(vocabulary) if random.random() < 0.1 else w for w in said] + ([f"x{i}"] if random.random() < 0.3 else [])
        random.shuffle(said)
        out.append((f"c{i:03d}", " ".join(said)))
    return out


@pytest.mark.parametrize("rare", [512, 3, 0])
def test_near_pairs_equal_all_pairs(spark, monkeypatch, rare):
    monkeypatch.setattr(neardup, "RARE", rare)
    said = questions(70, rare)
    raw = [(i, json.dumps({"question": t, "answer": "a"}), "k") for i, t in said]
    raw += [("d1", "{", "k"), ("d2", "[]", "k"), ("d3", '{"question": 3}', "k"), ("d4", None, "k"), (None, raw[0][1], "k"), ("d5", '{"question": "?!"}', "k"), ("d6", '{"question": ""}', "k"), raw[0]]
    df = spark.createDataFrame(raw, "id string, raw string, key string").selectExpr("*", "1 as cid", "2 as words")
    assert {tuple(r) for r in neardup.found(df).collect()} == near(said)
    groups = {r["id"]: r["group_id"] for r in neardup.groups(df).collect()}
    assert groups == union(near(said))


def test_no_candidates(spark):
    df = spark.createDataFrame([], "id string, raw string")
    assert neardup.found(df).count() == 0 == neardup.groups(df).count()


def test_very_long_and_equal_questions(spark):
    long = " ".join(f"t{i}" for i in range(20_000))
    raw = [("a", json.dumps({"question": long})), ("b", json.dumps({"question": long + " more"})), ("c", json.dumps({"question": "Ｓａｍｅ\xa0 words"})), ("d", json.dumps({"question": "same WORDS"}))]
    assert rows(neardup.found(spark.createDataFrame(raw, "id string, raw string"))) == [("a", "b"), ("c", "d")]


def test_close_sets_always_share_a_block():
    random.seed(11)
    share = Fraction(7, 10)
    for _ in range(60):
        vocabulary = np.array([random.getrandbits(64) for _ in range(random.choice([12, 40, 90]))], np.uint64)
        common = np.zeros(neardup.LEAST_BUCKETS // 64, np.uint64)
        some = neardup._bucket(vocabulary[: int(len(vocabulary) * random.random())], neardup.LEAST_BUCKETS)
        np.bitwise_or.at(common, (some >> np.uint64(6)).astype(np.int64), np.uint64(1) << (some & np.uint64(63)))
        split = neardup.Blocks(common, np.full(neardup.LEAST_BUCKETS // 64, 2**64 - 1, np.uint64), share)
        sets = [random.sample(range(len(vocabulary)), random.randint(1, len(vocabulary)))]
        while len(sets) < 25:
            base = set(random.choice(sets))
            for _ in range(random.randint(0, 6)):
                base ^= {random.randrange(len(vocabulary))}
            sets.append(sorted(base) or [0])
        column = pa.array([vocabulary[s].view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))
        split.of(column)
        poor_keys = split.several(None, only_poor=True)[1]
        filtered = np.zeros(neardup.LEAST_BUCKETS // 64, np.uint64)
        at = neardup._bucket(poor_keys, neardup.LEAST_BUCKETS) if len(poor_keys) else np.array([], np.uint64)
        np.bitwise_or.at(filtered, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        row1, key1 = split.singles()
        row2, key2, side = split.several(filtered)
        left, right = {}, {}
        for r, k in zip(row1, key1, strict=True):
            left.setdefault(r, set()).add(k)
            right.setdefault(r, set()).add(k)
        for r, k, s in zip(row2, key2, side, strict=True):
            if s != 1:
                left.setdefault(r, set()).add(k)
            if s != 0:
                right.setdefault(r, set()).add(k)
        sketch = split.sketches()
        for i in range(len(sets)):
            for j in range(i):
                x, y = set(sets[i]), set(sets[j])
                if len(x & y) >= share * len(x | y):
                    assert left.get(i, set()) & right.get(j, set()) or left.get(j, set()) & right.get(i, set())
                    apart = int(np.bitwise_count(sketch[i] ^ sketch[j]))
                    assert apart <= len(x ^ y) <= neardup.most_differing(len(x) + len(y), share)


def test_blocks_a_set_stay_as_the_data_grows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RARE", 12)
    monkeypatch.setattr(neardup, "RARE_PARTS", 40, raising=False)
    random.seed(5)

    def rows_a_set(n):
        sets = [(i, random.sample(range(250), 3) + random.sample(range(1000, 1020), 9)) for i in range(n)]
        hashed = [(i, neardup._mixed(np.array(s, np.uint64)).view(np.int64).tolist()) for i, s in sets]
        return neardup.blocks(spark.createDataFrame(hashed, "cid bigint, words array<bigint>")).count() / n

    assert rows_a_set(4000) < 2 * rows_a_set(500)


def test_long_blocks_of_a_word_give_all_pairs():
    random.seed(6)
    share = Fraction(7, 10)
    draw = np.random.default_rng(6)
    block = np.repeat(draw.integers(0, 1 << 40, 9), [1, 700, 3, 64, 65, 2, 5000, 1, 130])
    size = draw.choice([1, 2, 10, 30, 37, 40, 60, 4000], len(block))
    sketch = draw.integers(0, 4, len(block)).astype(np.uint64) * np.uint64(0x0F0F3C01)
    cid = draw.permutation(len(block))
    want = set()
    for one in np.unique(block):
        at = np.flatnonzero(block == one)
        i, j = (at[x] for x in np.triu_indices(len(at), 1))
        total = size[i] + size[j]
        near_enough = (np.bitwise_count(sketch[i] ^ sketch[j]) <= total + 2 * (-7 * total // 17)) & (10 * np.minimum(size[i], size[j]) >= 7 * np.maximum(size[i], size[j]))
        want |= {(min(a, b), max(a, b)) for a, b in zip(cid[i[near_enough]].tolist(), cid[j[near_enough]].tolist(), strict=True)}
    got = [pair for a, b in neardup._within(block, cid, size, sketch, share) for pair in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and want <= set(got)
