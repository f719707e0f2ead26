from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vouchline.sources import store


def page(number, *texts, notes=()):
    body = "".join(f"<p>.{i:02d} {t}</p>" for i, t in enumerate(texts, 1))
    block = f'<div class="footnotes">{"".join(f"<p><sup>{i}</sup> {n}</p>" for i, n in enumerate(notes, 1))}</div>' if notes else ""
    return f'<h1 class="article-detail__title">AS {number}: Title {number}</h1><div class="article-detail__content"><h2>Scope</h2>{body}{block}</div>'


@pytest.fixture
def pages(spark):
    data = [("u/1001", page(1001, "one two", "three"), "t"), ("u/2002", page(2002, "four", notes=("a note", "another"))), ("u/x", "<p>nothing</p>", "t")]
    return spark.createDataFrame([(*d, "t")[:3] for d in data], "url string, html string, fetched_utc string")


def test_a_version_is_saved_loaded_and_parsed_again(spark, pages, tmp_path):
    root = str(tmp_path)
    assert rows(store.save(pages, root, "2026-01")) == [("u/x", "no standard title on the page")]
    held = store.load(spark, root, "2026-01")
    assert [(r["as_number"], len(r["footnotes"]), r["series"]) for r in held.orderBy("as_number").collect()] == [("AS 1001", 0, "General Auditing Standards"), ("AS 2002", 2, "Audit Procedures")]
    one = store.manifest(spark, root, "2026-01").first()
    assert (one["standard_count"], one["paragraph_count"], [r["footnotes"] for r in one["standards"]]) == (2, 3, [0, 2])
    assert store.inspect(spark, root, "2026-01").count() == 0
    before = rows(held.select("as_number", "source_sha256"))
    assert store.reparse(spark, root, "2026-01").count() == 1
    assert rows(store.load(spark, root, "2026-01").select("as_number", "source_sha256")) == before and store.manifest(spark, root, "2026-01").first()["downloaded_utc"] == one["downloaded_utc"]
    (tmp_path / "2026-02").mkdir()
    assert store.latest(spark, root) == "2026-01" and store.latest(spark, str(tmp_path / "none")) is None
    with pytest.raises(store.CorpusError):
        store.save(pages.filter("url = 'u/x'"), root, "2026-03")
    assert store.latest(spark, root) == "2026-01"
    with pytest.raises(store.CorpusError):
        store.folder(root, "../x")


def test_every_violation_is_found(spark, pages, tmp_path):
    store.save(pages, str(tmp_path), "v1")
    manifest, raw, parsed = store.manifest(spark, str(tmp_path), "v1"), pages, store.load(spark, str(tmp_path), "v1")
    codes = lambda m=manifest, r=raw, p=parsed: {x["code"] for x in store.violations(m, r, p).collect()}
    assert codes() == set()
    entry = lambda change: manifest.withColumn("standards", F.transform("standards", change))
    assert codes(m=manifest.withColumn("standards", F.slice("standards", 1, 0))) >= {"empty_corpus", "manifest_count", "parsed_inventory"}
    assert "duplicate_manifest_entry" in codes(m=manifest.withColumn("standards", F.concat("standards", "standards")))
    assert codes(r=raw.filter("url <> 'u/2002'")) == {"raw_inventory", "source_checksum"}
    assert codes(r=raw.withColumn("html", F.concat("html", F.lit(" ")))) == {"source_checksum"}
    assert codes(m=entry(lambda s: s.withField("url", F.concat(s["url"], F.lit("#"))))) == {"source_identity", "raw_inventory"}
    assert codes(m=entry(lambda s: s.withField("footnotes", s["footnotes"] + 1))) == {"source_counts"}
    bent = parsed.withColumn("sections", F.transform("sections", lambda s: s.withField("paragraphs", F.transform(s["paragraphs"], lambda p: p.withField("number", F.lit("7"))))))
    assert codes(p=bent) == {"paragraph_label", "ambiguous_paragraph"}
    assert codes(m=manifest.withColumn("paragraph_count", F.lit(9)).withColumn("fingerprint", F.lit("x"))) == {"paragraph_total", "corpus_fingerprint"}


def test_download_follows_the_index(spark, pages, tmp_path):
    links = "".join(f'<a href="/oversight/standards/auditing-standards/details/{n}">AS {n}: T</a>' for n in (1001, 3003))
    index = spark.createDataFrame([(links,)], "html string")
    fetched = pages.withColumn("url", F.concat(F.lit("https://x.example/oversight/standards/auditing-standards/details/"), F.regexp_extract("url", r"(\w+)$", 1)))
    failures = store.download(fetched, index, "https://x.example/", str(tmp_path), "v1")
    assert [r["error"] for r in failures.collect()] == ["not fetched"] and store.load(spark, str(tmp_path), "v1").count() == 1
    with pytest.raises(store.CorpusError):
        store.download(fetched, index.filter("false"), "https://x.example/", str(tmp_path), "v2")


def test_files_requests_and_runs(spark, tmp_path):
    root = str(tmp_path)
    with store.writer(root), pytest.raises(store.CorpusError), store.writer(root):
        pass
    with store.writer(root):
        pass
    for i, state in enumerate(("complete", "unknown")):
        store.put_request(root, {"id": f"r{i}", "stage": "generate", "key": f"u{i}", "state": state, "payload": {"é": [1.5, None]}})
    assert rows(store.requests(spark, root).select("id", "state", "sound")) == [("r0", "complete", True), ("r1", "unknown", True)]
    path = tmp_path / "requests" / "r0.json"
    path.write_text(path.read_text().replace("u0", "u9"))
    assert rows(store.requests(spark, root).select("id", "sound")) == [("r0", False), ("r1", True)]
    runs = [json.dumps({"state": s, "finalized_utc": t, "run_id": r}) for s, t, r in (("finalized", "2026-01", "a"), ("validated", "2026-09", "b"), ("finalized", "2026-02", "c"))]
    df = spark.createDataFrame([(r,) for r in [*runs, "{", None]], "value string")
    assert rows(store.latest_run(df)) == [("c",)] and store.latest_run(df.limit(0)).count() == 0
    found = store.write_inventory(spark, root)
    assert set(found) == {"requests/r0.json", "requests/r1.json"}
    one = spark.createDataFrame([(found,)], "files map<string, string>")
    assert one.select(store.missing_artifacts(F.col("files"), "requests/r0.json", "accepted.jsonl")).first()[0] == ["accepted.jsonl"]
    names = spark.createDataFrame([("run-1",), ("../x",), ("-a",), (None,), ("a" * 101,), ("a\n",)], "n string")
    assert [r[0] for r in names.select(store.is_safe(F.col("n"))).collect()][:5] == [True, False, False, False, False]
