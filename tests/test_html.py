from __future__ import annotations

import pytest

from tests.conftest import rows
from vouchline.operators import corpus
from vouchline.sources import html

PAGE = """<html><h1 class="article-detail__title">AS 9301 &mdash; Made-Up&nbsp;Title</h1>
<div class="article-detail__content extra">
<p>Adopted long ago.</p><ul class="standardTopBookmarks"><li>.99 contents</li></ul>
<h2>Opening</h2><p>Left out, before the first number.</p>
<p>.01&nbsp; First<sup>1</sup> duty .</p><ul><li>a point</li><li><p>nested point</p></li></ul><p>Note: more.</p>
<h3>Empty heading</h3><h4>Later</h4><p>.01A Inserted.</p><p>.A1 Annex ( see .01 )</p><script>var x;</script>
<div class="footnotes"><p><sup>1</sup> Some note.</p><p>No marker.</p><p> </p></div>
</div></html>"""


def test_page():
    got = html.parse_page(PAGE)
    assert (got["as_number"], got["title"], got["notes"]) == ("AS 9301", "Made-Up Title", ["Adopted long ago."])
    assert [(s["heading"], s["level"]) for s in got["sections"]] == [("Opening", 2), ("Later", 4)]
    first = got["sections"][0]["paragraphs"]
    assert first == [{"number": ".01", "text": "First duty. a point nested point Note: more."}]
    assert got["sections"][1]["paragraphs"] == [{"number": ".01A", "text": "Inserted."}, {"number": ".A1", "text": "Annex (see .01)"}]
    assert got["footnotes"] == [{"number": "1", "text": "Some note."}, {"number": "?", "text": "No marker."}]


def test_page_without_headings_is_filed_under_its_title():
    got = html.parse_page('<h1 class="article-detail__title">AS 1000: T</h1><div class="article-detail__content"><p>front</p><p>.01 One</p></div>')
    assert got["notes"] == ["front"] and got["sections"] == [{"heading": "T", "level": 2, "paragraphs": [{"number": ".01", "text": "One"}]}]


def test_unclosed_block_swallows_the_rest():
    got = html.parse_page('<h1 class="article-detail__title">AS 1000: T</h1><div class="article-detail__content"><p>.01 One<p>.02 Two</div>')
    assert [p["number"] for p in got["sections"][0]["paragraphs"]] == [".01"]


@pytest.mark.parametrize(("page", "why"), [("", "no standard title"), ('<h1 class="article-detail__title">Untitled</h1>', "no number"), ('<h1 class="article-detail__title">AS 1000: T</h1>', "no standard body"), ('<h1 class="article-detail__title">AS 1000: T</h1><div class="article-detail__content"><p>x</p></div>', "no numbered")])
def test_refusals(page, why):
    with pytest.raises(html.NotAStandard, match=why):
        html.parse_page(page)


def test_pages_keep_failures_as_rows(spark):
    df = spark.createDataFrame([("u1", PAGE), ("u2", "<p>nothing</p>"), ("u3", None)], "url string, html string")
    got = {r["url"]: r for r in html.parse_pages(df).collect()}
    assert got["u1"]["ok"] and not got["u2"]["ok"] and got["u3"]["error"]
    flat = corpus.flattened(html.parse_pages(df).filter("ok"))
    assert [r["number"] for r in flat.orderBy("section_pos", "paragraph_pos").collect()] == [".01", ".01A", ".A1"]


def test_index(spark):
    page = """<a href="/x/auditing-standards/details/as-2-long">AS 2000: Second</a><a href="https://h/auditing-standards/details/AS1000">as 1000 - First</a>
    <nav><a href="/auditing-standards/details/AS2000">AS 2000: Short</a></nav><a href="/auditing-standards/details/none">No number</a><a>AS 3000: no target</a><a href="/else">AS 4000: elsewhere</a>"""
    df = spark.createDataFrame([(page,)], "html string")
    assert [tuple(r) for r in html.index_links(df, "https://h/base/").collect()] == [("AS 1000", "First", "https://h/auditing-standards/details/AS1000"), ("AS 2000", "Second", "https://h/x/auditing-standards/details/as-2-long")]


def test_rendered_pages_parse_back(spark):
    s = spark.createDataFrame([("AS 1000", "T & <U>", "u")], "as_number string, title string, url string")
    p = spark.createDataFrame([("AS 1000", "s1", ".01", "x < y & z"), ("AS 1000", "s2", ".02", "w")], "standard string, section_id string, number string, text string")
    got = html.parse_pages(html.render_pages(s, p))
    assert got.first()["title"] == "T & <U>"
    assert rows(corpus.flattened(got).select("heading", "number", "text")) == [("s1", ".01", "x < y & z"), ("s2", ".02", "w")]
