"""Main text of pages labelled by hand, with the model that the query trains, and the registered query."""

import duckdb
import pytest

from promolens.llm import html_extract
from promolens.llm import queries as llm
from promolens.llm.html_blocks import blocks
from tests.conftest import SF

ARTICLE = """<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul></nav>
<article><h1>Title here</h1><p>First paragraph of text, long enough to count as such.</p>%s<p>Last paragraph of the article, with some more words.</p></article>
<footer>&copy; someone, all rights reserved</footer></body></html>"""
FIRST, LAST = "Title here\nFirst paragraph of text, long enough to count as such.\n", "Last paragraph of the article, with some more words."
COMMENT = "<p>Great post, I liked it very much.</p>"
#: name to (page, main text)
PAGES = {
    "comments of a plug-in": (ARTICLE % f'<section id="disqus_thread">{COMMENT}</section>', FIRST + LAST),
    "comment list": (ARTICLE % '<ol class="commentlist"><li>Great post, I liked it very much.</li></ol>', FIRST + LAST),
    "reader feedback": (ARTICLE % f'<div class="reader-feedback">{COMMENT}</div>', FIRST + LAST),
    "words of a title are no attribute": (ARTICLE % '<p title="a hidden gem">A gem of a paragraph.</p>', FIRST + "A gem of a paragraph.\n" + LAST),
    "a value that looks like a class": (ARTICLE % '<div data-note="class=footer">A noted paragraph stays.</div>', FIRST + "A noted paragraph stays.\n" + LAST),
    "seventy values and a sign in one": (ARTICLE % ("<p " + " ".join(f'data-{i}="v"' for i in range(70)) + ' title="a > b hidden words">Many attributes.</p>'), FIRST + "Many attributes.\n" + LAST),
    "label in a sentence": (ARTICLE % "<p>Words before <label>the label</label> and words after.</p>", FIRST + "Words before the label and words after.\n" + LAST),
    "advert, form and script inside": (ARTICLE % '<div class="ad">Buy two now.</div><form><p>Your mail</p><button>Send</button></form><script>var t="</p>";</script>', FIRST + LAST),
    "one paragraph": ("<p>Just text.</p>", "Just text."),
    "no tags": ("A plain sentence without any tags.", "A plain sentence without any tags."),
    "no container": ("<html><body><div><h1>Title of page</h1><p>One paragraph of words before the table stands here.</p><table><tr><td>a</td><td>b</td></tr></table><p>Another paragraph after the table stands here.</p></div></body></html>", "Title of page\nOne paragraph of words before the table stands here.\na\nb\nAnother paragraph after the table stands here."),
    "article below 140 pairs": ("<html><body>" + "<span><div>" * 140 + "<article><p>Deep inside the article there is text.</p></article>" + "</div></span>" * 140, "Deep inside the article there is text."),
    "menu below 260 elements": ("<html><body><div class='menu'>" + "<div>" * 260 + "Menu entry deep inside" + "</div>" * 261 + "<article><p>The article text comes after the deep menu.</p></article></body></html>", "The article text comes after the deep menu."),
}


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_page(model, name):
    page, want = PAGES[name]
    assert model.main_text(page) == want


def test_names_and_values_of_attributes():
    page = """<div id=main data-x='class="footer"'><p class = "lead" title="it's a comment" hidden>a</p><p data-a="x" class='ad'/>b<p a="unclosed>c</div>"""
    found = blocks(page)
    assert [b.text for b in found] == ["a", "b", "c"]
    assert [sorted(b.place.names) for b in found] == [["hidden", "main"], ["ad", "main"], ["main"]]
    assert [b.place.inner for b in found] == [2, 2, 1]


def test_registered_query_covers_every_page(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in llm.queries()["op10_html_extraction"](spark, SF).collect()}
    assert len(got) == len(pages)
    for i, url, html in pages:
        text, n = got[i, url]
        assert n == len(text)
        # these pages hold their article in one element: its blocks, without those of side elements, are the text
        inside = [b.text for b in blocks(html or "") if "article" in b.place.tags and b.place.inner == 1]
        assert text == "\n".join(inside)
