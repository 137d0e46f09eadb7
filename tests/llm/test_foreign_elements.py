"""Drawings, templates and odd comments in pages: the text around them stays whole."""

import pytest

from gridmat.llm.dom import Page, join_blocks
from gridmat.llm.html_text import extract


def _text(html):
    return join_blocks(Page(html).pieces)


@pytest.mark.parametrize(
    "inside",
    [
        '<svg class="icon"/>', "<svg/>", "<math/>", "<svg />", '<svg viewBox="0 0 1 1"><path d=m/></svg>', '<svg><path d="m0"/><g><circle r=1></circle></g></svg>',
        "<svg><title/></svg>", "<svg><style>a > b {}</style></svg>", "<svg><desc><p>hidden</p></desc></svg>", "<math><mi>x</mi><mo>=</mo></math>",
        "<template>t<template>u</template>v</template>", "<template><p>hidden</article></p></template>", "<!-->", "<!--->", "<!---->", "<!-- > -- ! -->", "<!--x--!>",
    ],
)
def test_text_around_stays(inside):
    assert _text(f"<article><h1>Head{inside}</h1><p>one {inside}two</p><p>three</p></article><p>end</p>") == "Head\n\none two\n\nthree\n\nend"


def test_unclosed_drawing_ends_at_text_tags():
    assert _text("<div><svg><path d='m'><p>first</p><p>second</p></div>") == "first\n\nsecond"
    assert _text("<p>a</p><math><mfrac><p>b</p>") == "a\n\nb"


def test_unclosed_template_hides_what_follows():
    assert _text("<p>a</p><template><p>b</p>") == "a"


def test_slash_in_an_unquoted_value_closes_nothing():
    page = Page("<svg><a href=x/>in</a></svg><p>out</p>")
    assert [n.tag for n in page.nodes] == ["#root", "svg", "a", "p"] and page.nodes[2].hidden


def test_icons_do_not_change_an_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    icon = '<svg class="icon"/><!-->'
    with_icons = [(i, u, h.replace("</p>", icon + "</p>", 1)) for i, u, h in rows]
    schema = "page_id long, url string, html string"
    plain = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, schema)).collect()}
    marked = {r.page_id: r.text for r in extract(spark.createDataFrame(with_icons, schema)).collect()}
    assert plain == marked and sum(map(bool, plain.values())) > 0.9 * len(plain)
