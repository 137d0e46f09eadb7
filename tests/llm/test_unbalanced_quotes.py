"""Start tags with stray quotes do not take the rest of a page along."""

import time

import pytest

from gridmat.llm.dom import Page, join_blocks


def _text(html):
    return join_blocks(Page(html).pieces)


@pytest.mark.parametrize(
    "html",
    [
        """<article><p class="a"">Hello</p><p>World</p></article>""",
        """<p title=it's>Hello</p><p>World</p>""",
        """<p title=it's>Hello</p><p class="b" title='c'>World</p>""",
        """<p class="a"" id="b">Hello</p><p id='c'>World</p>""",
        """<p "class=a>Hello</p></ ><p>World</p></>""",
        """<p class="x>Hello</p><p>World</p>""",
        """<p title="a > b" data-x='c > "d'>Hello</p><p title = "e>f">World</p>""",
        """<p href=a/b="c>Hello</p><br/><p/>World</p>""",
    ],
)
def test_tags_end_as_in_html(html):
    assert _text(html) == "Hello\n\nWorld"


def test_a_tag_without_its_end_takes_the_rest_in_linear_time():
    assert _text("<p>Hello</p><p class='a' World") == "Hello"
    started = time.monotonic()
    assert _text("<p>Hello</p><p " + "x=\"1\" y='2' \" z=' " * 20_000) == "Hello"
    assert time.monotonic() - started < 5


def test_attributes_are_read_after_stray_quotes():
    page = Page("""<div class="main"" id='story'><p>x</p></div>""")
    assert page.nodes[1].tokens == ["main", "story"]
