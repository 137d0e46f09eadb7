"""Main text of web pages: boosted trees over features of DOM nodes, decoded along the tree.

The nodes of a page are its block elements and the inline elements that carry
attribute words; other inline elements belong to the node around them. The
trees learn from a bounded sample of pages. Their labels come from what pages
say about themselves: in a page with an article or main element, text inside
it is main text unless an element between marks it as something else. To carry
over to pages that say less or otherwise, every sampled node is learned from
again with those marks blanked out, so that density, links, depth and siblings
decide, and main text again as something else with a mark of that put on.

Decoding: a node is kept if its own evidence and that of the kept nodes below
add up to more than nothing. A node below a dropped one is dropped, and a kept
one has kept ancestors, so the choices never contradict each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.llm.boosting import Trees
from gridmat.llm.common import received, shipped
from gridmat.llm.dom import BLOCK, Node, Page, join_blocks

#: Pages that the trees are fitted on, at most, taken by the hash of their id, and nodes of them.
SAMPLE_PAGES = 400
SAMPLE_NODES = 60_000

# Names and attribute words by which pages mark what is, and what is not, main text.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog search fieldset button select".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline comment comments consent contact cookie cookies disclaimer discussion disqus "
    "dropdown footer form gdpr header login masthead menu metadata modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promotion "
    "related recommended reply replies respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar "
    "tracking warning widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
_PUNCTUATION = ".,;:!?"
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FEATURES = [
    "tag_aside", "tag_main", "tag_p", "tag_heading", "tag_item", "tag_table", "tag_generic", "words_aside", "words_main", "above_aside", "above_main", "above_words_aside", "above_words_main",
    "depth", "own_chars", "own_words", "own_link_share", "own_punctuation", "all_chars", "all_words", "all_link_share", "density", "children", "place", "siblings", "same_siblings", "share_of_parent", "share_of_page",
]
#: Features that say outright what a node is.
MARKS = [FEATURES.index(f) for f in ("tag_aside", "tag_main", "words_aside", "words_main", "above_aside", "above_main", "above_words_aside", "above_words_main")]


class Parsed:
    """A page with its scored nodes, their features and the pieces of text by node."""

    def __init__(self, html: str | None):
        page = Page(html or "")
        self.pieces: list[tuple[int | None, str]] = []
        number: dict[int, int] = {}
        self.nodes: list[Node] = []
        self.parent: list[int] = []
        for node in page.nodes:
            if node.parent is None or node.tag in BLOCK or node.tokens:
                number[id(node)] = len(self.nodes)
                self.parent.append(number[id(node.parent)] if node.parent is not None else -1)
                self.nodes.append(node)
            else:
                number[id(node)] = number[id(node.parent)]
        n = len(self.nodes)
        chars, words, linked, marks = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = {id(node): node.tag == "a" for node in page.nodes}
        for node in page.nodes[1:]:
            in_link[id(node)] |= in_link[id(node.parent)]
        for node, text in page.pieces:
            if node is None:
                self.pieces.append((None, ""))
                continue
            k = number[id(node)]
            self.pieces.append((k, text))
            size = len(text.strip())
            chars[k] += size
            words[k] += len(text.split())
            linked[k] += size if in_link[id(node)] else 0
            marks[k] += sum(map(text.count, _PUNCTUATION))
        self.chars = chars
        self.features = self._features(chars, words, linked, marks) if n else np.zeros((0, len(FEATURES)))

    def _features(self, chars: list, words: list, linked: list, marks: list) -> np.ndarray:
        nodes, parent = self.nodes, self.parent
        n = len(nodes)
        all_chars, all_words, all_linked, tags = list(chars), list(words), list(linked), [1] * n
        for k in range(n - 1, 0, -1):
            p = parent[k]
            all_chars[p] += all_chars[k]
            all_words[p] += all_words[k]
            all_linked[p] += all_linked[k]
            tags[p] += tags[k]
        kids: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            kids[parent[k]].append(k)
        place, same = [0] * n, [0] * n
        for below in kids:
            seen: dict[str, int] = {}
            for i, k in enumerate(below):
                place[k] = i
                seen[nodes[k].tag] = seen.get(nodes[k].tag, 0) + 1
            for k in below:
                same[k] = seen[nodes[k].tag]
        self.kids = kids
        above = [(0, 0, 0, 0)] * n
        rows = []
        for k, node in enumerate(nodes):
            tag = node.tag
            p = parent[k]
            up = above[p] if p >= 0 else (0, 0, 0, 0)
            # The header of an article holds its title; that of a page does not.
            title = tag == "header" and up[1]
            own = (int(tag in ASIDE_TAGS and not title), int(tag in MAIN_TAGS), 0 if title else len(ASIDE_WORDS.intersection(node.tokens)), len(MAIN_WORDS.intersection(node.tokens)))
            above[k] = tuple(int(bool(a or b)) for a, b in zip(up, own))
            siblings = len(kids[p]) if p >= 0 else 1
            rows.append((
                own[0], own[1], tag == "p", tag in _HEADINGS, tag in ("li", "dt", "dd", "option"), tag in ("table", "tr", "td", "th"), tag in ("div", "section", "span"), own[2], own[3], *up[:2], *up[2:],
                node.depth, log1p(chars[k]), log1p(words[k]), linked[k] / max(chars[k], 1), marks[k] / max(words[k], 1), log1p(all_chars[k]), log1p(all_words[k]), all_linked[k] / max(all_chars[k], 1),
                all_chars[k] / tags[k], len(kids[k]), place[k], siblings, same[k] / max(siblings, 1), all_chars[k] / max(all_chars[p] if p >= 0 else 1, 1), all_chars[k] / max(all_chars[0], 1),
            ))
        self.all_chars = all_chars
        return np.array(rows, np.float64)

    def labels(self) -> np.ndarray:
        """1 main text, 0 not, -1 unsaid, by the marks of the page itself."""
        f = {name: self.features[:, i] > 0 for i, name in enumerate(FEATURES)}
        aside = f["tag_aside"] | f["above_aside"] | f["words_aside"] | f["above_words_aside"]
        main = f["tag_main"] | f["above_main"]
        said = main.any() if len(main) else False
        has_text = np.array(self.all_chars) > 0 if len(main) else main
        out = np.where(aside, 0, np.where(main, 1, 0 if said else -1))
        # A container around the main text is neither.
        around = ~main & ~aside
        for k in range(len(self.nodes) - 1, 0, -1):
            if out[k] == 1 and around[self.parent[k]]:
                out[self.parent[k]] = -1
            elif out[k] == -1 and around[self.parent[k]]:
                out[self.parent[k]] = -1
        return np.where(has_text, out, -1)

    def decode(self, margin: np.ndarray) -> list[bool]:
        """Which nodes are kept: the choice with the most evidence in which no kept node lies below a dropped one."""
        n = len(self.nodes)
        margin = np.clip(margin, -6, 6).tolist()
        weight = np.sqrt(np.array(self.chars)).tolist()
        best = [0.0] * n
        for k in range(n - 1, -1, -1):
            own = margin[k]
            text = own * weight[k]
            total = (own if self.chars[k] or own < 0 else 0.0) + max(text, 0.0)
            total += sum(max(best[c], 0.0) for c in self.kids[k])
            best[k] = total if k else 1.0
        kept = [False] * n
        for k in range(n):
            kept[k] = best[k] > 0 and (k == 0 or kept[self.parent[k]])
        self.own_text = [kept[k] and margin[k] > 0 for k in range(n)]
        return kept

    def text(self, margin: np.ndarray) -> str:
        self.decode(margin)
        return join_blocks([(k, t) if k is None or self.own_text[k] else (-1, "") for k, t in self.pieces])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for html in batch.column("html"):
            page = Parsed(html.as_py())
            y = page.labels()
            known = y >= 0
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in page.features[known]], pa.binary()), pa.array(y[known].astype(np.int32))], names=["x", "y"])


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_nodes: int = SAMPLE_NODES) -> Trees:
    """Trees from at most ``sample_pages`` pages and ``sample_nodes`` of their nodes. Without a page that marks its main text, a few fixed rules of thumb are learned instead."""
    ids = pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull()).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    rows = pages.join(F.broadcast(ids.distinct()), "page_id", "left_semi").select("html").mapInArrow(_sample_rows, "x binary, y int")
    got = rows.orderBy(F.xxhash64("x"), "x", "y").limit(sample_nodes).toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy(np.float64)
    if len(y) < 50 or y.min() == y.max():
        x, y = _rules_of_thumb()
    # Again without the marks, and main text again as if each of the marks of something else stood on or above it.
    blank = x.copy()
    blank[:, MARKS] = 0
    rows, labels, weights = [x, blank], [y, y], [np.ones(len(x)), np.full(len(x), 0.3)]
    for name in ("tag_aside", "words_aside", "above_aside", "above_words_aside"):
        turned = x[y > 0].copy()
        turned[:, FEATURES.index(name)] = 1
        rows.append(turned)
        labels.append(np.zeros(len(turned)))
        weights.append(np.full(len(turned), 0.2))
    return Trees().fit(np.concatenate(rows), np.concatenate(labels), np.concatenate(weights))


def _rules_of_thumb() -> tuple[np.ndarray, np.ndarray]:
    """Rows that say: long paragraphs with few links are main text, marked asides and link lists are not."""
    rng = np.random.default_rng(3)
    x = np.zeros((400, len(FEATURES)))
    y = np.arange(400) % 2
    col = FEATURES.index
    x[:, col("own_chars")] = np.where(y, rng.uniform(4.5, 8, 400), rng.uniform(0.5, 4, 400))
    x[:, col("own_words")] = x[:, col("own_chars")] - 1.5
    x[:, col("own_link_share")] = np.where(y, rng.uniform(0, 0.2, 400), rng.uniform(0.5, 1, 400))
    x[:, col("tag_p")] = y
    x[:, col("above_aside")] = 1 - y
    return x, y.astype(np.float64)


def _extract(trees: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(trees)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pages = [Parsed(h.as_py()) for h in part.column("html")]
                margins = model.margin(np.concatenate([p.features for p in pages]))
                at = np.concatenate([[0], np.cumsum([len(p.nodes) for p in pages])])
                texts = [p.text(margins[a:b]) for p, a, b in zip(pages, at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; the text is empty where there is none, and for null html. Other columns are not looked at; repeated rows give equal rows."""
    trees = shipped(pages.sparkSession, fit(pages))
    plain = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    return plain.mapInArrow(_extract(trees), "page_id long, url string, text string, n_chars long")
