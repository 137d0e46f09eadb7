"""A tolerant reader of HTML: the tree of a page and its blocks of text."""

from __future__ import annotations

import re
from html import unescape

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head script style noscript template iframe svg math textarea select object audio video canvas button".split())
FOREIGN = frozenset("svg math".split())
#: Children of foreign elements whose content is HTML again.
_HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext template".split())
#: HTML start tags that end an open foreign element.
_LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby "
    "s small span strong strike sub sup table tt u ul var".split()
)
#: Start tags that close an open element of these names, up to a boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Blocks whose start tag closes an open paragraph.
_ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "html", "head", "body"} | {"hr", "table"}
_P_SCOPE = frozenset("table td th caption button object html body template svg math foreignobject desc".split())

# As in HTML, a quote opens a value only right after "="; anywhere else, or without its second quote, it is a character like others.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
_TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:-->|--!>)|.*)|<(?:[!?]|/(?![a-zA-Z]))[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<(?=[a-zA-Z]|/[a-zA-Z]).*""", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: A slash before the end of the tag that is not part of an unquoted value.
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'/]|(?:^|\s)[^\s=]+)/\s*$""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "hidden")

    def __init__(self, tag: str, parent: Node | None, tokens: list[str], hidden: bool):
        self.tag, self.parent, self.tokens, self.hidden = tag, parent, tokens, hidden
        self.depth = parent.depth + 1 if parent else 0


def attribute_tokens(source: str) -> tuple[list[str], bool]:
    """Small-letter words of class, id, role and label attributes, and whether the element is hidden."""
    words, hidden = [], False
    for name, a, b, c in _ATTR.findall(source):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            words += [w.lower() for w in _WORDS.findall(unescape(value))]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            hidden = True
    return words, hidden


class Page:
    """Nodes in page order and pieces of text (node, text); a piece without a node ends a block."""

    def __init__(self, html: str):
        self.nodes: list[Node] = [Node("#root", None, [], False)]
        self.pieces: list[tuple[Node | None, str]] = []
        self._read(html)

    def _open(self, stack: list[Node], tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._close(stack, {"p"}, _P_SCOPE)
        if tag in CLOSES:
            self._close(stack, *CLOSES[tag])
        tokens, hidden = attribute_tokens(attributes) if attributes else ([], False)
        node = Node(tag, stack[-1], tokens, hidden or stack[-1].hidden or tag in HIDDEN)
        self.nodes.append(node)
        stack.append(node)

    @staticmethod
    def _close(stack: list[Node], names, limits) -> bool:
        """Close open elements down to the outermost of the named ones within the limits."""
        at = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                at = i
            elif stack[i].tag in limits or stack[i].tag == "template":
                break
        if at is not None:
            del stack[at:]
        return at is not None

    def _read(self, html: str) -> None:
        stack, at, n = [self.nodes[0]], 0, len(html)
        foreign = False  # whether a drawing, a formula or a template has begun anywhere
        while at < n:
            found = _TOKEN.search(html, at)
            end = found.start() if found else n
            if end > at:
                self._text(stack[-1], html[at:end])
            if not found:
                break
            at = found.end()
            tag = found.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if not found.group(1) and (tag in FOREIGN or foreign):
                # Icons and formulas: "/>" ends an element, and text tags of HTML end the drawing that someone left open.
                top = self._foreign_top(stack)
                if top is not None and tag in _LEAVES_FOREIGN:
                    del stack[top:]
                elif top is not None or tag in FOREIGN:
                    foreign = True
                    self._open(stack, tag, found.group(3))
                    if _SELF_CLOSED.search(found.group(3)):
                        stack.pop()
                    continue
            foreign = foreign or tag == "template"
            apart = foreign and any(x.tag in FOREIGN or x.tag == "template" for x in stack)
            if found.group(1):
                if tag in BLOCK and not apart:
                    self.pieces.append((None, ""))
                if tag == "p" and not any(x.tag == "p" for x in stack):
                    continue
                if tag not in ("body", "html"):
                    self._end(stack, tag)
                continue
            if not apart and (tag in BLOCK or tag in ("hr", "table")):
                self.pieces.append((None, ""))
            if tag == "br":
                self._text(stack[-1], " ")
            if tag in VOID:
                continue
            if tag in ("html", "body") and len(stack) > 1 and any(x.tag == tag for x in stack):
                continue
            self._open(stack, tag, found.group(3))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else n
                stack.pop()

    @staticmethod
    def _foreign_top(stack: list[Node]) -> int | None:
        """Place of the open drawing or formula that the next tag would lie in."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in FOREIGN:
                return i
            if stack[i].tag in _HTML_INSIDE:
                return None
        return None

    @staticmethod
    def _end(stack: list[Node], tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return
            if stack[i].tag == "template":  # what a template holds does not end what it stands in
                return
            if stack[i].tag in ("table", "td", "th", "body") and tag not in BLOCK:
                return

    def _text(self, node: Node, source: str) -> None:
        if node.hidden or not source:
            return
        self.pieces.append((node, unescape(source) if "&" in source else source))


def join_blocks(pieces: list[tuple[object, str]]) -> str:
    """Text of kept pieces: white space made one space, blocks trimmed and joined by an empty line; a piece without a node ends its block."""
    blocks, now = [], []
    for node, text in [*pieces, (None, "")]:
        if node is not None:
            now.append(text)
        elif now:
            block = _SPACE.sub(" ", "".join(now)).strip()
            if block:
                blocks.append(block)
            now = []
    return "\n\n".join(blocks)
