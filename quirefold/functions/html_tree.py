"""A forgiving HTML parser: the tree of a page's block elements."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

# HTML elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noscript template iframe".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: Elements that a start tag ends if they are open, up to the listed container.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

# As browsers read tags: a quote opens a value only after an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|[^<]+|<", re.S)
SPACE = re.compile(r"\s+")


class Node:
    """A block element: its label, whether it is boilerplate by meaning, and its parts in order."""

    __slots__ = ("tag", "off", "parts", "index", "hidden_text")

    def __init__(self, tag: str, off: bool = False):
        self.tag, self.off, self.parts, self.index = tag, off, [], -1


def _nothing(tag: str, attributes: str, in_article: bool) -> bool:
    return False


def parse(source: str, is_off: Callable[[str, str, bool], bool] = _nothing) -> Node:
    """Block tree of a page; unclosed and misnested tags are mended as browsers do in the common cases.

    is_off(tag, attributes, inside an article) tells which elements are marked as off; those are nodes even if inline.
    """
    root = Node("html")
    stack, articles = [root], 0
    at, end = 0, len(source)
    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                stack[-1].parts.append(text)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br":
                stack[-1].parts.append(" ")
            elif any(n.tag == tag for n in stack[1:]):
                while stack[-1].tag != tag:
                    articles -= stack.pop().tag in ("article", "main")
                articles -= stack.pop().tag in ("article", "main")
            continue
        if tag in ("html", "body"):
            continue
        attributes = m.group(3)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                stack[-1].parts.append(Node("hr"))
            elif tag in ("br", "wbr"):
                stack[-1].parts.append(" " if tag == "br" else "")
            continue
        off = is_off(tag, attributes, articles > 0)
        if tag not in BLOCK and not off:
            continue  # an inline element: its text belongs to the block around it
        if tag in CLOSES_P and any(n.tag == "p" for n in stack[-3:]):
            while stack[-1].tag != "p":
                stack.pop()
            stack.pop()
        elif tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    break
        node = Node(tag, off)
        stack[-1].parts.append(node)
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        stack.append(node)
        articles += tag in ("article", "main")
    return root


def clean(text: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    return SPACE.sub(" ", html.unescape(text)).strip()
