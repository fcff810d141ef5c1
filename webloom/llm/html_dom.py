"""A small tolerant HTML parser: element trees with bounded depth, as page alignment needs them."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph when they begin.
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an element's beginning ends, up to which elements.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
#: An end tag or an implied end looks no further up than these.
SCOPE = frozenset("html body article main section div nav aside header footer td th table ul ol dl form blockquote".split())
DEPTH = 150

_TAG = re.compile(r"""<!--(?:.*?-->|>|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    @property
    def label(self) -> str:
        """What alignment compares: the tag, class names and id, digits aside."""
        if not self.attrs:
            return self.tag
        return _DIGITS.sub("#", f"{self.tag}.{' '.join(sorted(self.attrs.get('class', '').split()))}#{self.attrs.get('id', '')}")


def _attributes(text: str) -> dict[str, str]:
    if len(text) < 3:
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def parse(text: str) -> Node:
    """The tree of a page. Kids are nodes and texts with character references decoded."""
    root = Node("html", {})
    stack, at, end = [root], 0, len(text)
    find = _TAG.search

    def add(s: str) -> None:
        if s:
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    while at < end:
        m = find(text, at)
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            _close(stack, tag)
            continue
        rest = m[3] or m[6] or ""
        if tag in ("html", "body", "head") and any(x.tag == tag for x in stack):
            continue
        if tag in BLOCK:
            _imply(stack, ("p",), SCOPE)
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            while _imply(stack, names, stop):
                pass
        node = Node(tag, _attributes(rest))
        stack[-1].kids.append(node)
        if tag in VOID or rest.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(text, at)
            body = text[at : close.start() if close else end]
            node.kids.append(html.unescape(body) if tag in ("title", "textarea") else body)
            gt = text.find(">", close.end()) if close else -1
            at = gt + 1 if gt >= 0 else end
            continue
        if len(stack) < DEPTH:
            stack.append(node)
    return root


def _imply(stack: list[Node], names: tuple[str, ...], stop: tuple[str, ...] | frozenset[str]) -> bool:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in names:
            del stack[i:]
            return True
        if stack[i].tag in stop:
            return False
    return False


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag in INLINE and stack[i].tag not in INLINE or tag == "p" and stack[i].tag in SCOPE:
            return
        if tag not in SCOPE and stack[i].tag in ("article", "main", "body", "table"):
            return
