"""HTML functions: native column expressions for regular markup, a tolerant parser in an Arrow function for all other, and parsed(), which sends each page to the one that reads it right."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import sanitize
from .urls import normalize_url, resolve

#: Elements around whose text a blank stands (fixed list), and those whose text a snippet leaves out.
BLOCKS = ("p", "br", "div", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dd", "dt", "dl", "tr", "td", "th", "table", "pre", "blockquote")
SNIPPET_SKIPS = ("nav", "header", "footer", "a")
HIDDEN = ("script", "style")
LONGEST = 200
BLOCK_RE = "|".join(BLOCKS)
SKIP_RE = "|".join(SNIPPET_SKIPS)
UNSEEN = r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<!doctype[^>]*>"
REMOVED = rf"{UNSEEN}|<title\b[^>]*>.*?(?:</title\s*>|$)"
#: Character references that are decoded natively, the ampersand last; pages with others go to the parser.
REFERENCES = (("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&(?:#39;?|apos;)", "'"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&"))
HREF = r"""(?is)<a\s(?:[^>]*?[\s"'])?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Signs of markup that the expressions may read differently from a parser, in the text without scripts, styles, comments and title.
ODD = "|".join((
    r"&(?!(?:nbsp|lt|gt|quot|amp|copy|middot|apos|#39);)[A-Za-z#]",  # another reference, or one without its end
    r"</?[a-z][a-z0-9]*[-:._]",  # an element of another kind whose name begins like one of ours
    r"<(?:textarea|xmp|iframe|noembed|noframes|plaintext|title|script|style)\b",  # text that is no markup, or what was not closed
    rf"<({SKIP_RE})\b[^>]*+>(?:[^<]++|<(?!/?\1\b))*+<\1\b",  # an element inside its like
    rf"<p\b[^>]*+>(?:[^<]++|<(?!/p\b|(?:{SKIP_RE})\b))*+<(?:{SKIP_RE})\b[^>]*+>(?:[^<]++|<(?!/(?:{SKIP_RE})\b|/?p\b))*+</?p\b",  # paragraphs across what a snippet leaves out
    rf"<({SKIP_RE})\b[^>]*+>(?:[^<]++|<(?!/?\2\b|p\b))*+<p\b[^>]*+>(?:[^<]++|<(?!/p\b|/\2\b))*+</\2\b",
    rf"<(?:p|{SKIP_RE})\b[^>]*+(?<=/)>",  # both a beginning and an end
    r"""href\s*=\s*["']?[^"'>]*[\t\n\r\[\]]""",  # links that a resolver treats in a way of its own
    r"""href\s*=\s*["']?\s*(?:(?-i:[a-z]*[A-Z][A-Za-z0-9+.\-]*:)|https?:(?!//))""",
))
#: A tag whose quotes hold no angle brackets.
TAG = r"""</?[A-Za-z][^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+>"""


def unescape(c: Column) -> Column:
    for pattern, text in REFERENCES:
        c = F.regexp_replace(c, pattern, text)
    return c


def is_regular(html: Column) -> Column:
    """Whether the native expressions read a page as a parser does."""
    c = F.coalesce(html, F.lit(""))
    seen = F.regexp_replace(c, REMOVED, "")
    title = F.regexp_extract_all(c, F.lit(r"(?is)<title\b[^>]*>(.*?)</title\s*>"), 1)
    without = F.regexp_replace(seen, rf"(?is)<({SKIP_RE})\b[^>]*>.*?</\1\s*>", "")
    return (
        ~F.regexp_like(seen, F.lit(f"(?is){ODD}"))
        & ~F.contains(F.regexp_replace(seen, TAG, ""), F.lit("<"))
        & ~F.regexp_like(without, F.lit(rf"(?i)</?(?:{SKIP_RE})\b"))
        & ~F.regexp_like(c, F.lit("<!--(?:-?>)|--!>"))
        & (F.size(title) <= 1)
        & ~F.exists(title, lambda t: F.regexp_like(t, F.lit("<|&(?!(?:nbsp|lt|gt|quot|amp|copy|middot|apos|#39);)[A-Za-z#]")))
        & ~F.regexp_like(F.regexp_replace(c, r"(?is)<(script|style|title)\b[^>]*>.*?</\1\s*>", ""), F.lit(r"(?i)<(?:script|style|title)\b"))
        & (F.regexp_count(c, F.lit("<!--")) == F.regexp_count(c, F.lit("-->")))
    )


def page_text(html: Column) -> Column:
    """All text of a regular page but that of scripts, styles and the title; blocks part words, inline tags do not."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), REMOVED, "")
    c = F.regexp_replace(c, rf"(?is)</?(?:{BLOCK_RE})\b[^>]*>", " ")
    return sanitize(unescape(F.regexp_replace(c, "(?s)<[^>]+>", "")))


def page_title(html: Column) -> Column:
    """The title's text, its first 200 characters."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    return F.substring(sanitize(unescape(F.regexp_extract(c, r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|$)", 1))), 1, LONGEST)


def page_snippet(html: Column) -> Column:
    """Text of a regular page's paragraphs outside menus, headers, footers and links: 200 characters, with dots if there are more."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), REMOVED, "")
    c = F.regexp_replace(c, rf"(?is)<({SKIP_RE})\b[^>]*>.*?</\1\s*>", "")
    c = F.array_join(F.regexp_extract_all(c, F.lit(r"(?is)(<p\b[^>]*>.*?(?:</p>|$))"), 1), "")
    c = F.regexp_replace(c, rf"(?is)<(?:{BLOCK_RE})\b[^>]*>", " ")
    c = sanitize(unescape(F.regexp_replace(c, "(?s)<[^>]+>", "")))
    return F.when(F.length(c) > LONGEST, F.concat(F.rtrim(F.substring(c, 1, LONGEST)), F.lit("..."))).otherwise(c)


def page_links(url: Column, html: Column) -> Column:
    """Absolute http(s) links of a regular page, without fragments, each once, sorted."""
    hrefs = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), REMOVED, ""), F.lit(HREF), 1)
    bare = F.transform(hrefs, lambda h: F.trim(F.when(h.startswith('"') | h.startswith("'"), F.substring(h, F.lit(2), F.length(h) - 2)).otherwise(h)))
    found = F.transform(F.filter(bare, lambda h: h != ""), lambda h: resolve(url, unescape(h)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda u: F.regexp_like(u, F.lit("^(?i)https?://[^/?#]")))))


class _Events(HTMLParser):
    """What a parser meets, in order: (kind, name or text, href of a link)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.met: list[tuple[str, str, str]] = []

    def handle_starttag(self, tag, attrs):
        self.met.append(("open", tag, next((v.strip() for k, v in attrs if k == "href" and v), "")))

    def handle_endtag(self, tag):
        self.met.append(("close", tag, ""))

    def handle_data(self, data):
        self.met.append(("text", data, ""))


def _clean(parts: list[str]) -> str:
    s = re.sub("<[^>]+>", " ", "".join(parts))
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", s)).strip()


def _link(base: str, href: str) -> str | None:
    u = urldefrag(urljoin(base, href) if base else href)[0]
    return u if u and urlsplit(u).scheme in ("http", "https") else None


def parse_page(base: str, html: str) -> tuple[str, str, str, list[str]]:
    """title, text, snippet, links of any page, folded over what the parser meets; whatever was found before an error stays."""
    events = _Events()
    title, text, snippet, links = [], [], [], set()
    hidden = titled = inside = False
    skipped = 0
    try:
        try:
            events.feed(html or "")
            events.close()
        finally:
            for kind, x, href in events.met:
                if kind == "text":
                    if hidden:
                        continue
                    (title if titled else text).append(x)
                    if inside and not skipped and not titled:
                        snippet.append(x)
                    continue
                opens = kind == "open"
                if x in HIDDEN:
                    hidden = opens
                elif x == "title":
                    titled = opens
                else:
                    inside = opens if x == "p" else inside
                    if x in SNIPPET_SKIPS:
                        skipped = max(0, skipped + (1 if opens else -1))
                    if x in BLOCKS:
                        text.append(" ")
                        if opens and inside and not skipped:
                            snippet.append(" ")
                    if opens and x == "a" and href and (u := _link(base or "", href)):
                        links.add(u)
    except Exception:  # noqa: BLE001  tolerant by contract
        pass
    short = _clean(snippet)
    return _clean(title)[:LONGEST], _clean(text), short[:LONGEST].rstrip() + "..." if len(short) > LONGEST else short, sorted(links)


PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "text", "snippet")] + [T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(PAGE)
def parse_pages(base: pd.Series, html: pd.Series) -> pd.DataFrame:
    """parse_page() over batches; a null page gives nulls."""
    none = (None, None, None, None)
    return pd.DataFrame([none if h is None else parse_page(b, h) for b, h in zip(base, html, strict=True)], columns=["title", "text", "snippet", "links"])


def parsed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with title, text, snippet and links. Regular pages are read by expressions; the parser sees only the others, the column of pages that goes to it being null elsewhere."""
    u, h = F.col(url), F.col(html)
    rows = pages.withColumn("__odd", ~is_regular(h))
    rows = rows.withColumn("__soup", parse_pages(u, F.when(F.col("__odd"), F.coalesce(h, F.lit("")))))
    native = {"title": page_title(h), "text": page_text(h), "snippet": page_snippet(h), "links": page_links(u, h)}
    return rows.withColumns({c: F.when(F.col("__odd"), F.col(f"__soup.{c}")).otherwise(x) for c, x in native.items()}).drop("__odd", "__soup")


__all__ = ["is_regular", "normalize_url", "page_links", "page_snippet", "page_text", "page_title", "parse_page", "parse_pages", "parsed", "unescape"]
