import pytest
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import text as X
from webloom.functions import urls as U


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "v string").select(*[c(F.col("v")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("İstanbul Üniversitesi!", ["istanbul", "üniversitesi"]), ("don't stop-me", ["don", "t", "stop", "me"]), ("IBM", ["ıbm"]), ("", []), (None, []), ("a a", ["a", "a"]), ("²½ x", ["²½", "x"])],
)
def test_tokens(spark, text, expected):
    assert one(spark, text, X.tokens) == expected


@pytest.mark.parametrize(("text", "expected"), [("a<b>c", "a c"), ("  x \x01 y ", "x y"), (None, ""), ("a < b", "a < b")])
def test_sanitize(spark, text, expected):
    assert one(spark, text, X.sanitize) == expected


@pytest.mark.parametrize("text", ["\ufdd0\\x", "x\U0001f600\\y", "plain", "a\tb\nc\rd", "\\t", "\\\\n\\", "tail\\", "\\\t\\\n", ""])
def test_fields_round_trip(spark, text):
    encoded, back = one(spark, text, X.encode_field, lambda c: X.decode_field(X.encode_field(c)))
    assert back == text and not set(encoded) & set("\t\r\n")


def test_decode_unknown_escape(spark):
    assert one(spark, "a\\qb\\", X.decode_field) == "aqb\\"


@pytest.mark.parametrize(("word", "shard"), [("apple", "a"), ("ıbm", "_misc"), ("9x", "_misc"), ("Zoo", "z")])
def test_shard(spark, word, shard):
    assert one(spark, word, X.shard) == shard


def test_duration(spark):
    row = spark.createDataFrame([(59.0, 3661.0, None)], "a double, b double, c double").select(X.duration(F.col("a")), X.duration(F.col("b")), X.duration(F.col("c"))).first()
    assert tuple(row) == ("00:59", "1:01:01", "00:00")


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://example.com/#section", "https://example.com/"), ("HTTP://Example.COM:80//a//b?q=1#x", "http://example.com/a/b?q=1"), ("https://e.com:443", "https://e.com/"),
        ("http://e.com:443/", "http://e.com:443/"), ("http://e.com/?", "http://e.com/"), ("  http://e.com/A ", "http://e.com/A"), ("", None), (None, None),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, url, U.normalize_url) == expected


@pytest.mark.parametrize(
    ("href", "expected"),
    [("/a", "http://h/a"), ("b?x=1#f", "http://h/d/b?x=1"), ("../c", "http://h/c"), ("//o/z", "http://o/z"), ("https://k/y#q", "https://k/y"), ("#top", "http://h/d/e?p=2"), ("?n=3", "http://h/d/e?n=3"), ("./f/./g/..", "http://h/d/f/")],
)
def test_resolve(spark, href, expected):
    from urllib.parse import urldefrag, urljoin

    assert urldefrag(urljoin("http://h/d/e?p=2", href))[0] == expected
    assert one(spark, href, lambda c: U.resolve(F.lit("http://h/d/e?p=2"), c)) == expected


def test_addresses_must_be_public(spark):
    rows = spark.createDataFrame([("http://a.com/", [134744072]), ("http://b.com/", [134744072, 167772161]), ("http://c.com/", [])], "u string, ips array<long>")
    assert [r[0] for r in rows.select(U.is_valid_url(F.col("u"), F.col("ips"))).collect()] == [True, False, False]


PAGE = '<html><head><title>A &amp; <i>T</i></title><style>p{}</style></head><body><nav><a href="/x#f">Menu</a></nav><p>One <b>two</b>three</p><script>no()</script><p>See <a href="http://o/q">link</a> end</p>&lt;b&gt;</body>'


def test_native_html_agrees_with_parser(spark):
    title, text, snippet, links = H.parse_page("http://h/d/", PAGE)
    got = spark.createDataFrame([("http://h/d/", PAGE)], "u string, h string").select(H.page_text(F.col("h")), H.page_snippet(F.col("h")), H.page_links(F.col("u"), F.col("h")), H.parse_pages("u", "h")).first()
    assert got[0] == text == "Menu One twothree See link end"
    assert got[1] == snippet and got[2] == links == ["http://h/x", "http://o/q"] and got[3]["title"] == title == "A & T"


ODD_PAGES = [
    "<p>caf&eacute; &#8217; &euro; &mdash; &#x41; &hellip;</p>", "<nav><nav>a</nav><p>hid</p></nav><p>b</p>", "<p>a <a>link <p>more", "<a href='/a b'>x</a>", "<p>a<nav><div>x</div></nav>b", "a<!-- c -->b<script>x</script>c",
    "<p>&lt;b&gt; &amp;lt; &copy;&nbsp;1 &middot; &am", "<title>a</title><title>b</title><p>x", "<title>a<i>b</title>c", "<a title='x>y' href=/z>t</a>", "<a data-href=/no href=/yes>t</a>", "<A HREF=' /q ' >t</A>", "<a href=''>e</a><a href>f</a>",
    "1 < 2 <b>x</b> 3 > 2", "<p>one<p>two</p>three</p>four", "<header><p>in</header><p>out", "<p>a<header><p>b</p></header>c</p>", "<a><p>x</a>y</p>", "<x-a>y</x-a><p-q>z", "<script>a<p>b", "<style>p{}</style ><p>s</p>",
    "<textarea><p>t</textarea><p>u", "<!DOCTYPE html><br/>a<br>b<hr>c", "<p/>x<p/>", "</p>x</nav><p>y", "<li>a<li>b", "<![CDATA[x]]><p>y", "<!-->a--><p>b", "<p>" + "word " * 90 + "</p>", "", "plain", "<", "<p", "&", "a&b;c",
    "<a href='http://[bad'>x</a>later", "<a href='javascript:x()'>j</a><a href='HTTP://H/U'>k</a><a href='#f'>g</a>", "<p>x\x00\x01y</p>", "<footer><a href=/f>f</a></footer><p>z<br>w</p>", "<a href='/x'>l<footer></a>m</footer><p>n",
]


def test_every_page_is_read_as_by_the_parser(spark):
    df = spark.createDataFrame([(i, "http://h/d/", p) for i, p in enumerate([*ODD_PAGES, None])], "i int, url string, html string")
    for r in H.parsed(df).collect():
        assert (r.title, r.text, r.snippet, r.links) == H.parse_page("http://h/d/", r.html), r.html


def test_pages_of_random_tags_are_read_as_by_the_parser(spark):
    import random

    rng = random.Random(4)
    parts = ["<p>", "</p>", "<nav>", "</nav>", "<a href='/x'>", "</a>", "<div>", "</div>", "<header>", "</header>", "<b>", "</b>", "<br>", "one", " two ", "&amp;", "<title>", "</title>", "<script>", "</script>", "<!-- c -->", "<h1>", "</h1>", "&eacute;"]
    df = spark.createDataFrame([("http://h/", "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for _ in range(1500)], "url string, html string")
    got = H.parsed(df).withColumn("regular", H.is_regular(F.col("html"))).collect()
    assert sum(r.regular for r in got) > 100
    for r in got:
        assert (r.title, r.text, r.snippet, r.links) == H.parse_page(r.url, r.html), r.html


def test_public_addresses(spark):
    import ipaddress
    import random

    rng = random.Random(3)
    some = [str(ipaddress.IPv6Address(n)) for _ in range(150) for n in (rng.getrandbits(128), 0x2606 << 112 | rng.getrandbits(100), 0x2001 << 112 | rng.getrandbits(112), 0xFE80 << 112 | rng.getrandbits(64), 0xFFFF << 32 | rng.getrandbits(32))]
    some += [ipaddress.IPv6Address(a).exploded for a in some[:100]] + ["::1", "::", "1::2::3", "12345::", "fe80::1%eth0", "::ffff:8.8.8.8", "g::1", ""]
    for r in spark.createDataFrame([(a,) for a in some], "a string").select("a", U.is_public_ipv6(F.col("a")).alias("ok")).collect():
        try:
            ip = ipaddress.IPv6Address(r.a.split("%")[0])
        except ValueError:
            assert not r.ok
            continue
        assert r.ok == (ip.is_global and not ip.is_multicast and ip in ipaddress.IPv6Network("2000::/3") and ip not in ipaddress.IPv6Network("3fff::/20") and ip not in ipaddress.IPv6Network("2001::/23")), r.a


def test_addresses_of_hosts(spark):
    urls = spark.createDataFrame([("http://A.com/",), ("http://b.com/x",), ("http://c.com/",), ("http://8.8.8.8/",), ("ftp://a.com/",)], "url string")
    known = spark.createDataFrame([("a.com", "8.8.8.8"), ("a.com", "2606:4700::1"), ("b.com", "8.8.8.8"), ("b.com", "10.0.0.1")], "host string, address string")
    assert {r.url: r.ok for r in U.resolved(urls, known).collect()} == {"http://A.com/": True, "http://b.com/x": False, "http://c.com/": False, "http://8.8.8.8/": True, "ftp://a.com/": False}


def test_snippet_is_cut(spark):
    assert one(spark, "<p>" + "a" * 300 + "</p>", H.page_snippet) == "a" * 200 + "..."
    assert one(spark, None, H.page_snippet) == ""


def test_parser_on_tag_soup():
    assert H.parse_page("http://h/", "<p>a<nav>b<p>c")[2] == "a"
    assert H.parse_page("", None) == ("", "", "", [])
