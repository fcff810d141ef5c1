"""URL functions as column expressions: canonical form, hash, resolution of links, checks on scheme, host and literal address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hosts that are never fetched (fixed values).
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata.google.internal")
#: IPv4 networks that are not public, as first address and prefix length (IANA special-purpose registry).
CLOSED_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, PARTS, i)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def normalize_url(c: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no doubled slashes in the path; null for empty input."""

    def canonical(u: Column) -> Column:
        scheme, host = F.lower(_part(u, 1)), F.lower(_part(u, 2))
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
        path = F.regexp_replace(_part(u, 3), "/{2,}", "/")
        path = F.when(path == "", "/").otherwise(path)
        query = _part(u, 4)
        whole = F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), F.when(host == "", "").otherwise(F.concat(F.lit("//"), host)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
        return F.when(u != "", whole)

    return let(_trimmed(c), canonical)


def url_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(normalize_url(c), c, F.lit("")), 256)


def host(c: Column) -> Column:
    """Host in lower case, without user, port and brackets."""
    h = F.regexp_replace(F.lower(_part(_trimmed(c), 2)), "^[^@]*@", "")
    return F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(h, ":[0-9]*$", ""))


def origin(c: Column) -> Column:
    u = normalize_url(c)
    return F.concat(_part(u, 1), F.lit("://"), _part(u, 2), F.lit("/"))


def ipv4_number(c: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    pattern = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    octets = [F.try_to_number(F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, i)), F.lit("999")).cast("long") for i in range(1, 5)]
    right = octets[0].between(0, 255) & octets[1].between(0, 255) & octets[2].between(0, 255) & octets[3].between(0, 255)
    return F.when(right, ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3])


def is_public_ipv4(number: Column) -> Column:
    closed = F.lit(False)
    for first, bits in CLOSED_NETWORKS:
        a, b, c, d = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        closed = closed | number.between(low, low + (1 << (32 - bits)) - 1)
    return ~closed


def ipv6_groups(c: Column) -> Column:
    """A literal IPv6 address, zone aside, as its eight numbers, whatever its spelling; null for anything else. The last two may be a dotted address."""
    dotted = r"(\d+\.\d+\.\d+\.\d+)$"

    def plain(a: Column) -> Column:
        number = ipv4_number(F.regexp_extract(a, dotted, 1))
        pair = let(number, lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF)))))
        return F.when(F.regexp_like(a, F.lit(dotted)), F.concat(F.regexp_replace(a, dotted, ""), pair)).otherwise(a)

    def groups(x: Column) -> Column:
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def sides(a: Column) -> Column:
        at = F.instr(a, "::")
        left = F.when(at > 0, F.substring(a, F.lit(1), at - 1)).otherwise(a)
        return F.struct((at > 0).alias("short"), groups(left).alias("l"), groups(F.when(at > 0, F.substring(a, at + 2, F.length(a))).otherwise("")).alias("r"))

    def whole(s: Column) -> Column:
        n = F.size(s["l"]) + F.size(s["r"])
        filled = F.concat(s["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), s["r"])
        return F.when(F.when(s["short"], n < 8).otherwise(n == 8), filled)

    def numbers(w: Column) -> Column:
        return F.when((F.size(w) == 8) & F.forall(w, lambda g: F.regexp_like(g, F.lit("^[0-9a-f]{1,4}$"))), F.transform(w, lambda g: F.conv(g, 16, 10).cast("long")))

    return let(let(let(let(F.regexp_replace(F.lower(c), "%.*$", ""), plain), sides), whole), numbers)


def is_public_ipv6(c: Column) -> Column:
    """Whether a literal IPv6 address is public: of 2000::/3, the only block that is given out, but not special-purpose, documentation or 6to4. Unspecified, loopback, local, link-local and multicast addresses lie outside that block, as do those that hold an IPv4 address. What is no address is not public."""

    def judge(g: Column) -> Column:
        at = lambda i: F.get(g, i)
        documentation = (at(0) == 0x2001) & (at(1) == 0xDB8) | (at(0) == 0x3FFF) & (at(1) < 0x1000)
        special = (at(0) == 0x2001) & (at(1) < 0x200) | (at(0) == 0x2002)
        return at(0).between(0x2000, 0x3FFF) & ~documentation & ~special

    return F.coalesce(let(ipv6_groups(c), judge), F.lit(False))


def is_valid_url(c: Column, addresses: Column | None = None) -> Column:
    """http or https, with a host that is not blocked and, where it is a literal address, public; `addresses`, an array of resolved IPv4 numbers, must be public too. Hosts whose last label is a number that is no part of a dotted address (127.1, 0x7f000001, 2130706433) are refused: resolvers read them as addresses."""
    u, h = _trimmed(F.coalesce(c, F.lit(""))), host(F.coalesce(c, F.lit("")))
    good = F.lower(_part(u, 1)).isin("http", "https") & (h != "") & ~F.rtrim(F.translate(h, ".", " ")).isin(*[x.replace(".", " ") for x in BLOCKED_HOSTS])
    numeric = F.regexp_like(h, F.lit(r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"))
    public = lambda number: F.when(number.isNotNull(), is_public_ipv4(number)).otherwise(~numeric)
    good = good & F.when(F.contains(h, F.lit(":")), is_public_ipv6(h)).otherwise(let(ipv4_number(h), public))
    if addresses is not None:
        good = good & F.coalesce(F.forall(addresses, is_public_ipv4) & (F.size(addresses) > 0), F.lit(False))
    return good


def resolved(urls: DataFrame, addresses: DataFrame, url: str = "url") -> DataFrame:
    """urls with `ok`: is_valid_url() against a table of addresses(host, address), one row for each address of a host, as dotted IPv4 or IPv6 text. A host that the table has not, or one of whose addresses is not public, is refused; literal addresses need no row. The addresses of a host become one flag before they meet the urls."""
    a = F.col("address")
    good = F.when(F.contains(a, F.lit(":")), is_public_ipv6(a)).otherwise(F.coalesce(let(ipv4_number(a), is_public_ipv4), F.lit(False)))
    public = addresses.groupBy(F.lower("host").alias("__host")).agg(F.bool_and(good).alias("__public"))
    h = host(F.col(url))
    literal = F.contains(h, F.lit(":")) | ipv4_number(h).isNotNull()
    rows = urls.join(public, h == F.col("__host"), "left")
    return rows.withColumn("ok", is_valid_url(F.col(url)) & (literal | F.coalesce("__public", F.lit(False)))).drop("__host", "__public")


def _dotless(path: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(path, "/")
    n = F.size(parts)

    def step(done: Column, x: Column) -> Column:
        back = F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
        return F.when(x == ".", done).when(x == "..", back).otherwise(F.concat(done, F.array(x)))

    ends = F.element_at(parts, -1).isin(".", "..")
    folded = F.aggregate(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    return F.array_join(F.when(ends, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")


def resolve(base: Column, href: Column) -> Column:
    """A link as an absolute URL without fragment, by RFC 3986."""
    h = _trimmed(href)
    scheme, net, path, query = (_part(h, i) for i in range(1, 5))
    b_scheme, b_net, b_path, b_query = (_part(base, i) for i in range(1, 5))
    q = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    folder = F.regexp_replace(F.when(b_path == "", "/").otherwise(b_path), "[^/]*$", "")
    own = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    same = F.concat(b_scheme, F.lit("://"), b_net)
    empty = F.concat(same, b_path, F.when(query != "", q).when(b_query != "", F.concat(F.lit("?"), b_query)).otherwise(""))
    return (
        F.when(scheme != "", F.regexp_replace(h, "#.*$", ""))
        .when(net != "", F.concat(b_scheme, F.lit("://"), net, _dotless(path), q))
        .when(path == "", empty)
        .otherwise(F.concat(same, _dotless(own), q))
    )
