"""Text functions as column expressions: folding, tokens, markup removal, hashes, flat-file fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters that count as blanks.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def fold(c: Column) -> Column:
    """Lower case by Turkish rules for the two capital I; null gives the empty text."""
    return F.lower(F.translate(F.coalesce(c.cast("string"), F.lit("")), "İI", "iı"))


def tokens(c: Column) -> Column:
    """Maximal runs of letters and numbers of the folded text, in order, repeats included."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def word_key(c: Column) -> Column:
    """A looked-up word as the index holds it."""
    return fold(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def sanitize(c: Column) -> Column:
    """Tags and control characters as blanks, white space runs as one blank, trimmed; null gives the empty text."""
    c = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "<[^>]+>", " ")
    c = F.regexp_replace(F.regexp_replace(c, CONTROL, " "), r"(?U)\s+", " ")
    return F.trim(c)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def encode_field(c: Column) -> Column:
    """Backslash, tab, carriage return and line feed escaped, for one field of a line."""
    for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def decode_field(c: Column) -> Column:
    """The inverse: an unknown escape stands for its character, a lone backslash at the end for itself. The text is taken apart into escapes and what lies between, so that every character may stand in it."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\]+|\\$)"), 1)
    escaped = lambda p: p.startswith("\\") & (F.length(p) == 2)
    one = lambda p: F.when(p == "\\t", "\t").when(p == "\\r", "\r").when(p == "\\n", "\n").when(escaped(p), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def shard(word: Column) -> Column:
    """The letter a to z a word begins with, or _misc."""
    first = F.lower(F.substring(word, 1, 1))
    return F.when(F.regexp_like(first, F.lit("^[a-z]$")), first).otherwise("_misc")


def duration(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss below an hour."""
    s = F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0))).cast("int"))
    h, m, rest = F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), (s % 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%02d:%02d", m, rest))
