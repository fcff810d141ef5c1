r"""Words of a document that lie in passages which other documents have too.

A passage is a string of `words` words (51: over 50), words being runs of bytes other than [\x20\x09-\x0D], compared byte by byte apart from
the white space between them. Every such window names an anchor, its leftmost gram of least hash among those inside it, which depends on its words alone,
so equal windows have equal anchors. Neighbouring windows with one anchor form a run. Anchors of one document only go first: all but a few
runs of a corpus end there, as two numbers each. Of the rest, runs equal as a whole are one class of any number of copies; a class
of several documents is shared as it is. Anchors that have other classes too give the windows of those, and of one run of each shared class, which meet by
their hash. No group of rows comes together anywhere; counting starts before each shuffle.

Defined results: null counts as empty; texts of fewer words share nothing; passages that a document repeats within itself only
are none; rows that repeat both id and text count as one document. Words are equal by 64 bits of hash, windows by 128 bits over their words'.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, maybe_in, slices, small_batches, tidy

WORDS, GRAM = 51, 16
#: Words of one document handled at a time.
PART = 1 << 20
#: Odd multipliers of the two range hashes and of what mixes them (fixed numbers).
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return x ^ x >> np.uint64(29)


class Ranges:
    """Two 64-bit hashes of any range of words, from their prefix sums."""

    def __init__(self, words: np.ndarray):
        self.sums, self.back = [], []
        for k, b in enumerate(BASES):
            w = mixed(words + np.uint64(k)) if k else words
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _powers(len(words), int(b)))]))
            self.back.append(_powers(len(words) + 1, pow(int(b), -1, 1 << 64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mixed((s[end] - s[start]) * b[start]) for s, b in zip(self.sums, self.back, strict=True)]


_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that are hashed at a time.
CHUNK = 1 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base, and of its inverse modulo 2**64."""
    base = 0xC2B2AE3D27D4EB4F
    return _powers(n, base), _powers(n, pow(base, -1, 1 << 64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, of its bytes and length, and where each text's words begin (and the last one's end)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    solid = _SOLID[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(raw))]  # a word ends with its text
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK)))
        a, n = starts[i], int(ends[j - 1] - starts[i])
        power, inverse = _tables(2 * CHUNK if n <= 2 * CHUNK else 1 << n.bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw[a : a + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        x, y = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mixed((sums[y] - sums[x]) * inverse[x] + (y - x).astype(np.uint64) * MIX)
        i = j
    return out, np.searchsorted(starts, offs)


def anchors(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents words[starts:ends]: document, first window (in words), windows, anchor and two hashes of each run."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if len(words) < width:
        return none
    ranges, grams = Ranges(words), np.arange(len(words) - gram + 1)
    h = ranges.of(grams, grams + gram)[0]
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (grams.astype(np.uint64) & low)  # ties go to the leftmost
    m, size, over = key, 1, width - gram + 1
    while 2 * size <= over:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: len(m) - (over - size)], m[over - size :]) if over > size else m
    p = (m & low).astype(np.int64)
    doc = np.full(len(p), -1, np.int64)
    for d, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a >= width:
            doc[a : b - width + 1] = d
    ok = doc >= 0
    first = ok.copy()
    first[1:] &= (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    last = ok.copy()
    last[:-1] &= first[1:] | ~ok[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return doc[a], a, b - a + 1, h[p[a]], *ranges.of(a, b + width)


def _parts(words: np.ndarray, ends: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a few documents, or of parts of one that share width - 1 words: which document, its first word here, the words."""
    rows, firsts, parts, size = [], [], [], 0
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for at in range(a, max(a + 1, b - width + 1), PART):
            part = words[at : min(b, at + PART + width - 1)]
            if len(part) < width:
                continue
            if size and size + len(part) > 2 * PART:
                yield np.array(rows), np.array(firsts), parts
                rows, firsts, parts, size = [], [], [], 0
            rows.append(k)
            firsts.append(at - a)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(rows), np.array(firsts), parts


def _runs(keyed: DataFrame, width: int, gram: int) -> DataFrame:
    """doc_id, th, a (first window), nw (windows), ah, r1, r2 of each run of keyed(doc_id, th, text)."""
    names = ["doc_id", "th", "a", "nw", "ah", "r1", "r2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(2), 1 << 20):
                words, ends = word_hashes(b.column(2).slice(i, j - i))
                for rows, firsts, parts in _parts(words, ends, width):
                    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                    after = np.cumsum(sizes)
                    d, a, nw, ah, r1, r2 = anchors(np.concatenate(parts), after - sizes, after, width, gram)
                    who = pa.array(rows[d] + i)
                    at = a - (after - sizes)[d] + firsts[d]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(at.astype(np.int64)), pa.array(nw.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (ah, r1, r2)]], names)

    return keyed.mapInArrow(tidy(run), f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, th long, a long, nw int, ah long, r1 long, r2 long")


def shared_words(keyed: DataFrame, words: int = WORDS, gram: int | None = None) -> DataFrame:
    """doc_id, th, spans: ranges [s, e) of words of keyed(doc_id, th, text) that lie in a string of `words` words which also stands in another document, for documents that have some. Ranges of a document may overlap."""
    gram = min(GRAM, (words + 2) // 3) if gram is None else gram
    if not 1 <= gram <= words:
        raise ValueError("gram must be at least 1 and at most words")
    small_batches(keyed.sparkSession)
    found = cut(_runs(keyed, words, gram))
    doc = F.xxhash64("doc_id", "th")
    several = F.min(doc) != F.max(doc)
    common = found.groupBy("ah").agg(several.alias("several")).where("several").select(F.col("ah").alias("ah2"))
    common = cut(common, few=True)
    some = cut(maybe_in(found, F.col("ah"), common).join(common, F.col("ah") == F.col("ah2"), "left_semi").drop("ah2"))
    forget(found, common)
    parts = ("doc_id", "th", "a", "nw")  # of any one run of a class, all from the same row
    classes = cut(some.groupBy("ah", "r1", "r2").agg(several.alias("several"), *[F.first(c).alias(c) for c in parts]), few=True)
    same = (F.col("ah") == F.col("ah2")) & (F.col("r1") == F.col("x1")) & (F.col("r2") == F.col("x2"))
    whole = some.join(classes.where("several").select(F.col("ah").alias("ah2"), F.col("r1").alias("x1"), F.col("r2").alias("x2")), same, "left_semi")
    spans = whole.select("doc_id", "th", F.col("a").alias("s"), (F.col("a") + F.col("nw") - 1 + words).alias("e"))
    both = classes.groupBy("ah").agg(F.count(F.lit(1)).alias("k"), F.bool_and("several").alias("all")).where("k > 1 and not all").select(F.col("ah").alias("ah2"))
    open_classes = classes.join(both, F.col("ah") == F.col("ah2"), "left_semi")
    own = some.join(open_classes.where("not several").select(F.col("ah").alias("ah2"), F.col("r1").alias("x1"), F.col("r2").alias("x2")), same, "left_semi")
    wanted = open_classes.where("several").select(*parts, "several").unionByName(own.select(*parts, F.lit(False).alias("several")))
    windows = cut(_windows(keyed, wanted, words))
    counts = windows.groupBy("w1", "w2").agg((several | F.bool_or("several")).alias("shared")).where("shared").select(F.col("w1").alias("x1"), F.col("w2").alias("x2"))
    met = windows.where("not several").join(counts, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")), "left_semi")
    spans = spans.unionByName(met.select("doc_id", "th", "s", (F.col("s") + words).alias("e")))
    lists = cut(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), few=True)  # of one document
    forget(some, classes, windows)
    return lists


def _windows(keyed: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id, th, several, s, w1, w2: the windows of the wanted(doc_id, th, a, nw, several) runs."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "nw", "several")).alias("w")).withColumnsRenamed({"doc_id": "d", "th": "t"})  # a document's own runs
    lists = cut(lists, few=True)
    both = maybe_in(keyed, F.col("th"), lists.select("t")).join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "text", "w")
    names = ["doc_id", "th", "several", "s", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ranges = Ranges(word_hashes(b.column(2).slice(k, 1))[0])
                a, nw, several = (x.to_numpy(zero_copy_only=False) for x in b.column(3).slice(k, 1).flatten().flatten())
                total = int(nw.sum())
                s = np.repeat(a, nw) + np.arange(total) - np.repeat(np.cumsum(nw) - nw, nw)
                again = pa.array(np.full(total, k))
                w1, w2 = ranges.of(s, s + width)
                yield pa.RecordBatch.from_arrays([b.column(0).take(again), b.column(1).take(again), pa.array(np.repeat(several, nw)), pa.array(s.astype(np.int64)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names)

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(tidy(run), f"doc_id {kind}, th long, several boolean, s long, w1 long, w2 long")
