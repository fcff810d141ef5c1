r"""Removal of repeated passages by longest-previous-factor arrays.

The longest previous factor of a position is the longest string that starts there and also starts earlier. It comes from
the suffix array: of the suffixes before and after a suffix in suffix order, the nearest ones that start earlier in the text
(previous and next smaller positions) share the longest prefixes with it. The same with later positions gives the
longest later match. Bytes covered by a string of `min_bytes` with such a match are repeats.

One suffix array over a large corpus would move every suffix. Instead every window of min_bytes bytes names an anchor, its
leftmost gram of least hash, which depends on its bytes alone, so equal windows have equal anchors at equal offsets.
Neighbouring windows with one anchor form a run (about one for 140 bytes). Runs equal as a whole, by a digest of all their bytes, are
counted first, which makes one class of any number of copies; only anchors that have several different classes need the
suffix array, built over one representative of each class, for as many anchors at a time as a buffer holds. Anchors whose classes
exceed the buffer (a hot passage in ever new surroundings) are dealt out window by window instead, by a digest of the whole
window, which needs no two of them in one task. Nothing is dropped or capped on either way.

Defined results: texts are UTF-8 bytes; null counts as empty; texts shorter than min_bytes lose nothing; matches never
cross documents; rows that repeat are copies of each other, so both lose what they share, but with keep_first=True keep it
both, as nothing tells the first of them; kept bytes may split a character, so texts come back as bytes; an empty table
gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, maybe_in, named, slices, small_batches, tidy
from .passages import shared_words

MIN_BYTES, GRAM = 400, 128
#: Bytes of representatives in one suffix array; anchors with more take the way by windows.
BUFFER = 1 << 20
#: Window starts of one document handled at a time: positions fit the low bits of a key.
PART, POSITION_BITS = 4 << 20, np.uint64(24)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x94D049BB133111EB)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each gram (a power of 2 bytes), by doubling; shorter than data by gram - 1."""
    h = (data.astype(np.uint64) + np.uint64(1)) * ODD[0]
    h ^= h >> np.uint64(32)
    size, level = 1, 0
    while size < gram:
        a = h[:-size] * ODD[1 + level % 7]
        a += h[size:]
        a ^= a >> np.uint64(29)
        h, size, level = a, 2 * size, level + 1
    h *= ODD[0]
    h ^= h >> np.uint64(31)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (width - size)], m[width - size :]) if width > size else m


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents data[starts:ends], none longer than the positions hold: document, first window (in data), windows, offset of the anchor, anchor hash, and the two halves of a digest of the run's bytes."""
    width = min_bytes - gram + 1
    if len(data) < min_bytes:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.int64, np.int64))
    h = gram_hashes(data, gram)
    low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    p = (sliding_min(key, width) & low).astype(np.int32)
    ok = np.zeros(len(p), bool)
    doc = np.full(len(p), -1, np.int32)
    for d, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a >= min_bytes:
            ok[a : b - min_bytes + 1] = True
            doc[a : b - min_bytes + 1] = d
    first = ok.copy()
    first[1:] &= (p[1:] != p[:-1]) | ~ok[:-1] | (doc[1:] != doc[:-1])
    last = ok.copy()
    last[:-1] &= first[1:] | ~ok[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    anchor = p[a].astype(np.int64)
    end = b + min_bytes
    r1, r2 = digest_halves(data, a, end)
    return doc[a].astype(np.int64), a, b - a + 1, anchor - a, h[anchor], r1, r2


def digest_halves(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of 128 bits of each range of bytes, as two longs: equality of ranges rests on a cryptographic digest of all their bytes."""
    view = memoryview(data)
    got = b"".join([hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
    halves = np.frombuffer(got, np.int64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


class Suffixes:
    """The suffix array of data up to `depth` bytes, by rank doubling, with longest common extensions of any two positions."""

    def __init__(self, data: np.ndarray, depth: int):
        n = len(data)
        self.data = data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.zeros((n, 8), np.uint8)
        for k in range(8):
            words[:, 7 - k] = padded[k : n + k]
        key = words.reshape(-1).view(np.uint64)
        self.levels: list[tuple[int, np.ndarray]] = []
        order = np.argsort(key)
        # ranks are the first place of those that are equal so far; only these are sorted again
        rank, places, size = np.empty(n, np.int32), np.arange(n), 8
        pos, ordered = order, key[order]
        while True:
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            first = places[np.flatnonzero(new)][np.cumsum(new) - 1]
            rank = rank.copy()
            rank[pos] = first
            self.levels.append((size, rank))
            if size >= depth:
                break
            alone = new & np.append(new[1:], True)
            places, pos = places[~alone], pos[~alone]
            after = pos + size
            key = rank[pos].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key)
            pos, ordered = pos[by], key[by]
            order[places] = pos
            size *= 2
            if not len(pos):
                self.levels.append((size, rank))
                break
        self.order = order.astype(np.int64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that the strings from i and from j have in common, at most to the end of data and about twice the depth."""
        i, j, n = i.copy(), j.copy(), len(self.data)
        got = np.zeros(len(i), np.int64)
        most = n - np.maximum(i, j)
        for size, rank in reversed(self.levels):
            same = (i < n) & (j < n)
            same[same] = rank[i[same]] == rank[j[same]]
            step = same * size
            i, j, got = i + step, j + step, got + step
        for _ in range(8):
            same = (i < n) & (j < n)
            same[same] = self.data[i[same]] == self.data[j[same]]
            i, j, got = i + same, j + same, got + same
        return np.minimum(got, most)


def _nearest_smaller(pos: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it, not before its head, with a smaller position; -1 if none. Pointer jumping over places known to hold larger ones."""
    at = np.arange(len(pos)) - 1
    at[at < head] = -1
    live = np.flatnonzero(at >= 0)
    live = live[pos[at[live]] > pos[live]]
    while len(live):
        at[live] = at[at[live]]
        live = live[at[live] >= 0]
        live = live[pos[at[live]] > pos[live]]
    return at


def longest_matches(data: np.ndarray, min_bytes: int, later: bool = False, valid: np.ndarray | None = None, suffixes: Suffixes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of its longest earlier (or later) match and where that starts; 0 and -1 below min_bytes. Lengths are exact up to min_bytes, and at least that beyond. valid: the positions that take part."""
    n = len(data)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if n <= min_bytes:
        return length, source
    s = suffixes or Suffixes(data, min_bytes)
    order = s.order if valid is None else s.order[valid[s.order]]
    near = max((x for x in s.levels if x[0] <= min_bytes), key=lambda x: x[0])[1][order]  # neighbours can only share enough if they share this
    link = np.zeros(len(order), bool)
    may = np.flatnonzero(near[1:] == near[:-1]) + 1
    link[may] = s.common(order[may - 1], order[may]) >= min_bytes
    inside = link | np.concatenate([link[1:], [False]])
    places = np.flatnonzero(inside)
    if not len(places):
        return length, source
    pos = order[places]
    starts = ~link[places]
    head = np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))
    by = -pos if later else pos
    before = _nearest_smaller(by, head)
    m = len(places)
    tail_head = (m - 1 - np.minimum.accumulate(np.where(np.append(starts[1:], True), np.arange(m), m)[::-1])[::-1])[::-1]
    after = m - 1 - _nearest_smaller(by[::-1], tail_head)[::-1]
    after[after == m] = -1
    best, where = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    for other in (before, after):
        has = np.flatnonzero(other >= 0)
        got = s.common(pos[has], pos[other[has]])
        better = got > best[has]
        best[has[better]], where[has[better]] = got[better], pos[other[has]][better]
    good = best >= min_bytes
    length[pos[good]], source[pos[good]] = best[good], where[good]
    return length, source


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as maximal ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _merged(spans: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    return merge_spans(*[x.to_numpy(zero_copy_only=False) for x in spans.slice(k, 1).flatten().flatten()])


def _parts(raw: bytes, min_bytes: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, max(1, len(raw) - min_bytes + 1), PART):
        yield at, raw[at : at + PART + min_bytes - 1]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    return docs.select(named(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def runs(keyed: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """doc_id, th, a (first window), nw (windows), off (of the anchor in the run), ah, r1 and r2 (a digest of the run)."""
    names = ["doc_id", "th", "a", "nw", "off", "ah", "r1", "r2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(2), 1 << 20):
                row, base, pieces = [], [], []
                for k, raw in enumerate(pc.cast(b.column(2).slice(i, j - i), pa.binary()).to_pylist()):
                    if len(raw) >= min_bytes:
                        for at, piece in _parts(raw, min_bytes):
                            row.append(k)
                            base.append(at)
                            pieces.append(piece)
                k = after = 0
                while after < len(pieces):  # at most two parts' bytes at a time
                    k, size = after, 0
                    while after < len(pieces) and size < PART:
                        size += len(pieces[after])
                        after += 1
                    some = pieces[k:after]
                    lens = np.fromiter(map(len, some), np.int64, len(some))
                    ends = np.cumsum(lens)
                    d, a, nw, off, ah, r1, r2 = runs_of(np.frombuffer(b"".join(some), np.uint8), ends - lens, ends, min_bytes, gram)
                    of = pa.array(np.array(row[k:after], np.int64)[d] + i)
                    begin = a - (ends - lens)[d] + np.array(base[k:after], np.int64)[d]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(begin), pa.array(nw.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(ah.view(np.int64)), pa.array(r1), pa.array(r2)], names)

    return keyed.mapInArrow(tidy(run), f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, th long, a long, nw int, off int, ah long, r1 long, r2 long")


def _segments(keyed: DataFrame, wanted: DataFrame, min_bytes: int) -> DataFrame:
    """wanted(doc_id, th, a, nw, off, ah, big) with the bytes of each run."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "nw", "off", "ah", "big")).alias("w"))  # at most a document's own runs
    lists = lists.withColumnsRenamed({"doc_id": "d", "th": "t"})
    lists = cut(lists, few=True)
    both = maybe_in(keyed, F.col("th"), lists.select("t")).join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "text", "w")
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = b.column(2)[k].as_buffer().to_pybytes()
                w = b.column(3).slice(k, 1).flatten().flatten()
                a, nw = w[0].to_pylist(), w[1].to_pylist()
                for c in range(0, len(a), 4000):
                    n = len(a[c : c + 4000])
                    seg = [raw[x : x + m - 1 + min_bytes] for x, m in zip(a[c : c + 4000], nw[c : c + 4000], strict=True)]
                    again = pa.array(np.full(n, k))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(again), b.column(1).take(again), *[x.slice(c, n) for x in w], pa.array(seg, pa.binary())], ["doc_id", "th", "a", "nw", "off", "ah", "big", "seg"])

    return both.mapInArrow(tidy(run), f"doc_id {kind}, th long, a long, nw int, off int, ah long, big boolean, seg binary")


def _by_suffixes(segments: DataFrame, min_bytes: int, keep_first: bool) -> DataFrame:
    """doc_id, th, s, e: spans of repeated windows among the segments of each anchor, which lie together, in corpus order."""
    kind = segments.schema["doc_id"].dataType.simpleString()
    rows = segments.select("ah", "doc_id", "th", "a", "nw", "seg").repartition("ah").sortWithinPartitions("ah")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().sort_by([("doc_id", "ascending"), ("th", "ascending"), ("a", "ascending")])
            held.clear()
            seg = t.column("seg").to_pylist()
            lens = np.fromiter(map(len, seg), np.int64, len(seg))
            ends = np.cumsum(lens)
            data = np.frombuffer(b"".join(seg), np.uint8)
            nw, a = t.column("nw").to_numpy().astype(np.int64), t.column("a").to_numpy()
            valid = np.zeros(len(data), bool)  # windows that lie inside their segment
            for x, m in zip((ends - lens).tolist(), nw.tolist(), strict=True):
                valid[x : x + m] = True
            suffixes = Suffixes(data, min_bytes)
            hit = longest_matches(data, min_bytes, False, valid, suffixes)[0] >= min_bytes
            if not keep_first:
                hit |= longest_matches(data, min_bytes, True, valid, suffixes)[0] >= min_bytes
            first = hit & ~np.concatenate([[False], hit[:-1]])
            owner = np.repeat(np.arange(len(seg)), lens)
            first[1:] |= hit[1:] & (owner[1:] != owner[:-1])
            last = hit & np.concatenate([~hit[1:] | first[1:], [True]])
            x, y = np.flatnonzero(first), np.flatnonzero(last)
            who = owner[x]
            shift = a[who] - (ends - lens)[who]
            take = pa.array(who)
            return pa.RecordBatch.from_arrays([t.column("doc_id").take(take).combine_chunks(), t.column("th").take(take).combine_chunks(), pa.array(x + shift), pa.array(y + shift + min_bytes)], ["doc_id", "th", "s", "e"])

        size, open_key = 0, None
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            lens = pc.binary_length(b.column(5)).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if size >= BUFFER and keys[i] != open_key:
                    yield flush()
                    size = 0
                held.append(b.slice(i, j - i))
                size, open_key = size + int(lens[i:j].sum()), keys[i]
        if held:
            yield flush()

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, th long, s long, e long")


def _by_windows(segments: DataFrame, min_bytes: int, keep_first: bool) -> DataFrame:
    """The same for anchors too large for a buffer: equal windows meet by their digest, counted before they are shuffled."""
    kind = segments.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = np.frombuffer(b.column(3)[k].as_buffer(), np.uint8)
                n = len(data) - min_bytes + 1
                at = np.arange(n)
                w1, w2 = digest_halves(data, at, at + min_bytes)
                again = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(again), b.column(1).take(again), pa.array(at + b.column(2)[k].as_py()), pa.array(w1), pa.array(w2)], ["doc_id", "th", "s", "w1", "w2"])

    windows = segments.select("doc_id", "th", "a", "seg").mapInArrow(tidy(run), f"doc_id {kind}, th long, s long, w1 long, w2 long")
    counts = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "s")).alias("first")).where("n > 1")
    counts = counts.withColumnsRenamed({"w1": "x1", "w2": "x2"})
    found = windows.join(counts, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")))
    if keep_first:
        found = found.where(~F.struct("doc_id", "th", "s").eqNullSafe(F.col("first")))
    return found.select("doc_id", "th", "s", (F.col("s") + min_bytes).alias("e"))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = False, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), spans: ranges [s, e) of bytes that lie in a string of min_bytes which also starts elsewhere (keep_first: earlier, by id and place), for documents that have some. Ranges of a document may overlap."""
    if gram & (gram - 1) or not 16 <= gram <= min_bytes:
        raise ValueError("gram must be a power of 2 of at least 16 and at most min_bytes")
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    found = cut(runs(keyed, min_bytes, gram))
    one = F.struct("doc_id", "th", "a", "nw", "off")
    parts = ("doc_id", "th", "a", "nw", "off")
    if keep_first:
        classes = found.groupBy("ah", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one"))
    else:  # any one of a class will do; all parts come from the same row, and fixed-width buffers are hashed
        classes = found.groupBy("ah", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in parts]).select("ah", "r1", "r2", "n", F.struct(*parts).alias("one"))
    classes = cut(classes, few=True)
    copied = classes.where("n > 1").select(F.col("ah").alias("ah2"), F.col("r1").alias("x1"), F.col("r2").alias("x2"), "one")
    whole = found.join(copied, (F.col("ah") == F.col("ah2")) & (F.col("r1") == F.col("x1")) & (F.col("r2") == F.col("x2")))
    if keep_first:
        whole = whole.where(~one.eqNullSafe(F.col("one")))
    spans = whole.select("doc_id", "th", F.col("a").alias("s"), (F.col("a") + F.col("nw") - 1 + min_bytes).alias("e"))
    several = classes.groupBy("ah").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("one.nw") + min_bytes).alias("bytes")).where("k > 1")
    several = several.select(F.col("ah").alias("ah2"), (F.col("bytes") > BUFFER).alias("big"))
    wanted = classes.join(several, F.col("ah") == F.col("ah2")).select("one.*", "ah", "big")
    segments = cut(_segments(keyed, wanted, min_bytes))
    spans = spans.unionByName(_by_suffixes(segments.where(~F.col("big")), min_bytes, keep_first))
    spans = spans.unionByName(_by_windows(segments.where("big"), min_bytes, keep_first))
    lists = cut(spans.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), few=True)  # of one document
    forget(found, classes, segments)
    return lists


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = False, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    return _result(docs, min_bytes, keep_first, gram, id_col, text_col, False)


def digests(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = False, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """without_repeats() with kept only as kept_sha256. With passage_words also n_passage_words: the document's words that lie in strings of so many words which another document has too (see passages), whatever their bytes."""
    return _result(docs, min_bytes, keep_first, gram, id_col, text_col, True, passage_words)


def _result(docs: DataFrame, min_bytes: int, keep_first: bool, gram: int, id_col: str, text_col: str, digest: bool, passage_words: int | None = None) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    both = keyed
    found = [("spans", repeated_spans(docs, min_bytes, keep_first, gram, id_col, text_col))]
    if passage_words:
        found.append(("shared", shared_words(keyed, passage_words)))
    for name, lists in found:
        lists = lists.withColumnsRenamed({"doc_id": f"d_{name}", "th": f"t_{name}", "spans": name})
        both = both.join(lists, F.col("doc_id").eqNullSafe(F.col(f"d_{name}")) & (F.col("th") == F.col(f"t_{name}")), "left")
    both = both.select("doc_id", "text", *[name for name, _ in found])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"] + ["n_passage_words"] * bool(passage_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for k, raw in enumerate(pc.cast(b.column(1), pa.binary()).to_pylist()):
                kept, removed, n, shared = raw, 0, 0, 0
                if b.column(2)[k].is_valid:
                    s, e = _merged(b.column(2), k)
                    keep = np.ones(len(raw) + 1, np.int8)
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        keep[x:y] = 0
                    kept = np.frombuffer(raw, np.uint8)[keep[:-1] == 1].tobytes()
                    removed, n = len(raw) - len(kept), len(s)
                if passage_words and b.column(3)[k].is_valid:
                    s, e = _merged(b.column(3), k)
                    shared = int((e - s).sum())
                for x, v in zip(out, (len(raw), removed, n, hashlib.sha256(kept).hexdigest() if digest else kept, shared), strict=True):
                    x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns][: len(names)], names)

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {names[4]} {'string' if digest else 'binary'}" + ", n_passage_words long" * bool(passage_words))
