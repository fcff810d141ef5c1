"""Lossless WebP (VP8L): a decoder for the whole format, an encoder of grey images, and media columns made of both.

The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. Images with one group of prefix codes and no colour cache are decoded on arrays: for
every bit position the pixel that would start there is looked up, positions that are reached are found by pointer
doubling, and only these count. Other images (several groups, colour cache) are read pixel by pixel.

Media columns: a payload of bytes is stored as grey images of 64 samples a row and at most 1 MiB each, one after the
other in one column, with the grey levels in prefix codes made for each image and its zero tail as a back-reference. Where that is
smaller by estimate, the left predictor or a packed palette comes before the prefix codes; the colour cache never saves a bit of a grey
image, whose pixels cost one symbol each as it is, so only the decoder has it.

Defined results: a null or empty text is a payload of 64 zero bytes; damaged files raise ValueError; rows that repeat are stored
each; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import named, slices, small_batches, tidy

ROW, TILE = 64, 1 << 20
LENGTHS, DISTANCES = 24, 40
#: Fixed values of the format: the order of code length codes, and the places (x, y) that the first distance codes mean.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD


class Bits:
    """Reads bits, the least significant of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image data ends early")
        first = self.at >> 3
        got = int.from_bytes(self.data[first : first + (n + 14 >> 3) + 1], "little") >> (self.at & 7)
        self.at += n
        return got & ((1 << n) - 1)


#: All numbers of 15 bits with their bits reversed, the longest a code has.
REVERSED = sum(((np.arange(1 << 15) >> k & 1) << (14 - k) for k in range(15))).tolist()


def _reverse(code: int, n: int) -> int:
    return REVERSED[code] >> (15 - n)


def canonical(lengths: list[int] | np.ndarray) -> dict[int, tuple[int, int]]:
    """Symbol to (code as it stands in the stream, length) by the canonical rule; one symbol alone takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    used.sort()
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        out[s] = (_reverse(code, n), n)
        code, last = code + 1, n
    if used and code != 1 << last:
        raise ValueError("a prefix code is not complete")
    return out


class Code:
    """A prefix code as a table over the next `width` bits: symbol and length."""

    def __init__(self, lengths: list[int] | np.ndarray | None, only: int = 0):
        """From the lengths of all symbols, or of one symbol only, which takes no bits."""
        codes = {only: (0, 0)} if lengths is None else canonical(lengths)
        if not codes:
            raise ValueError("a prefix code is empty")
        self.width = max(n for _, n in codes.values())
        self.symbol = np.zeros(1 << self.width, np.int32)
        self.length = np.zeros(1 << self.width, np.int32)
        for s, (code, n) in codes.items():
            self.symbol[code :: 1 << n] = s
            self.length[code :: 1 << n] = n

    def read(self, bits: Bits) -> int:
        first = bits.at >> 3
        window = int.from_bytes(bits.data[first : first + 4], "little") >> (bits.at & 7) & ((1 << self.width) - 1)
        bits.at += int(self.length[window])
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
        return int(self.symbol[window])


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        second = bits.read(8) if two else first
        if max(first, second) >= alphabet:
            raise ValueError("a symbol is out of range")
        if first == second:
            return Code(None, first)
        lengths = [0] * alphabet
        lengths[first] = lengths[second] = 1
        return Code(lengths)
    lengths = [0] * alphabet
    sizes = [0] * len(CODE_ORDER)
    for i in range(4 + bits.read(4)):
        sizes[CODE_ORDER[i]] = bits.read(3)
    code = Code(sizes)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[i] = s
            last = s or last
            i += 1
            continue
        value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if i + n > alphabet:
            raise ValueError("code lengths run over")
        lengths[i : i + n] = [value] * n
        i += n
    return Code(lengths)


def _prefixed(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values, row by row, as uint32."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("bad colour cache size")
    groups, block, which = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = width + (1 << block) - 1 >> block
        which = (_entropy_image(bits, across, height + (1 << block) - 1 >> block, False) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(which.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (256 + LENGTHS + cache, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    if groups == 1 and not cache:
        return _on_arrays(bits, codes[0], width, width * height)
    return _one_by_one(bits, codes, which, block, cache_bits, width, width * height)


def _one_by_one(bits: Bits, codes: list[list[Code]], which: np.ndarray | None, block: int, cache_bits: int, width: int, n: int) -> np.ndarray:
    out: list[int] = []
    cache, shift, across = [0] * (1 << cache_bits), 32 - cache_bits, width + (1 << block) - 1 >> block
    kept = 0  # pixels that the cache knows

    def remember() -> None:
        nonlocal kept
        while kept < len(out):
            cache[(HASH * out[kept] & 0xFFFFFFFF) >> shift] = out[kept]
            kept += 1

    while len(out) < n:
        at = len(out)
        green, red, blue, alpha, far = codes[int(which[(at // width >> block) * across + (at % width >> block)]) if which is not None else 0]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 256 + LENGTHS:
            size = _prefixed(s - 256, bits)
            back = _distance(_prefixed(far.read(bits), bits), width)
            if back > at or at + size > n:
                raise ValueError("a back-reference points outside the image")
            for _ in range(size):
                out.append(out[-back])
        else:
            if cache_bits:
                remember()
            out.append(cache[s - 256 - LENGTHS])
    return np.array(out, np.uint32)


def _on_arrays(bits: Bits, codes: list[Code], width: int, n: int) -> np.ndarray:
    green, red, blue, alpha, far = codes
    data = np.frombuffer(bits.data, np.uint8)
    first = bits.at >> 3
    limit = bits.end
    # 32 bits from each byte on; an image's pixels end at some position at or before the data's end
    padded = np.concatenate([data[first:], np.zeros(8, np.uint8)])
    words = np.zeros(len(padded) - 7, np.uint64)
    by_byte = words.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        by_byte[:, k] = padded[k : len(padded) - 7 + k]
    base = 8 * first

    def window(at: np.ndarray, count: int) -> np.ndarray:
        at = np.minimum(at, limit) - base
        return (words[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & ((1 << count) - 1)

    start = bits.at
    if not any(c.width for c in (green, red, blue, alpha)):  # every pixel is the same
        s = int(green.symbol[0])
        if s < 256:
            value = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | s << 8 | int(blue.symbol[0])
            return np.full(n, value, np.uint32)
        return _one_by_one(bits, [codes], None, 0, 0, width, n)
    if not green.width and green.symbol[0] >= 256:  # a pixel may take no bits
        return _one_by_one(bits, [codes], None, 0, 0, width, n)
    at = np.arange(start, limit + 1, dtype=np.int32)
    w = (words.astype(np.uint32)[:, None] >> np.arange(8, dtype=np.uint32)[None, :]).ravel()[start - base : limit + 1 - base] & np.uint32((1 << green.width) - 1)
    sym, after = green.symbol[w], at + green.length[w]
    literal = sym < 256
    for c in (red, blue, alpha):
        if c.width:
            after = after + np.where(literal, c.length[window(after, c.width)], 0)
    pixels = np.ones(len(at), np.int64)
    refs = np.flatnonzero(~literal)
    if len(refs):
        p = at[refs] + green.length[w[refs]]
        size, p = _prefixed_on_arrays(sym[refs] - 256, p, window)
        wd = window(p, far.width)
        code, p = _prefixed_on_arrays(far.symbol[wd], p + far.length[wd], window)
        pixels[refs], after[refs] = size, p
    follow = np.minimum(after - start, len(at) - 1).astype(np.int32)
    follow[-1] = len(at) - 1
    # positions reached from the start: every 16th by doubled pointers, then those between
    far16 = follow
    for _ in range(4):
        far16 = far16[far16]
    step, stop, chain, p = memoryview(far16), len(at) - 1, [0], 0
    while p != stop:
        p = step[p]
        chain.append(p)
    ahead = np.array(chain, np.int64)
    every = [ahead]
    for _ in range(15):
        ahead = follow[ahead]
        every.append(ahead)
    reached = np.stack(every, axis=1).ravel()
    reached = reached[: int(np.argmax(reached == stop))] if (reached == stop).any() else reached
    ends = np.cumsum(pixels[reached])
    count = int(np.searchsorted(ends, n)) + 1
    if count > len(reached):
        raise ValueError("the image data ends early")
    reached, ends = reached[:count], ends[:count]
    if ends[-1] != n or after[reached[-1]] > limit:
        raise ValueError("the image data ends early" if ends[-1] == n else "a back-reference points outside the image")
    bits.at = int(after[reached[-1]])
    out = np.zeros(n, np.uint32)
    lit = literal[reached]
    here = reached[lit]
    p = at[here] + green.length[w[here]]
    value = sym[here].astype(np.int64) << 8
    for c, shift in ((red, 16), (blue, 0), (alpha, 24)):
        wc = window(p, c.width) if c.width else np.zeros(len(p), np.int64)
        value |= c.symbol[wc].astype(np.int64) << shift
        p = p + c.length[wc]
    out[ends[lit] - 1] = value.astype(np.uint32)
    if not lit.all():
        begins = ends[~lit] - pixels[reached[~lit]]
        dist = dict(zip(refs.tolist(), code.tolist(), strict=True))
        for to, size, ref in zip(begins.tolist(), pixels[reached[~lit]].tolist(), reached[~lit].tolist(), strict=True):
            back = _distance(dist[ref], width)
            if back > to:
                raise ValueError("a back-reference points outside the image")
            if back >= size:
                out[to : to + size] = out[to - back : to - back + size]
            else:
                out[to : to + size] = np.resize(out[to - back : to], size)
    return out


def _prefixed_on_arrays(symbol: np.ndarray, at: np.ndarray, window) -> tuple[np.ndarray, np.ndarray]:
    extra = np.where(symbol < 4, 0, symbol - 2 >> 1).astype(np.int64)
    more = window(at, 24) & ((1 << extra) - 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + more + 1), at + extra


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _unpredict(argb: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Each pixel is the sum of what is stored and what its block's mode predicts from pixels left and above."""
    height, width = argb.shape
    d = _channels(argb)
    mode_of = modes >> 8 & 0xF
    if (mode_of == 1).all():  # the left pixel, and in the first column the one above
        d[0, 0, 0] += 255
        d[:, 0] = np.cumsum(d[:, 0], axis=0)
        return _join(np.cumsum(d, axis=1))
    out = np.zeros_like(d)
    out[0, :, :] = np.cumsum(d[0], axis=0)
    out[0, :, 0] += 255
    out[0] &= 255
    for y in range(1, height):
        up, row = out[y - 1], out[y]
        row[0] = d[y, 0] + up[0] & 255
        right = np.concatenate([up[1:], row[:1]])  # of the last pixel: the first of its own row
        for x0 in range(0, width, 1 << block):
            a, b = max(1, x0), min(width, x0 + (1 << block))
            if a >= b:
                continue
            mode = int(mode_of[y >> block, x0 >> block])
            t, tl, tr, r = up[a:b], up[a - 1 : b - 1], right[a:b], d[y, a:b]
            if mode in (0, 14, 15):
                row[a:b] = r + np.array([255, 0, 0, 0]) & 255
            elif mode == 1:
                row[a:b] = np.cumsum(r, axis=0) + row[a - 1] & 255
            elif mode in (2, 3, 4, 8, 9):
                guess = t if mode == 2 else tr if mode == 3 else tl if mode == 4 else tl + t >> 1 if mode == 8 else t + tr >> 1
                row[a:b] = r + guess & 255
            else:
                for x in range(a, b):
                    i = x - a
                    row[x] = r[i] + _guess(mode, row[x - 1], t[i], tl[i], tr[i]) & 255
    return _join(out)


def _guess(mode: int, left: np.ndarray, t: np.ndarray, tl: np.ndarray, tr: np.ndarray) -> np.ndarray:
    if mode == 5:
        return (left + tr >> 1) + t >> 1
    if mode == 6:
        return left + tl >> 1
    if mode == 7:
        return left + t >> 1
    if mode == 10:
        return (left + tl >> 1) + (t + tr >> 1) >> 1
    if mode == 11:  # left if the gradient's guess is nearer to it than to the top
        return left if np.abs(t - tl).sum() < np.abs(left - tl).sum() else t
    if mode == 12:
        return np.clip(left + t - tl, 0, 255)
    half = left + t >> 1
    return np.clip(half + np.sign(half - tl) * (np.abs(half - tl) >> 1), 0, 255)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 0xFF ^ 0x80) - 0x80


def _uncross(argb: np.ndarray, image: np.ndarray, block: int) -> np.ndarray:
    height, width = argb.shape
    c = _channels(argb)
    m = _channels(image)[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    red_to_blue, green_to_blue, green_to_red = (_signed(m[..., k]) for k in (1, 2, 3))
    green = _signed(c[..., 2])
    c[..., 1] = c[..., 1] + (green_to_red * green >> 5) & 255
    c[..., 3] = c[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * _signed(c[..., 1]) >> 5) & 255
    return _join(c)


def _unpalette(argb: np.ndarray, palette: np.ndarray, packed: int, width: int) -> np.ndarray:
    index = argb >> 8 & 0xFF
    if packed:
        bits = 8 >> packed
        x = np.arange(width)
        index = index[:, x >> packed] >> ((x & ((1 << packed) - 1)) * bits).astype(np.uint32)[None, :] & ((1 << bits) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file: uint8, (height, width, 4) as red, green, blue, alpha (255 if the file says that none is used)."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a simple lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if len(data) < 20 + size:
        raise ValueError("the file ends early")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height, alpha = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            w, h = inner + (1 << block) - 1 >> block, height + (1 << block) - 1 >> block
            undo.append((kind, _entropy_image(bits, w, h, False).reshape(h, w), block))
        elif kind == 2:
            undo.append((kind, None, 0))
        else:
            n = bits.read(8) + 1
            palette = _join(np.cumsum(_channels(_entropy_image(bits, n, 1, False)), axis=0))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, palette, (packed, inner)))
            inner = inner + (1 << packed) - 1 >> packed
    argb = _entropy_image(bits, inner, height, True).reshape(height, inner)
    for kind, image, how in reversed(undo):
        if kind == 0:
            argb = _unpredict(argb, image, how)
        elif kind == 1:
            argb = _uncross(argb, image, how)
        elif kind == 2:
            g = argb >> 8 & 0xFF
            argb = argb & 0xFF00FF00 | (argb & 0x00FF00FF) + (g << 16 | g) & 0x00FF00FF
        else:
            argb = _unpalette(argb, image, *how)
    out = np.empty((*argb.shape, 4), np.uint8)
    for k, s in enumerate((16, 8, 0, 24)):
        out[..., k] = argb >> s & 0xFF
    if not alpha:
        out[..., 3] = 255
    return out


class Writer:
    """Collects bits, the least significant first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_symbols(self, first: int, second: int | None = None) -> None:
        """A prefix code of one symbol below 256, which takes no bits, or of two, which take one."""
        self.put(1, 1)
        self.put(second is not None, 1)
        self.put(first > 1, 1)
        self.put(first, 8 if first > 1 else 1)
        if second is not None:
            self.put(second, 8)

    def put_code(self, lengths: list[int]) -> None:
        """A prefix code: as one symbol below 256, or as its lengths, with runs of zeros in short."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) <= 2 and used[-1] < 256:
            self.put_symbols(*used)
            return
        tokens: list[tuple[int, int, int]] = []
        at = 0
        for k in [*used, len(lengths)]:
            zeros, at = k - at, k + 1
            while zeros >= 11:
                tokens.append((18, min(zeros, 138) - 11, 7))
                zeros -= min(zeros, 138)
            if zeros >= 3:
                tokens.append((17, zeros - 3, 3))
            else:
                tokens += [(0, 0, 0)] * zeros
            if k < len(lengths):
                tokens.append((lengths[k], 0, 0))
        counts = [0] * len(CODE_ORDER)
        for s, _, _ in tokens:
            counts[s] += 1
        if sum(c > 0 for c in counts) == 1:
            counts[0 if not counts[0] else 1] = 1  # so that each token takes bits
        sizes = code_lengths(counts, 7)
        n = max(4, max(i for i, s in enumerate(CODE_ORDER) if sizes[s]) + 1)
        self.put(0, 1)
        self.put(n - 4, 4)
        for s in CODE_ORDER[:n]:
            self.put(sizes[s], 3)
        self.put(0, 1)
        codes = canonical(sizes)
        for s, more, width in tokens:
            self.put(*codes[s])
            self.put(more, width)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts: list[int] | np.ndarray, most: int = 15) -> list[int]:
    """Huffman code lengths of at most `most` bits for the counts that are not 0; a symbol alone gets 1."""
    counts = [int(c) for c in counts]
    used = [s for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
        return out
    shift = 0
    while True:
        heap = [((counts[s] >> shift) + 1 if shift else counts[s], i) for i, s in enumerate(used)]
        heapq.heapify(heap)
        parent, new = [0] * (2 * len(used)), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = [0] * new
        for i in range(new - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= most:
            for i, s in enumerate(used):
                out[s] = depth[i]
            return out
        shift += 2


#: Bits that a transform must save by estimate to be used.
WORTH = 256


def _bits(levels: np.ndarray) -> float:
    """About the bits of levels in a prefix code: their entropy, but a bit each at least if they are not all the same."""
    counts = np.bincount(levels)
    counts = counts[counts > 0]
    return max(len(levels), float(counts @ (np.log2(len(levels)) - np.log2(counts)))) if len(counts) > 1 else 0.0


def _left_residues(samples: np.ndarray) -> np.ndarray:
    """What the predictor of the left pixel leaves: in the first column that of the pixel above."""
    out = samples.copy()
    out[:, 1:] -= samples[:, :-1]
    out[1:, 0] -= samples[:-1, 0]
    return out


def _packed(samples: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in a palette of at most 16 levels, several to a pixel."""
    per = 8 if len(known) <= 2 else 4 if len(known) <= 4 else 2
    place = np.searchsorted(known, samples).astype(np.uint8)
    place = np.pad(place, ((0, 0), (0, -samples.shape[1] % per))).reshape(len(samples), -1, per)
    return (place << (np.arange(per, dtype=np.uint8) * np.uint8(8 // per))).sum(axis=2, dtype=np.uint8)


def encode_grey(samples: np.ndarray, transform: str | None = None) -> bytes:
    """A lossless WebP file of grey samples (uint8, rows by columns): subtract-green, and after it the transform that makes the levels smallest by estimate ("plain" for none, "left" for the predictor of the left pixel, "palette" for at most 16 levels, several to a pixel), or the one named; prefix-coded levels, and a zero tail of 4 levels or more as one zero and a back-reference to it."""
    height, width = samples.shape
    known = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    ways = {"plain": samples}
    if transform in (None, "left"):
        ways["left"] = _left_residues(samples)
    if transform == "palette" or transform is None and len(known) <= 16:
        ways["palette"] = _packed(samples, known)
    if transform is None:
        cost = {k: _bits(x.ravel()) + (WORTH if k != "plain" else 0) for k, x in ways.items()}
        transform = min(cost, key=cost.get)
    flat = ways[transform].ravel()
    ends = np.flatnonzero(flat)
    body = int(ends[-1]) + 1 if len(ends) else 0
    tail = len(flat) - body
    run = tail - 1 if 4 <= tail <= 4096 else 0
    literals = flat[: len(flat) - run]
    counts = np.bincount(literals, minlength=256 + LENGTHS).tolist()
    run_symbol = extra = more = 0
    if run:
        run_symbol, extra, more = _as_prefix(run)
        counts[256 + run_symbol] += 1
    lengths = code_lengths(counts)
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    w.put(0b101, 3)  # a transform, subtract-green
    if transform == "left":
        w.put(0b001, 3)  # a transform, predictor
        w.put(7, 3)  # blocks of 512
        w.put(0, 1)  # no colour cache
        for symbol in (1, 0, 0, 255, 0):  # mode 1, of every block
            w.put_symbols(symbol)
    elif transform == "palette":
        w.put(0b111, 3)  # a transform, palette
        w.put(len(known) - 1, 8)
        w.put(0, 1)  # no colour cache
        steps = np.diff(known, prepend=0).tolist()
        green = [0] * (256 + LENGTHS)
        for x in steps:
            green[x] += 1
        green = code_lengths(green)
        w.put_code(green)
        w.put_symbols(0)
        w.put_symbols(0)
        w.put_symbols(*(0, 255) if len(known) > 1 else (255,))
        w.put_symbols(0)
        codes = canonical(green)
        for k, x in enumerate(steps):  # each level as a step from the one before, the first one's alpha 255
            w.put(*codes[x])
            if len(known) > 1:
                w.put(k == 0, 1)
    w.put(0, 3)  # no more transforms, no colour cache, one group
    w.put_code(lengths)
    # red, blue, alpha; distance code 2 is the pixel to the left
    for symbol in (0, 0, 0 if transform == "left" else 255, 1):
        w.put_symbols(symbol)
    codes = canonical(lengths)
    code, bits = np.zeros(256 + LENGTHS, np.uint64), np.zeros(256 + LENGTHS, np.int64)
    for s, (c, n) in codes.items():
        code[s], bits[s] = c, n
    head = w.n
    n_bits = bits[literals]
    at = head + np.cumsum(n_bits) - n_bits
    total = int(at[-1] + n_bits[-1]) if len(at) else head
    words = np.zeros(total // 64 + 3, np.uint64)
    spot, shift = at >> 6, (at & 63).astype(np.uint64)
    value = code[literals]
    low, high = value << shift, np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    if len(spot):
        first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
        words[spot[first]] |= np.bitwise_or.reduceat(low, first)
        words[spot[first] + 1] |= np.bitwise_or.reduceat(high, first)
    raw = np.frombuffer(words.tobytes(), np.uint8)[: (total + 7) // 8].copy()
    begin = np.frombuffer(w.bytes(), np.uint8)
    raw[: len(begin)] |= begin
    if run:
        end = Writer()
        end.put(*codes[256 + run_symbol])
        end.put(more, extra)
        tail_value = end.value << (total & 7)
        tail_bytes = np.frombuffer(tail_value.to_bytes(((total & 7) + end.n + 7) // 8 or 1, "little"), np.uint8)
        whole = np.zeros((total + end.n + 7) // 8 + 1, np.uint8)
        whole[: len(raw)] = raw
        whole[total >> 3 : (total >> 3) + len(tail_bytes)] |= tail_bytes
        raw = whole[: (total + end.n + 7) // 8]
    data = raw.tobytes()
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def _as_prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits, extra bits of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), extra, v & ((1 << extra) - 1)


def store(payload: bytes) -> list[bytes]:
    """A payload, of a multiple of 64 bytes, as WebP files of at most 1 MiB of samples."""
    samples = np.frombuffer(payload, np.uint8)
    return [encode_grey(samples[i : i + TILE].reshape(-1, ROW)) for i in range(0, len(samples), TILE)]


def load(files: list[bytes]) -> bytes:
    """The samples (the green channel) of the files, one after the other."""
    return b"".join(decode(f)[..., 1].tobytes() for f in files)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (array of WebP files) of each row's text in UTF-8, padded with zero bytes to a positive multiple of 64."""
    return _run(docs, id_col, text_col, False)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media(), read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 (of all files, one after the other) and feature, the mean and variance of the samples and how many differ from the one before, as text."""
    return _run(docs, id_col, text_col, True)


def _feature(samples: np.ndarray) -> str:
    n, total = len(samples), int(samples.sum(dtype=np.int64))
    squares = int(np.bincount(samples, minlength=256) @ (np.arange(256, dtype=np.int64) ** 2))
    changes = int(np.count_nonzero(samples[1:] != samples[:-1]))
    return f"{total / n:.6f},{(squares * n - total * total) / (n * n):.6f},{changes}"


def _run(docs: DataFrame, id_col: str, text_col: str, read_back: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] if read_back else ["n_bytes", "media"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] if read_back else [pa.int64(), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            for i, j in slices(text):
                found = []
                for raw in pc.cast(text.slice(i, j - i), pa.binary()).to_pylist():
                    files = store(raw + bytes(-len(raw) % ROW if raw else ROW))
                    if not read_back:
                        found.append((len(raw), files))
                        continue
                    payload = load(files)
                    whole = b"".join(files)
                    found.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(whole), hashlib.sha256(whole).hexdigest(), _feature(np.frombuffer(payload, np.uint8))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    more = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" if read_back else "n_bytes long, media array<binary>"
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, {more}")
