"""Every operator against brute force, on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import exact_dedup, html_dom, mixing, passages, pieces, quality, quotes, simhash, suffix_dedup, token_counts, webp, wrappers
from webloom.llm.queries import tokenizer_file

WORDS, PIECES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")
LONG = " ".join(f"w{i * i % 997}" for i in range(30_000))
TEXTS = [None, "", " ", "a b  c", "a\tb\nc", "A B C", "Ünïcode ΣΑΣ 😀 x\x00y", "it's <|endoftext|> don't", "the cat sat on the mat " * 9, "the cat sat on the mat " * 9 + "!", LONG, "▁ a▁b  ", "a" * 900, "a b c"]
SCHEMA = "doc_id long, text string, source string, digest string, norm string, salt int, fp long, anchor long, score double"


def table(spark, rows=None):
    rows = [(i, t, ("s1", "s2", None)[i % 3]) for i, t in enumerate(TEXTS)] + [(3, "a b  c", "s1"), (None, "no id", "s2")] if rows is None else rows
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 0.5) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


# --- op1 ---


def test_media_round_trip(spark):
    got = by_id(webp.features(table(spark)))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert got[i][:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    files = by_id(webp.media(table(spark)))[10][1]
    assert webp.load([bytes(f) for f in files]).rstrip(b"\0") == LONG.encode()
    assert webp.features(empty(spark)).count() == 0


def container(w):
    data = w.bytes()
    data += b"\0" * (len(data) & 1)
    import struct

    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def start(width, height):
    w = webp.Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def put_image(w, argb, main, cache_bits=0):
    """Literals under flat 8-bit codes (9 bits for green), and colour cache symbols where a pixel is cached."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    n = 280 + (1 << cache_bits if cache_bits else 0)
    counts = [1] * n
    green = webp.code_lengths(counts)
    flat = [8] * 256
    w.put_code(green)
    for _ in range(3):
        w.put_code(flat)
    w.put_code([1] + [0] * 39)
    g, f = webp.canonical(green), webp.canonical(flat)
    cache = {}
    for p in argb.ravel().tolist():
        slot = (webp.HASH * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if cache_bits and cache.get(slot) == p:
            w.put(*g[280 + slot])
        else:
            w.put(*g[p >> 8 & 255])
            for s in (16, 0, 24):
                w.put(*f[p >> s & 255])
        if cache_bits:
            cache[slot] = p


def as_argb(rgba):
    r, g, b, a = (rgba[..., k].astype(np.uint32) for k in range(4))
    return a << 24 | r << 16 | g << 8 | b


def test_webp_colour_cache_and_both_decoders():
    rgba = np.random.default_rng(1).integers(0, 4, (9, 13, 4), dtype=np.uint8) * 50
    for cache in (0, 5):
        w = start(13, 9)
        w.put(0, 1)
        put_image(w, as_argb(rgba), True, cache)
        assert (webp.decode(container(w)) == rgba).all()


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    rgba = np.random.default_rng(mode).integers(0, 256, (6, 7, 4), dtype=np.uint8)
    px = np.concatenate([rgba[..., 3:], rgba[..., :3]], axis=-1).astype(int)  # ARGB
    left = np.zeros_like(px)

    def guess(y, x):
        if y == 0:
            return np.array([255, 0, 0, 0]) if x == 0 else px[0, x - 1]
        if x == 0:
            return px[y - 1, 0]
        lft, t, tl, tr = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1], px[y - 1, x + 1] if x + 1 < 7 else px[y, 0]
        avg = lambda a, b: (a + b) // 2
        if mode == 11:
            p = lft + t - tl
            return lft if np.abs(p - lft).sum() < np.abs(p - t).sum() else t
        if mode == 13:
            a = avg(lft, t)
            return np.clip(a + np.array([int(d / 2) for d in a - tl]), 0, 255)
        return {0: np.array([255, 0, 0, 0]), 1: lft, 2: t, 3: tr, 4: tl, 5: avg(avg(lft, tr), t), 6: avg(lft, tl), 7: avg(lft, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(lft, tl), avg(t, tr)), 12: np.clip(lft + t - tl, 0, 255)}[mode]

    for y in range(6):
        for x in range(7):
            left[y, x] = (px[y, x] - guess(y, x)) % 256
    w = start(7, 6)
    w.put(0b001, 3)  # a transform, predictor
    w.put(0, 3)  # blocks of 4
    put_image(w, np.full((2, 2), 0xFF000000 | mode << 8, np.uint32), False)
    w.put(0, 1)
    put_image(w, webp._join(left), True)
    assert (webp.decode(container(w)) == rgba).all()


def test_webp_cross_colour_and_palette():
    rgba = np.random.default_rng(5).integers(0, 256, (5, 6, 4), dtype=np.uint8)
    r, g, b = (rgba[..., k].astype(int) for k in range(3))
    s = lambda v: ((v & 255) ^ 128) - 128
    g2r, g2b, r2b = 40, -17, 90
    out = rgba.copy()
    out[..., 0] = (r - (g2r * s(g) >> 5)) % 256
    out[..., 2] = (b - (g2b * s(g) >> 5) - (r2b * s(r) >> 5)) % 256
    w = start(6, 5)
    w.put(0b011, 3)
    w.put(0, 3)
    put_image(w, np.full((2, 2), 0xFF000000 | (r2b & 255) << 16 | (g2b & 255) << 8 | g2r, np.uint32), False)
    w.put(0, 1)
    put_image(w, as_argb(out), True)
    assert (webp.decode(container(w)) == rgba).all()
    for colours, packed in ((2, 3), (4, 2), (16, 1), (20, 0)):
        palette = np.random.default_rng(colours).integers(0, 256, (colours, 4), dtype=np.uint8)
        index = np.random.default_rng(9).integers(0, colours, (5, 11))
        table_ = as_argb(palette)
        delta = webp._join(np.diff(webp._channels(table_), axis=0, prepend=0))
        per, bits = 1 << packed, 8 >> packed
        wide = np.zeros((5, -(-11 // per)), np.uint32)
        for x in range(11):
            wide[:, x // per] |= index[:, x].astype(np.uint32) << (x % per * bits)
        w = start(11, 5)
        w.put(0b111, 3)
        w.put(colours - 1, 8)
        put_image(w, delta, False)
        w.put(0, 1)
        put_image(w, wide << 8 | np.uint32(0xFF000000), True)
        assert (webp.decode(container(w)) == palette[index]).all()


def by_hand(bits):
    """A file of bits as the format's text lists them, first bit first; numbers are written least significant bit first."""
    import struct

    bits = bits.replace(" ", "").replace("\n", "")
    data = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    data += b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def test_webp_of_another_encoder():
    """The one pixel, transparent, that browsers are probed with for lossless WebP: a palette of one colour."""
    import base64

    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[[0, 0, 0, 0]]]


def test_webp_colour_cache_by_hand():
    """Three pixels of red 1: a literal, and twice the slot that its hash names, (0x1E35A7BD * 0xFF010000 mod 2**32) >> 31."""
    slot = (0x1E35A7BD * 0xFF010000 % 2**32) >> 31
    zeros = 280 + slot - 1 - 276  # between green 0 and the cache's symbol, beside twice 138
    signature, size, flags = "11110100", "01000000000000" + "00000000000000", "1" + "000"
    cache = "1" + "1000"  # a colour cache of 1 bit
    order = "0" + "0000" + "010" + "100" + "000" + "010"  # lengths of codes 17, 18, 0, 1 are 2, 1, 0, 2: so 18 is 0, 1 is 10, 17 is 11
    lengths = "0" + "10" + "0" + "1111111" + "0" + "1111111" + "11" + f"{zeros - 3:03b}"[::-1] + "10"
    assert slot == 1  # the last symbol of all, so that no length follows
    red, blue, alpha, far = "1001", "1000", "101" + "11111111", "1000"
    pixels = "0" + "1" + "1"
    got = webp.decode(by_hand(signature + size + flags + "0" + cache + "0" + order + lengths + red + blue + alpha + far + pixels))
    assert got.tolist() == [[[1, 0, 0, 255]] * 3]


def test_webp_predictor_and_back_reference_by_hand():
    """Two rows of three pixels under mode 2 (above): green 5 and its right neighbours 1 more each, then the same below, by a back-reference of three zeros' worth."""
    signature, size, flags = "11110100", "01000000000000" + "10000000000000", "1" + "000"
    predictor = "1" + "00" + "000" + "0" + "1" + "0" + "1" + "01000000" + "1000" + "1000" + "1000" + "1000"  # blocks of 4; every mode 2
    # green: literals 0, 1, 5 and length symbol 256 + 0 (one pixel), each of 2 bits, given by code lengths: 0 for 2 bits, others by runs
    order = "0" + "1000" + "010" + "010" + "010" + "000" + "010"  # codes 17, 18, 0, 1, 2 have lengths 2, 2, 2, 0, 2: 0 is 00, 2 is 01, 17 is 10, 18 is 11
    lengths = "0" + "01" + "01" + "10" + "000" + "01" + "11" + "1111111" + "11" + f"{112 - 11:07b}"[::-1] + "01" + "11" + f"{23 - 11:07b}"[::-1]
    red, blue, alpha, far = "1000", "1000", "1000", "1001"  # distance code 2: the pixel to the left
    zero, one, five, again = "00", "01", "10", "11"
    pixels = five + one + one + zero + again + again
    got = webp.decode(by_hand(signature + size + flags + predictor + "0" + "0" + "0" + order + lengths + red + blue + alpha + far + pixels))
    assert got.tolist() == [[[0, 5, 0, 255], [0, 6, 0, 255], [0, 7, 0, 255]]] * 2


@pytest.mark.parametrize("transform", [None, "plain", "left", "palette"])
def test_webp_encoder(transform):
    rng = np.random.default_rng(0)
    for levels in (1, 2, 3, 4, 5, 16, 17, 256)[: 6 if transform == "palette" else 8]:
        for rows in (1, 2, 7, 60, 600):
            x = (rng.integers(0, levels, (rows, 64)) * (255 // max(1, levels - 1))).astype(np.uint8)
            x.ravel()[int(rng.integers(x.size)) :] = 0
            got = webp.decode(webp.encode_grey(x, transform))
            assert (got[..., :3] == x[..., None]).all() and (got[..., 3] == 255).all()


def test_webp_encoder_uses_what_is_smaller():
    few = (np.random.default_rng(1).random((40, 64)) < 0.05).astype(np.uint8) * 7
    slope = (np.arange(2560) // 3 % 256).astype(np.uint8).reshape(40, 64)
    digits = np.frombuffer((LONG[:2560]).encode(), np.uint8).reshape(40, 64)
    prose = np.random.default_rng(2).choice(np.frombuffer(b"the quick brown fox jumps over a lazy dog. eeee aaa", np.uint8), (40, 64))
    for x, best in ((few, "palette"), (digits, "palette"), (slope, "left"), (prose, "plain")):
        sizes = {t: len(webp.encode_grey(x, t)) for t in ("plain", "left", "palette") if t != "palette" or len(set(x.ravel().tolist())) <= 16}
        assert min(sizes, key=sizes.get) == best and len(webp.encode_grey(x)) == sizes[best]


def test_webp_rejects_damage():
    good = webp.encode_grey(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for bad in (b"", good[:-20], good[:12] + b"VP8 " + good[16:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


# --- op2 ---


def slow_fingerprint(text, n=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64(" ".join(w[i : i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_codes_cover_and_visits_suffice():
    assert sum(b[0] for b in simhash.BLOCKS) == 64
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    home = simhash.homes_of(x)
    y = x.copy()
    for k in range(2):
        y ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    row, anchor = simhash.visits_of(y, 2)
    met = set(zip(row.tolist(), anchor.tolist(), strict=True))
    assert len(met) == len(row) and all((i, int(h)) in met for i, h in enumerate(home))


def test_near_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    fps = [int(b) ^ (1 << int(rng.integers(0, 62))) if k else int(b) for b in base for k in range(3)]
    links = simhash.links(spark.createDataFrame([(f,) for f in set(fps)], "fp long"))
    want = {(min(a, b), max(a, b)) for a in set(fps) for b in set(fps) if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    docs = table(spark)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_groups(docs).collect()}
    fp = {i: slow_fingerprint(t) for i, t in [*enumerate(TEXTS), (None, "no id")]}
    assert {i: f & ((1 << 64) - 1) for i, f in got} == fp
    for (i, f), c in got.items():
        near = {j for j, g in fp.items() if (g ^ fp[i]).bit_count() <= 2}
        assert c == (min(j for j in near if j is not None) if near != {None} else None)
    assert simhash.near_groups(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert by_id(simhash.components(edges)) == {**{i: (0,) for i in range(41)}, 100: (100,), 101: (100,)}


def test_similar_texts(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], 300)) for _ in range(12)]
    near = [" ".join([*b.split()[:150], "zz", *b.split()[151:]]) for b in base]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(base + near)] + [(99, None, "s"), (None, base[0], "s")])
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.one_of_each(docs).collect())
    assert kept == [*((False, i) for i in range(12)), (False, 99), (True, 0)]
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(empty(spark)).count() == 0


def test_similar_texts_at_hot_anchors(spark, monkeypatch):
    """Over half of all rows are near copies of one text: their anchors are dealt out, compared in blocks, and still one group."""
    rng = np.random.default_rng(4)
    base = rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], 400).tolist()
    near = [" ".join([*base[: 10 + i], f"z{i}", *base[11 + i :]]) for i in range(150)]
    other = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], 60)) for _ in range(100)]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(near + other)])
    whole = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    monkeypatch.setattr(simhash, "CELL_ROWS", 7)
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == whole == {0, *range(150, 250)}
    found = {(r.a, r.b) for r in simhash.similar(docs).collect()}
    assert len(found) < 150 * 149 / 4 and all(a < b < 150 for a, b in found)


def roots_of(spark, links):
    root = by_id(simhash.components(spark.createDataFrame(links, "a long, b long"))) if links else {}
    return lambda i: root.get(i, (i,))[0]


def linked(texts, similarity=0.8, words=5):
    """All pairs at least that similar, by comparing all."""
    sets = [set(simhash.shingle_hashes(t, words)) for t in texts]
    return [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]


def test_template_family_at_hot_anchors(spark, monkeypatch):
    """Texts of one template at 0.7 of each other hold pairs at 0.9, which fall into different cells and blocks."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 7)
    template = [f"t{i}" for i in range(700)]
    family = [[*template, *[f"u{i}x{k}" for k in range(150)]] for i in range(160)]
    texts = [" ".join(x) for x in family] + [" ".join(f"v{i}x{k}" if k % 90 == 8 else w for k, w in enumerate(x)) for i, x in enumerate(family[:60])]
    want = linked(texts)
    assert want == [(i, 160 + i) for i in range(60)]
    found = {(r.a, r.b) for r in simhash.similar(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert found == set(want)


def test_no_link_is_lost(spark):
    """Short texts, pairs near 0.8 whose nearest texts are below it, and shingles that many texts share: groups as by comparing all pairs."""
    rng = np.random.default_rng(6)
    texts: list[str] = []
    for i in range(60):  # 4 against 5 shingles
        words = [f"s{i}x{k}" for k in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    common = [f"c{k}" for k in range(60)]
    for i in range(60):
        own = [f"l{i}x{k}" for k in range(60)]
        for changes in (0, 1, 2, 3):
            t = list(own)
            for k in rng.choice(60, changes, replace=False):
                t[k] = f"m{i}x{changes}x{k}"
            texts.append(" ".join([*common, *t] if i % 2 else t))
    want = linked(texts)
    found = [(r.a, r.b) for r in simhash.similar(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()]
    assert set(found) <= set(want)
    mine, right = roots_of(spark, found), roots_of(spark, want)
    assert [mine(i) for i in range(len(texts))] == [right(i) for i in range(len(texts))]


def test_prefix_meets_every_similar_pair():
    rng = np.random.default_rng(7)
    common, counts = np.arange(0, 40, 3).astype(np.uint64), rng.integers(5, 90, 14)
    for _ in range(2000):
        x, y = (np.unique(rng.integers(0, 40, rng.integers(1, 60))).astype(np.uint64) for _ in "xy")
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            assert len(np.intersect1d(simhash.prefix(x, 0.8, common, counts), simhash.prefix(y, 0.8, common, counts)))


def test_blocks_of_a_cell():
    rng = np.random.default_rng(5)
    heads = rng.integers(0, 1 << 63, (6, 4)).astype(np.uint64)
    of = rng.integers(0, 6, 5000)
    f = heads[of] ^ (np.uint64(1) << rng.integers(0, 63, (5000, 4)).astype(np.uint64))
    none = np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
    found, lead, _ = simhash.cell_links(np.arange(5000), f, 20, *none)
    assert len(lead) == 6 and all(of[a] == of[b] for a, b in found) and len(found) < 10_000
    root = list(range(5000))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert len({top(x) for x in range(5000)}) == 6


# --- op3 ---


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\n\nSecond  thought."), (1, 1, "a", "> Hello there.\n\nHi! Reply.\n> second THOUGHT.\nmore"), (1, 2, "u", ">> hello there.\n> Hi! Reply.\n\nThanks"),
        (1, 3, "a", "> unknown\nok"), (2, 0, "u", None), (2, 1, "a", "> Hello there.\nx"), (None, 0, "u", "abc"), (None, 1, "a", "> abc\ny"), (3, None, "u", "> abc"), (4, 0, "u", "!!!"), (4, 1, "a", "> !!!"),
        (5, 0, "x", "q"), (5, 0, "x", "q"), (5, 1, "y", "> q\nr"),
    ]
    df = spark.createDataFrame([(*r, "c", 7) for r in rows], "conv_id long, turn long, role string, text string, parent string, rank int")
    got = [tuple(r) for r in quotes.conversations(df).orderBy("conv_id", "root", "rank").collect()]
    assert len(got) == len(rows)
    of = {(r[0], r[1]): r for r in got}
    assert of[1, 1][3:] == (0, 0, 1, 1, 2, 2, "Hi! Reply.\nmore")
    assert of[1, 2][3:] == (1, 0, 2, 2, 2, 2, "Thanks")
    assert of[1, 3][3:] == (None, 3, 0, 0, 1, 0, "ok") and of[2, 1][3] is None and of[4, 1][3] is None
    assert of[None, 1][3] == 0 and of[5, 1][3:7] == (0, 0, 1, 1) and of[2, 0][-1] == "" and of[3, None][3:7] == (None, None, 0, 0)
    assert quotes.conversations(df.limit(0)).count() == 0
    for name in ("passages", "conversations"):
        plan = getattr(quotes, name)(df)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_quotes_of_parts(spark):
    """A line, a wrapped sentence, and two messages' lines run together."""
    rows = [
        (1, 0, "u", "First line here\nsecond line. A sentence\nover two lines. The end."), (1, 1, "a", "> second line. A sentence\nyes"),
        (1, 2, "u", "> A sentence over\n> two lines.\nindeed"), (1, 3, "a", "> First line here\n> indeed\nboth"), (1, 4, "u", "> nobody said so\nno"),
        (None, 0, "u", "One. Two three."), (None, 1, "a", "> two three.\nx"), (None, 1, "a", "> two three.\nx"),
    ]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): (r.parent, r.n_quotes, r.n_linked) for r in got} == {
        (1, 0): (None, 0, 0), (1, 1): (0, 1, 1), (1, 2): (0, 1, 1), (1, 3): (2, 1, 1), (1, 4): (None, 1, 0), (None, 0): (None, 0, 0), (None, 1): (0, 2, 2),
    }


def slow_threads(rows):
    """By the docstring's rules, message by message: {(conv, turn): (parent, root, depth, rank, n_quotes, n_linked)} of rows (conv, turn, text) with distinct turns."""
    norm = lambda t: " ".join(t.lower().split())
    said, cut_up, parts = {}, {}, {}

    def bits(p):
        return {norm(x) for x in p.split("\n")} | {x for x in re.split(r"(?<=[.!?\u2026])\s+", norm(p))}

    for c, t, text in sorted(rows, key=lambda r: r[1]):
        now, before = [], None
        for line in re.split(r"\r\n?|\n", text or ""):
            m = re.match(r"(?:[ \t]{0,3}>)+", line)
            body, level = (re.sub(r"^[ \t]", "", line[m.end() :]), m[0].count(">")) if m else (line, 0)
            if not body.strip(" \t"):
                before = None
            elif level == before:
                now[-1][1] += "\n" + body
            else:
                now.append([level, body])
                before = level
        parts[c, t] = now
        for level, p in now:
            if not level and re.search(r"\w", p):
                said.setdefault((c, norm(p)), t)
                for x in bits(p):
                    cut_up.setdefault((c, x), t)
    parent, out, linked = {}, {}, {}
    for (c, t), now in parts.items():
        found = []
        for level, p in now:
            if level and re.search(r"\w", p):
                at = said.get((c, norm(p)), t)
                if at >= t:
                    at = max((o for x in bits(p) if re.search(r"\w", x) and (o := cut_up.get((c, x), t)) < t), default=t)
                if at < t:
                    found.append((level, at))
        ones = [o for level, o in found if level == 1]
        parent[c, t] = max(ones or [o for _, o in found], default=None)
        linked[c, t] = len(found)
    kids = collections.defaultdict(list)
    for (c, t), p in sorted(parent.items(), key=lambda x: x[0][1]):
        kids[c, p].append(t)

    def walk(c, t, root, depth, rank):
        out[c, t] = (parent[c, t], root, depth, rank, sum(level > 0 for level, _ in parts[c, t]), linked[c, t])
        for k in kids[c, t]:
            rank = walk(c, k, root, depth + 1, rank + 1)
        return rank

    for (c, t), p in parent.items():
        if p is None:
            walk(c, t, t, 0, 0)
    return out


def by_message(df):
    return {(r.conv_id, r.turn): (r.parent, r.root, r.depth, r.rank, r.n_quotes, r.n_linked) for r in df.collect()}


def test_quotes_against_brute_force(spark):
    """Random conversations: nested levels, whole passages, lines and sentences, odd marks and line ends, one hot conversation; turns negative and of over 12 digits."""
    rng = np.random.default_rng(8)
    pick = lambda x: x[rng.integers(len(x))]
    rows = []
    for c, size in ((None, 12), (1, 120), (2, 15), (3, 1), (4, 25)):
        said = []
        for k in range(size):
            lines = []
            for _ in range(int(rng.integers(4)) if said else 0):
                level = int(rng.integers(1, 4))
                mark = pick([">" * level + " ", "> " * level, " >" * level, ">" * level])
                text = pick(pick(said[-6:]))
                text = pick([text, pick(text.split("\n")), text.upper(), "unknown 12"])
                lines += [mark + x for x in text.split("\n")] + [""] * int(rng.integers(2))
            own = ["\n".join(pick(["yes.", "no", "well. so be it! " + str(k), f"word{rng.integers(40)} and. more{rng.integers(9)}", "12", "!!"]) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 3)))]
            said.append(own)
            rows.append((c, (k - 3) * 10**13 + 9 * (k % 2), pick(["\n", "\r\n", "\r"]).join(lines + "\n\n".join(own).split("\n"))))
    want = slow_threads(rows)
    assert max(x[2] for x in want.values()) > 4 and sum(x[5] for x in want.values()) > 40
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(5)
    assert by_message(quotes.conversations(df)) == want


def test_long_chains_and_crowds_of_replies(spark):
    """A chain in which each message answers the one before, and a message that hundreds answer."""
    rows = [(1, k, "u", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(150)] + [(2, k, "u", "> start\nanswer" if k else "start") for k in range(400)]
    rows += [(3, 0, "u", ">" * 30_000 + " deep\n" + "> line\n\n" * 3000 + "end")]
    got = by_message(quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)))
    assert all(got[1, k][:4] == (k - 1 if k else None, 0, k, k) for k in range(150))
    assert all(got[2, k][:4] == (0 if k else None, 0, int(k > 0), k) for k in range(400))
    assert got[3, 0][4:] == (3001, 0)


# --- op4, op6 ---


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = by_id(token_counts.count_tokens(table(spark), WORDS))
    for i, x in enumerate(TEXTS):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[i] == (len((x or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(empty(spark), WORDS).count() == 0


def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got, sums = by_id(pieces.encode(table(spark), PIECES)), by_id(pieces.digests(table(spark), PIECES))
    for i, x in enumerate(TEXTS):
        ids = sp.encode(x or "")
        assert list(got[i][0]) == ids and got[i][1] == sp.decode(ids) == pieces.decode(ids, PIECES)
        assert sums[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert pieces.encode(empty(spark), PIECES).count() == 0


# --- op5 ---


def test_mix(spark):
    docs = table(spark)
    got = mixing.taken_words(mixing.mix(docs, block=64)).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    open_ = set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert len(got) == docs.count() and all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.taken_words(mixing.mix(docs.repartition(3), block=64)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.taken_words(mixing.mix(empty(spark))).count() == 0


def slow_schedule(docs, block):
    """{(doc_id, source, size): (taken, first point, last point)} by filling the slots of the schedule one by one, in order of their points."""
    per = collections.defaultdict(list)
    for d, text, source in docs:
        per[source].append((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d, len((text or "").encode().split())))
    order = sorted(per, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[2] for x in per[s]) for s in order}
    weight, cap, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: 2 * size[s] for s in order}, 1.5 * sum(size.values())
    target, rest = {}, list(order)
    while rest:
        level = left / sum(weight[s] for s in rest)
        full = [s for s in rest if level * weight[s] >= cap[s]]
        for s in full or rest:
            target[s] = cap[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        rest = [s for s in rest if s not in full] if full else []
    places = [s for s in order for _ in range(-(-int(target[s]) // block))]
    m = max(1, (len(places) - 1).bit_length())
    points = sorted((int(f"{x:0{m}b}"[::-1], 2), s) for x, s in enumerate(places))
    words = {s: [(d, k) for _, d, k in sorted(per[s], key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])) * 2 for _ in range(k)][: int(target[s])] for s in order}
    filled, out = collections.Counter(), {}
    for point, s in points:
        for d in words[s][filled[s] : filled[s] + block]:
            n, first, _ = out.get((d[0], s, d[1]), (0, point, point))
            out[d[0], s, d[1]] = (n + 1, first, point)
        filled[s] += block
    return out


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_mix_against_a_slow_schedule(spark, monkeypatch, bucket):
    """Words taken and the slots that they fill, with many sources, a hot one, and buckets that split it."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * (i + 1)) if i % 7 else None, "hot" if i % 3 else f"s{rng.integers(9)}") for i in range(90)] + [(200, "a b", None), (201, "", "blank")]
    want = slow_schedule(rows, 16)
    got = mixing.taken_words(mixing.mix(table(spark, rows), block=16)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.taken, r.first_point, r.last_point) == want.get((r.doc_id, r.source, r.size), (0, None, None))


def test_scheduled_rows_come_in_order(spark):
    """Each row as often as the mix comes to it, sorted by its slots; no row of which words are taken is left out, and clashing names do no harm."""
    rows = [(i, " ".join([f"w{i}"] * (3 + i % 40)), f"s{i % 4}") for i in range(80)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, source string, s string, d long, times int, point long")
    segments = mixing.mix(docs, block=32).where("words > 0").groupBy("doc_id", "epoch").agg(F.min("point").alias("p")).collect()
    want = collections.Counter(r.doc_id for r in segments)
    out = mixing.scheduled(docs, block=32)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    assert collections.Counter(got) == want and max(want.values()) == 2
    first = {r.doc_id: min(x.p for x in segments if x.doc_id == r.doc_id) for r in segments}
    seen = list(dict.fromkeys(got))
    assert [first[d] for d in seen] == sorted(first.values())
    assert mixing.scheduled(docs.limit(0)).count() == 0


def test_sums_before(spark):
    from webloom.llm.common import sums_before

    rng = np.random.default_rng(2)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 11}", i * 7 % 1009, int(rng.integers(9))) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    want = {(g, o): sum(x for h, p, x in rows if h == g and p < o) for g, o, _ in rows}
    assert {(r.g, r.o): r.b for r in sums_before(df, ["g"], [F.col("o")], {"v": "b"}).collect()} == want
    want = {o: sum(x for _, p, x in rows if p > o) for _, o, _ in rows}
    assert {r.o: r.b for r in sums_before(df, [], [F.col("o").desc()], {"v": "b"}).collect()} == want


def test_schedule_spreads_sources(spark):
    got = mixing.slots(spark.createDataFrame([(1, 3000), (2, 1000), (3, 0), (4, 17)], "order int, words long"), block=10).orderBy("point").collect()
    assert collections.Counter(r.source_order for r in got) == {1: 300, 2: 100, 4: 2}
    assert [r.block_no for r in got if r.source_order == 2] == list(range(100))
    for n in (40, 200, 402):
        assert abs(sum(r.source_order == 2 for r in got[:n]) - n * 100 / 402) < 6


# --- op7 ---


def test_exact_dedup(spark):
    docs = table(spark)
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    got = exact_dedup.members(docs, salts=3).collect()
    assert len(got) == docs.count()
    want = {hashlib.sha256(k.encode()).hexdigest(): (min((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)
    rows = exact_dedup.distinct_rows(docs)
    assert rows.columns == docs.columns and sorted(str(r.doc_id) for r in rows.collect()) == sorted(str(k) for k, _ in want.values())
    assert exact_dedup.members(empty(spark)).count() == exact_dedup.distinct_rows(empty(spark)).count() == 0


def test_exact_dedup_of_hot_texts(spark, monkeypatch):
    """Half of all rows are copies of one text, a third of another: they meet their group by broadcast, the rest by a join; all but the ids as one at a time."""
    monkeypatch.setattr(exact_dedup, "HOT", 10)
    rows = [(i, "hot  text" if i % 2 else "warm" if i % 3 else f"own {i // 12}", "s") for i in range(300)] + [(None, "hot text", "s")]
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(" +", " ", t)].append(i)
    got = exact_dedup.members(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in got) == sorted((i is None, i or 0, min(x for x in v if x is not None), len(v)) for v in groups.values() for i in v)


def test_exact_dedup_compares_texts_where_digests_collide(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    docs = table(spark, [(1, "a", "s"), (2, "b", "s"), (3, "a", "s")])
    assert by_id(exact_dedup.members(docs).select("doc_id", "keep_id", "group_size")) == {1: (1, 2), 2: (2, 1), 3: (1, 2)}
    assert sorted(r.doc_id for r in exact_dedup.distinct_rows(docs).collect()) == [1, 2]


# --- op8 ---


def slow_repeats(rows, m, keep_first):
    count, first = collections.Counter(), {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - m + 1):
            count[b[i : i + m]] += 1
            first.setdefault(b[i : i + m], (d, i))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = {k for i in range(len(b) - m + 1) if count[b[i : i + m]] > 1 and not (keep_first and first[b[i : i + m]] == (d, i)) for k in range(i, i + m)}
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out[d] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("keep_first", "buffer"), [(False, 1 << 20), (True, 1 << 20), (False, 500)])
def test_repeats(spark, monkeypatch, keep_first, buffer):
    monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
    rng = np.random.default_rng(7)
    base = ["".join(rng.choice(list("abcd é"), n)) for n in (80, 300, 700)]
    rows = [(i, "".join(base[rng.integers(3)][int(rng.integers(60)) :][: int(rng.integers(400))] + "".join(rng.choice(list("xyz"), int(rng.integers(90)))) for _ in range(int(rng.integers(4))))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a" * 300), (63, rows[5][1]), (64, "b" * 64), (65, "b" * 40 + "c")]
    got = by_id(suffix_dedup.digests(table(spark, [(i, t, "s") for i, t in rows]), 64, keep_first, 16))
    assert got == slow_repeats(rows, 64, keep_first)
    assert suffix_dedup.digests(empty(spark)).count() == 0


def slow_passages(rows, n):
    """Words in windows of n words that stand in another document; rows with one id and text are one document."""
    docs = {(d, t or "") for d, t in rows}
    where = collections.defaultdict(set)
    words = {k: k[1].encode().split() for k in docs}
    for k, w in words.items():
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(k)
    return {k: len({x for i in range(len(w) - n + 1) if len(where[tuple(w[i : i + n])]) > 1 for x in range(i, i + n)}) for k, w in words.items()}


@pytest.mark.parametrize("part", [1 << 20, 30])
def test_passages(spark, monkeypatch, part):
    """Against brute force: copies, passages at edges and inside, repeats within one document, other white space, hot passages, null and empty texts."""
    monkeypatch.setattr(passages, "PART", part)
    rng = np.random.default_rng(5)
    base = [rng.choice(list("abcdefgh"), n).tolist() for n in (14, 40, 90)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(int(rng.integers(4))):
            b = base[rng.integers(3)][int(rng.integers(30)) :][: int(rng.integers(60))]
            text += b + [f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(15)))]
        rows.append((i, (" " if i % 3 else " \t\n").join(text)))
    own = " ".join(f"x{k}" for k in range(20))
    rows += [(90, None), (91, ""), (92, f"{own} . {own}"), (93, rows[3][1]), (94, rows[3][1]), (94, rows[3][1]), (95, " ".join(base[1])), (96, "é " * 11), (97, "é\u00a0" * 11)]
    keyed = suffix_dedup._keyed(table(spark, [(i, t, "s") for i, t in rows]), "doc_id", "text")
    got = collections.defaultdict(set)
    for r in passages.shared_words(keyed, 10, 3).collect():
        got[r.doc_id] |= {x for s, e in r.spans for x in range(s, e)}
    want = {d: n for (d, _), n in slow_passages(rows, 10).items()}
    assert {d: len(x) for d, x in got.items()} == {d: n for d, n in want.items() if n}
    assert want[95] == 40 and want[92] == 0
    out = by_id(suffix_dedup.digests(table(spark, [(i, t, "s") for i, t in rows]), 64, False, 16, passage_words=10))
    assert {d: x[4] for d, x in out.items()} == want and {d: x[:4] for d, x in out.items()} == by_id(suffix_dedup.digests(table(spark, [(i, t, "s") for i, t in rows]), 64, False, 16))
    assert suffix_dedup.digests(empty(spark), passage_words=51).count() == 0


def test_repeats_across_the_parts_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 300)
    rng = np.random.default_rng(11)
    line = "".join(rng.choice(list("abcdef"), 250))
    rows = [(0, "".join(rng.choice(list("uvwxyz"), 900)) + line + "-" * 20), (1, line + "".join(rng.choice(list("uvwxyz"), 500)) + line[30:]), (2, "q" * 700)]
    got = by_id(suffix_dedup.digests(table(spark, [(i, t, "s") for i, t in rows]), 64, False, 16))
    assert got == slow_repeats(rows, 64, False)


def test_longest_previous_factors():
    data = np.frombuffer(b"abracadabra" * 3 + bytes(range(20)) * 2, np.uint8)
    length, source = suffix_dedup.longest_matches(data, 9)
    raw = data.tobytes()
    for i in range(len(raw)):
        best = max((next((n for n in range(len(raw) - i) if raw[i + n] != raw[j + n]), len(raw) - i) for j in range(i)), default=0)
        assert min(length[i], 9) == (9 if best >= 9 else 0)
        assert length[i] == 0 or raw[source[i] : source[i] + length[i]] == raw[i : i + length[i]] and source[i] < i


# --- op9 ---

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div><div id='main'><h1>Title {0}</h1><p>First &amp; {0}<br>line<p>Second <b>bo</b>ld<script>if(a<b)x()</script><div class='ad'>Buy</div><form>f</form><div class='note'>Same on all</div></div><div class='comments'><p>Nice!</p></div><footer>&copy; {0}</footer></body></html>"


def test_main_texts(spark):
    rows = [(i, "https://Host.example/" + str(i), PAGE.format("long words of page number " + str(i) * 9)) for i in range(8)]
    rows += [(8, None, None), (9, "x", ""), (10, "http://solo/", "<article><p>only</p></article>"), (11, "http://solo2/", "<p>a < b &lt;i&gt; <p>c"), (11, "http://solo2/", "<p>a < b &lt;i&gt; <p>c")]
    df = spark.createDataFrame([(*r, "h", "w", "t") for r in rows], "page_id long, url string, html string, host string, wrapper string, text string")
    got = {r.page_id: r.text for r in wrappers.main_texts(df).collect()}
    say = "long words of page number " + "3" * 9
    assert got[3] == f"Title {say}\n\nFirst & {say} line\n\nSecond bold"
    assert got[8] == got[9] == "" and got[10] == "only" and got[11] == "a < b <i>\n\nc"
    assert wrappers.main_texts(df).count() == len(rows) and wrappers.main_texts(df.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    """Copies, rows that repeat, and pages that differ in attributes only are extracted as one page alone is."""
    page = "<article{}><h1>Head</h1><p>Story of the day</p></article>"
    rows = [(i, "http://same/" + str(i), page.format("")) for i in range(6)] + [(9, None, page.format(""))] * 7
    rows += [(20 + i, "http://marked/" + str(i), page.format(f" title='{i}'")) for i in range(6)]
    got = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r.text for r in got} == {"Head\n\nStory of the day"}


def test_the_wrapper_chooses_the_content():
    """Articles that mark cards, or a short piece, are not taken for the story that varies elsewhere; one that holds the story is taken whole."""
    story = [f"story {i} " * 40 for i in range(6)]
    cards = [f"<div><article><p>card {i}</p></article></div><div class='story'><h1>Head {i}</h1><p>{x}</p></div>" for i, x in enumerate(story)]
    w = wrappers.wrapper_of(cards)
    assert [wrappers.extract(p, w) for p in cards] == [f"Head {i}\n\n{x.strip()}" for i, x in enumerate(story)]
    held = [f"<div><p>news {i}</p></div><article><h1>Head {i}</h1><div><p>{x}</p></div></article>" for i, x in enumerate(story)]
    w = wrappers.wrapper_of(held)
    assert [wrappers.extract(p, w) for p in held] == [f"Head {i}\n\n{x.strip()}" for i, x in enumerate(story)]


def test_pruning_keeps_what_most_pages_have():
    """Two pages of over NODES slots in common, and what only some pages have."""
    long = "<body>" + "".join(f"<h2>part {i}</h2><p>same</p>" for i in range(20)) + "</body>"
    w = wrappers.wrapper_of([long, long + "<div><p>once</p></div>"])
    whole = w.count
    kept = wrappers.pruned(w, 10)
    assert kept.count == whole - 2 > 40


def test_simple_tree_matching():
    a, b = (wrappers.page_slot([html_dom.parse(x)], "html") for x in ("<div><p>1</p><ul><li>a</ul></div><hr>", "<div><ul><li>b</ul><p>2</p></div><table></table>"))
    assert wrappers.Matching().size(a, b) == 4  # html, div, ul, li
    both = wrappers.merged(a, b)
    assert both.n == 2 and [k.label for k in both.kids] == ["div", "hr", "table"]


def slow_match(a, b):
    """Simple tree matching by trying, for the first kid of either side, every way on."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), slow_match(x[0], y[0]) + best(x[1:], y[1:]) if x[0].label == y[0].label else 0)

    return 1 + best(a.kids, b.kids)


def test_tree_matching_against_brute_force():
    rng = np.random.default_rng(3)

    def tree(depth):
        return wrappers.Slot("abc"[rng.integers(3)], 1, "", 0, [tree(depth - 1) for _ in range(int(rng.integers(4)))] if depth else [])

    for _ in range(300):
        a, b = tree(3), tree(3)
        b.label = a.label
        a.put(a.kids), b.put(b.kids)
        assert wrappers.Matching().size(a, b) == slow_match(a, b)
        both = wrappers.merged(a, b)
        assert both.count == a.count + b.count - slow_match(a, b)


def test_deep_misaligned_pages_take_no_exponential_time():
    """Two pages whose kids stand in another order on each of 150 levels."""
    import time

    one, two = "x", "x"
    for _ in range(150):
        one, two = f"<div><p>a</p><div class=k>{one}</div><ul></ul></div>", f"<div><ul></ul><div class=k>{two}</div><p>b</p></div>"
    began = time.time()
    w = wrappers.wrapper_of([one, two])
    assert wrappers.extract(one, w) and wrappers.extract(two, w)
    assert time.time() - began < 1


def test_names_with_other_words_are_kept():
    page = "<article><p class='social-science'>a</p><div class='comment-free'><p>b</p></div><p class=related-work>c</p><div class=comment-list><p>d</p></div><div class='ad'>e</div><div id=siteNotice>f</div><section role=complementary>g</section></article>"
    assert wrappers.extract(page, None) == "a\n\nb\n\nc"


MENU = "Words of the menu " * 40


def test_hosts_of_many_pages_without_article_or_main(spark):
    """The wrapper alone finds the content and drops what is the same on all pages; taken away, the text changes."""
    pages = [f"<div><p>{MENU}</p></div><div><h2>Head {i}</h2><p>{('words of page ' + str(i) + ' ') * 20}</p></div><div><p>All rights</p></div>" for i in range(12)]
    got = wrappers.main_texts(spark.createDataFrame([(i, "http://plain/" + str(i), p) for i, p in enumerate(pages)], "page_id long, url string, html string"))
    for r in got.collect():
        assert r.text == f"Head {r.page_id}\n\n" + " ".join(["words of page " + str(r.page_id)] * 20)
        assert r.text != wrappers.extract(pages[r.page_id], None)


def test_wrappers_beyond_their_limit_say_so(spark):
    rows = [(i, "http://wide/" + str(i), "<body>" + "".join(f"<div class=c{chr(97 + i)}{chr(97 + k)}>x{i}</div>" for k in range(20)) + "<p>same</p></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert wrappers.wrappers(df).first()["n_pruned"] == 0
    w = wrappers.wrappers(df, nodes=30).first()
    assert w["n_pruned"] > 0 and '"p"' in w["wrapper"]


def test_more_hosts_than_a_worker_holds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "HOSTS", 3)
    rows = [(i, f"http://h{i % 7}/", f"<div><p>same</p></div><div><p>{'own ' * 30}{i}</p></div>") for i in range(70)]
    got = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"{'own ' * 30}{i}") for i in range(70)]


def test_deep_and_broken_pages():
    assert wrappers.extract("<div>" * 5000 + "x", None) == "x"
    assert wrappers.extract('<p>a<a title="b>c</p><p>d', None).startswith("a")


# --- op10 ---


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = [" ".join("".join(rng.choice(list("aeiourstln"), 5)) for _ in range(60)).capitalize() + "." for _ in range(150)]
    bad = [" ".join("".join(rng.choice(list("ABC$%#"), 5)) + "!!" for _ in range(60)) for _ in range(50)]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(good + bad)] + [(900, None, "s"), (901, "", "s"), (None, "x", "s"), (0, good[0], "s")])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1) for r in got)
    known = [(r.predicted, int(r.doc_id < 150)) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in quality.classify(docs, flipped).collect())
    assert quality.classify(empty(spark), labels).count() == 0
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_near_groups_sends_no_table_through_the_driver(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more of text {i % 7}") for i in range(200)], "doc_id long, text string")
    plan = simhash.near_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_second_pass_checks_all_pairs_of_a_large_cell(spark):
    for seed in (15, 30):
        rng = np.random.default_rng(seed)
        texts = []
        for _ in range(200):
            words = [f"w{k}" for k in range(100)]
            for k in rng.choice(100, 3, replace=False):
                words[k] = f"x{rng.integers(3)}_{k}"
            texts.append(" ".join(words))
        sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
        want = {(i, j) for i in range(200) for j in range(i + 1, 200) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}

        def least(edges):
            root = list(range(200))
            for _ in range(200):
                for a, b in edges:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {tuple(r) for r in simhash.similar(docs, 5, 0.8, tables=1).collect()}
        assert got <= want and least(got) == least(want)


def test_parities_never_tell_sets_further_apart_than_they_are():
    rng = np.random.default_rng(8)
    sets = [np.zeros(0, np.uint64)]
    for n in (1, 2, 63, 64, 65, 300, 1000, 1025, 20_000):
        base = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
        for share in (0.0, 0.1, 0.5):
            sets.append(np.unique(np.concatenate([base[: n - int(share * n)], rng.integers(0, 1 << 63, int(share * n), np.int64).astype(np.uint64)])))
    a, b = np.triu_indices(len(sets))
    truly = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    least = simhash.Apart([simhash.parities(x) for x in sets])(a, b, 500)
    assert (least <= truly).all() and (least[a == b] == 0).all()
    near = (truly > 0) & (truly < 0.25 * np.array([min(len(sets[i]), len(sets[j])) for i, j in zip(a, b, strict=True)]))
    assert near.sum() >= 6 and (least[near] > 0.5 * truly[near]).mean() > 0.7


def test_second_pass_hands_on_hardly_more_than_links(spark, monkeypatch):
    """Texts of one template that share shingles but are not similar are no rows of the second pass's result, nor is a pair that meets at many shingles as many."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(200):
        words = [f"w{k}" for k in range(100)]
        for k in rng.choice(100, 4, replace=False):
            words[k] = f"x{rng.integers(4)}_{k}"
        texts.append(" ".join(words))
    texts += [f"{x} one two three four" for x in texts[:20]]
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    n = len(texts)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    made, cross_pairs = [], simhash.cross_pairs

    def counted(*args):
        made.append(cross_pairs(*args).count())
        return cross_pairs(*args)

    monkeypatch.setattr(simhash, "cross_pairs", counted)
    found, _, more = simhash._two_passes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 0.8, 1, "doc_id", "text")
    root = list(range(n))
    edges = {tuple(r) for r in found.unionByName(more).collect()}
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert edges <= want and all(root[a] == root[b] for a, b in want) and len(want) >= 20
    assert len(made) == 1 and made[0] <= 2 * n
