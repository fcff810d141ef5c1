r"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles. Anchors are the words of a covering code of length 64: the product of
two binary Golay codes [23, 12] (covering radius 3 each), a Hamming code [15, 11] (radius 1) and the repetition code
[3, 1] (radius 1), all of them perfect. Every distinct fingerprint has one home, the anchor within the radius in each block,
and is replicated to every anchor within radius plus threshold: those within radius + e of it in each block, the e
adding up to the threshold at most. Two fingerprints at the threshold or nearer then meet at the home of either one, so
comparing homes with visitors, anchor by anchor, finds each link, once. No bucket is capped.

Copies collapse into one fingerprint before anything is joined, so a hot group costs one row; a fingerprint has at most
2080 others within distance 2, so links grow in proportion to distinct fingerprints. Components are found by
star contraction over distinct fingerprints, each round cut with a checkpoint.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; a null id is never the smallest of its component unless all are null; repeated rows
count each; empty input gives empty output; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, maybe_in, named, shared_folder, slices, small_batches, tidy

SEED = 42
#: Generator polynomials of the binary Golay and Hamming codes (fixed values of those codes).
GOLAY, HAMMING, REPETITION = 0b101011100011, 0b10011, 0b111
#: Length, generator and covering radius of each block; the lengths add up to 64.
BLOCKS = ((23, GOLAY, 3), (23, GOLAY, 3), (15, HAMMING, 1), (3, REPETITION, 1))


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each shingle of a text, repeats included; of the whole text where it has fewer words; none where it has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    if not parts:
        return []
    digest, norm = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= words:
        return [digest(norm, SEED)]
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lens)
    starts = (ends - lens)[: len(parts) - words + 1].tolist()
    return [digest(norm[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of h."""
    n = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        n += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * n > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints_of(texts: list[str | None], words: int = 3) -> np.ndarray:
    """SimHash of each text: bit i is set if it is in over half the shingles' hashes."""
    return np.array([majority(np.array(h, np.uint64)) if (h := shingle_hashes(t, words)) else 0 for t in texts], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) for each input row."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            for i, j in slices(text):
                fp = fingerprints_of(text.slice(i, j - i).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache
def block_tables(n: int, generator: int, radius: int, threshold: int) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """For a perfect cyclic code: the syndrome of each byte at each place, the home's difference for each syndrome, and by e and syndrome the differences to the anchors at radius + e exactly (at e = 0 the home)."""
    degree = generator.bit_length() - 1

    def remainder(x: int) -> int:
        for i in range(n - 1, degree - 1, -1):
            if x >> i & 1:
                x ^= generator << (i - degree)
        return x

    single = [remainder(1 << i) for i in range(n)]
    by_byte = np.zeros(((n + 7) // 8, 256), np.int64)
    for k in range(by_byte.shape[0]):
        for v in range(256):
            s = 0
            for i in range(8):
                if v >> i & 1 and 8 * k + i < n:
                    s ^= single[8 * k + i]
            by_byte[k, v] = s
    cosets = 1 << degree
    near: list[list[list[int]]] = [[[] for _ in range(cosets)] for _ in range(threshold + 1)]
    for weight in range(min(n, radius + threshold) + 1):
        for places in combinations(range(n), weight):
            s = d = 0
            for p in places:
                s ^= single[p]
                d |= 1 << p
            near[max(0, weight - radius)][s].append(d)
    if any(len(x) != 1 for x in near[0]):
        raise ValueError("the code is not perfect")
    home = np.array([x[0] for x in near[0]], np.int64)
    return by_byte, home, [[np.array(x, np.int64) for x in level] for level in near]


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for n, _, _ in BLOCKS:
        out.append(((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64))
        at += n
    return out


def _syndrome(part: np.ndarray, by_byte: np.ndarray) -> np.ndarray:
    s = np.zeros_like(part)
    for k in range(by_byte.shape[0]):
        s ^= by_byte[k][(part >> (8 * k)) & 255]
    return s


def homes_of(fp: np.ndarray) -> np.ndarray:
    """The anchor that covers each fingerprint."""
    out, at = np.zeros(len(fp), np.uint64), 0
    for part, (n, g, r) in zip(_parts(fp), BLOCKS, strict=True):
        by_byte, home, _ = block_tables(n, g, r, 0)
        out |= (part ^ home[_syndrome(part, by_byte)]).astype(np.uint64) << np.uint64(at)
        at += n
    return out


def visits_of(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All (row of fp, anchor) with the anchor within covering radius plus threshold: block by block, with what is left of the threshold."""
    row, anchor, left, at = np.arange(len(fp)), np.zeros(len(fp), np.uint64), np.full(len(fp), threshold), 0
    for part, (n, g, r) in zip(_parts(fp), BLOCKS, strict=True):
        by_byte, _, near = block_tables(n, g, r, threshold)
        s = _syndrome(part, by_byte)
        rows, anchors, lefts = [], [], []
        for e, level in enumerate(near):
            can = np.flatnonzero(left >= e)
            sizes = np.array([len(x) for x in level])
            offs = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate(level) if sizes.sum() else np.zeros(0, np.int64)
            who = s[row[can]]
            rep = np.repeat(can, sizes[who])
            if not len(rep):
                continue
            nth = np.arange(len(rep)) - np.repeat(np.cumsum(sizes[who]) - sizes[who], sizes[who])
            d = flat[offs[s[row[rep]]] + nth]
            rows.append(row[rep])
            anchors.append(anchor[rep] | ((part[row[rep]] ^ d).astype(np.uint64) << np.uint64(at)))
            lefts.append(left[rep] - e)
        row, anchor, left = np.concatenate(rows), np.concatenate(anchors), np.concatenate(lefts)
        at += n
    return row, anchor


def links(distinct: DataFrame, threshold: int = 2, rows_at_once: int = 2000) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) at most `threshold` bits apart, each once."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(homes_of(fp.view(np.uint64)).view(np.int64)), pa.array(fp)], ["anchor", "a"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(all_fp), rows_at_once):
                fp = all_fp[i : i + rows_at_once]
                row, anchor = visits_of(fp.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[row])], ["at", "b"])

    at_home = distinct.select("fp").mapInArrow(tidy(homes), "anchor long, a long")
    away = distinct.select("fp").mapInArrow(tidy(visits), "at long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return at_home.join(away.hint("merge"), (F.col("anchor") == F.col("at")) & near).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges(a, b), by large-star and small-star rounds until nothing changes."""
    spark = edges.sparkSession
    shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    now = edges.select("a", "b").where("a <> b").distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("m").alias("a"), "b")
        # every node with its smaller neighbours: all of them and the node itself go to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        small = large.join(low.hint("merge"), F.col("b") == F.col("n")).select(F.col("m"), "a", "b")
        now = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).where("a <> b").distinct().checkpoint()
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 2) -> DataFrame:
    """One row for each input row: doc_id, fp (long), component_id (the smallest id reachable over links of at most `threshold` bits)."""
    rows = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), few=True)
    found = cut(links(distinct, threshold))
    roots = components(found)
    # sides that grow with the input are merged: a broadcast, even of what is small when packed, would pass through the driver
    of_root = distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    to = of_root.join(ids.hint("merge"), "root").select(F.col("fp").alias("f"), "component_id")
    return rows.join(to.hint("merge"), rows["fp"] == to["f"]).select("doc_id", "fp", "component_id")


#: Multipliers that draw further hashes from one, by an avalanche (fixed odd numbers).
MIXES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Blocks of the anchors of one table of `similar`: 37 of the sketch's bits, 20 of which are free in a code word.
SHORT = ((23, GOLAY, 3), (7, 0b1011, 1), (7, 0b1011, 1))
TABLES = 96


def sketch(h: np.ndarray) -> list[int]:
    """A SimHash of 256 bits of a set of hashes, as four signed longs."""
    if not len(h):
        return [0] * len(MIXES)
    out = []
    for m in MIXES:
        x = h * np.uint64(m)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(majority(x ^ x >> np.uint64(29)))
    return [x - (1 << 64) if x >> 63 else x for x in out]


#: Bits of the widest parities; wider ones would only turn away more pairs.
PARITY_BITS = 1 << 14


def parities(h: np.ndarray) -> bytes:
    """For each class of a set of hashes by their last bits, whether an odd number of them is in it: a power of two of classes, not fewer than hashes, up to PARITY_BITS."""
    m = min(PARITY_BITS, max(64, 1 << (len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


class Apart:
    """A lower bound, for pairs of some sets given by their parities, of how many hashes only one of both has: a class whose parities differ holds one at least. Of two widths the wider is folded, class by class of the narrower."""

    def __init__(self, of: list[bytes]) -> None:
        self.of, self.width, self.folded = of, np.array([len(x) for x in of]), {}

    def __call__(self, a: np.ndarray, b: np.ndarray, bytes_at_once: int = 1 << 22) -> np.ndarray:
        least, out = np.minimum(self.width[a], self.width[b]), np.zeros(len(a), np.int64)
        for w in np.unique(least).tolist():
            if w not in self.folded:
                rows = np.flatnonzero(self.width >= w)
                place = np.zeros(len(self.of), np.int64)
                place[rows] = np.arange(len(rows))
                self.folded[w] = place, np.stack([np.bitwise_xor.reduce(np.frombuffer(self.of[i], np.uint64).reshape(-1, w // 8), axis=0) for i in rows.tolist()])
            place, v = self.folded[w]
            some = np.flatnonzero(least == w)
            for i in range(0, len(some), max(1, bytes_at_once // w)):
                k = some[i : i + max(1, bytes_at_once // w)]
                out[k] = np.bitwise_count(v[place[a[k]]] ^ v[place[b[k]]]).sum(axis=1, dtype=np.int64)
        return out


def table_bits(tables: int) -> list[np.ndarray]:
    """Which of the 256 bits each table reads: a fixed random choice."""
    rng = np.random.default_rng(2026)
    n = sum(b[0] for b in SHORT)
    return [rng.permutation(64 * len(MIXES))[:n] for _ in range(tables)]


def anchors(sketches: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """For each row of sketches (n by 4, uint64) the anchor that covers it in each table, with the table's number above."""
    bits = np.unpackbits(np.ascontiguousarray(sketches).view(np.uint8).reshape(len(sketches), -1), axis=1, bitorder="little")
    out = np.empty((len(sketches), tables), np.int64)
    for t, chosen in enumerate(table_bits(tables)):
        code, at = np.full(len(sketches), t, np.int64) << 37, 0
        for n, g, r in SHORT:
            part = bits[:, chosen[at : at + n]].astype(np.int64) @ (np.int64(1) << np.arange(n))
            by_byte, home, _ = block_tables(n, g, r, 0)
            code |= (part ^ home[_syndrome(part, by_byte)]) << at
            at += n
        out[:, t] = code
    return out


def spanning(f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest of the rows of f (uint64 words) by differing bits, without those over `most`: Prim's algorithm, one row against all others at a time."""
    n = len(f)
    near, to, todo, edges = np.full(n, 1 << 20), np.zeros(n, np.int64), np.ones(n, bool), []
    i = 0
    todo[0] = False
    for _ in range(n - 1):
        d = np.bitwise_count(f ^ f[i]).sum(axis=1, dtype=np.int64)
        closer = todo & (d < near)
        near[closer], to[closer] = d[closer], i
        i = int(np.argmin(np.where(todo, near, 1 << 21)))
        todo[i] = False
        if near[i] <= most:
            edges.append((int(to[i]), i))
    return edges


#: Rows of one anchor that are compared all with each other; beyond them a block of rows meets the leaders of the blocks before it.
CELL_ROWS = 2000
#: An anchor is hot if over HOT_SHARE of about HOT_SAMPLE sketches are at it. Its rows are dealt to SALTS cells, whose leaders meet again.
HOT_SAMPLE, HOT_SHARE, SALTS = 20_000, 1 / 500, 64
#: The bits of an anchor and its table's number; a cell's number has the salt above them, 0 where the anchor is not hot.
ANCHOR_BITS = 48


def nearest(f: np.ndarray, leaders: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each row of f how many bits the nearest leader differs in, and which one it is."""
    best, at = np.full(len(f), 1 << 20), np.zeros(len(f), np.int64)
    for i in range(0, len(leaders), at_once):
        d = np.bitwise_count(f[:, None, :] ^ leaders[None, i : i + at_once, :]).sum(axis=2, dtype=np.int64)
        k = d.argmin(axis=1)
        least = d[np.arange(len(f)), k]
        closer = least < best
        best[closer], at[closer] = least[closer], i + k[closer]
    return best, at


def cell_links(ids: np.ndarray, f: np.ndarray, most: int, lead_ids: np.ndarray, lead_f: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links within a cell, block by block, and its leaders: one row of each group that no earlier leader is near. Each row of a block is linked to its nearest leader so far and by the block's forest, so a group of copies costs a block and a leader, however large it is."""
    found: list[tuple[int, int]] = []
    for s in range(0, len(ids), CELL_ROWS):
        i, g = ids[s : s + CELL_ROWS], f[s : s + CELL_ROWS]
        root, met = np.arange(len(i)), set()
        for x, y in spanning(g, most):
            found.append((int(i[x]), int(i[y])))
            root[y] = root[x]  # the forest grows from x to y
        best, at = nearest(g, lead_f)
        for x in np.flatnonzero(best <= most).tolist():
            found.append((int(lead_ids[at[x]]), int(i[x])))
            met.add(int(root[x]))
        new = [x for x in np.flatnonzero(root == np.arange(len(i))).tolist() if x not in met]
        lead_ids, lead_f = np.concatenate([lead_ids, i[new]]), np.concatenate([lead_f, g[new]])
    return found, lead_ids, lead_f


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between ids whose sets of word shingles have at least this Jaccard similarity, enough of them to join each group.

    Texts that are 0.8 similar differ in about 39 of a sketch's 256 bits, too many for one covering code to reach, so each of
    `tables` anchor sets, over 37 bits each, sends a sketch to its covering anchor (radius 5, threshold 0). Sketches at one anchor are
    compared with each other; a minimum spanning forest of the near ones goes on, so that copies in a group are no pairs, and its edges are
    checked on the shingles themselves. An anchor with over CELL_ROWS rows is taken in blocks (see cell_links), in an order that
    differs from table to table, and a hot one is dealt to many tasks, whose leaders are compared in a second round. Ids are whole numbers; null ids are never linked. A pair at 0.8 exactly meets
    in 96 tables with a probability of 0.92, at 0.85 of 0.98, at 0.9 of 0.999. What this leaves unjoined, in hot cells, between blocks,
    off a forest or in short texts, meets once more, at the rare shingles that two such texts always share (see prefix_cells), where all near pairs
    of different components are checked, whatever the size of a cell (see cross_pairs).
    """
    found, _, more = _two_passes(docs, words, similarity, tables, id_col, text_col)
    return found.unionByName(more).distinct()


def _two_passes(docs: DataFrame, words: int, similarity: float, tables: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of the first pass of similar(), their components (node, root), and links between these components, as cut tables."""
    small_batches(docs.sparkSession)
    text = named(text_col).cast("string")
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc_id is not null")
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * len(MIXES)
    most = int(np.ceil(bits * share + 3.5 * np.sqrt(bits * share * (1 - share))))
    words_of = [f"f{i}" for i in range(len(MIXES))]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(2), "")
            for i, j in slices(text):
                sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in text.slice(i, j - i).to_pylist()]
                got = np.array([sketch(h) for h in sets], np.int64)
                odd = pa.array([parities(h) for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *[pa.array(got[:, k]) for k in range(got.shape[1])], odd], ["doc_id", "th", *words_of, "odd"])

    def replicate(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                f = np.stack([part.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(MIXES))], axis=1)
                again = np.repeat(np.arange(len(f)), tables)
                cell = anchors(f.view(np.uint64), tables).ravel()
                if len(hot):
                    ids = part.column(0).to_numpy(zero_copy_only=False)[again].view(np.uint64)
                    mixed = (ids ^ cell.view(np.uint64) * np.uint64(MIXES[0])) * np.uint64(MIXES[1])
                    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(MIXES[2])
                    cell |= np.where(np.isin(cell, hot), (mixed >> np.uint64(40)).astype(np.int64) % SALTS + 1, 0) << ANCHOR_BITS
                yield pa.RecordBatch.from_arrays([pa.array(cell), *[c.take(pa.array(again)) for c in part.columns]], ["cell", "doc_id", *words_of])

    def compare(batches: Iterator[pa.RecordBatch], most: int, all_pairs: int) -> Iterator[pa.RecordBatch]:
        no_ids, no_f = np.zeros(0, np.int64), np.zeros((0, len(MIXES)), np.uint64)
        key, ids, f = no_ids, no_ids, no_f
        now, lead_ids, lead_f = -1, no_ids, no_f  # the cell at hand and its leaders so far
        links: list[tuple[int, int]] = []
        leaders: list[tuple[int, np.ndarray, np.ndarray]] = []

        def close() -> None:
            if now >> ANCHOR_BITS > 0:
                leaders.append((now & ((1 << ANCHOR_BITS) - 1), lead_ids, lead_f))

        def cells(key: np.ndarray, ids: np.ndarray, f: np.ndarray, goes_on: bool) -> None:
            nonlocal now, lead_ids, lead_f
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            some = (np.diff(cuts) > 1) | (key[cuts[:-1]] >> ANCHOR_BITS > 0) | (key[cuts[:-1]] == now)
            for i, j in zip(cuts[:-1][some].tolist(), cuts[1:][some].tolist(), strict=True):
                if key[i] != now:
                    close()
                    now, lead_ids, lead_f = int(key[i]), no_ids, no_f
                if goes_on or len(lead_ids) or j - i > CELL_ROWS or now >> ANCHOR_BITS > 0:
                    found, lead_ids, lead_f = cell_links(ids[i:j], f[i:j], most, lead_ids, lead_f)
                    links.extend(found)
                elif j - i <= all_pairs:
                    x, y = np.triu_indices(j - i, 1)
                    near = np.bitwise_count(f[i + x] ^ f[i + y]).sum(axis=1, dtype=np.int64) <= most
                    links.extend(zip(ids[i + x[near]].tolist(), ids[i + y[near]].tolist(), strict=True))
                else:
                    links.extend((int(ids[i + x]), int(ids[i + y])) for x, y in spanning(f[i:j], most))

        def out() -> pa.RecordBatch:
            ends = np.array(links, np.int64).reshape(-1, 2)
            no = pa.nulls(len(ends), pa.int64())
            pairs = [pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1)), no, no, *[no for _ in MIXES]]
            cell = np.concatenate([no_ids, *[np.full(len(i), c, np.int64) for c, i, _ in leaders]])
            lead = np.concatenate([no_ids, *[i for _, i, _ in leaders]])
            bits = np.concatenate([no_f, *[g for _, _, g in leaders]]).view(np.int64)
            rest = pa.nulls(len(cell), pa.int64())
            heads = [rest, rest, pa.array(cell), pa.array(lead), *[pa.array(bits[:, k].copy()) for k in range(len(MIXES))]]
            links.clear()
            leaders.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(pairs, heads, strict=True)], ["a", "b", "cell", "doc_id", *words_of])

        for r in batches:
            key = np.concatenate([key, r.column(0).to_numpy(zero_copy_only=False)])
            ids = np.concatenate([ids, r.column(1).to_numpy(zero_copy_only=False)])
            f = np.concatenate([f, np.stack([r.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(MIXES))], axis=1).view(np.uint64)])
            if len(key) >= 20000:  # the last cell may go on
                one = key[0] == key[-1]
                n = len(key) if one else int(np.flatnonzero(key != key[-1])[-1]) + 1
                cells(key[:n], ids[:n], f[:n], one)
                yield out()
                key, ids, f = key[n:], ids[n:], f[n:]
        if len(key):
            cells(key, ids, f, False)
        close()
        yield out()

    bits_schema = "doc_id long, " + ", ".join(f"{x} long" for x in words_of)
    sketches = cut(rows.mapInArrow(tidy(draw), bits_schema.replace("doc_id long", "doc_id long, th long") + ", odd binary"))

    def spread(some: DataFrame, hot: np.ndarray) -> DataFrame:
        return some.select("doc_id", *words_of).mapInArrow(tidy(lambda batches: replicate(batches, hot)), "cell long, " + bits_schema)

    def compared(cells: DataFrame, most: int, all_pairs: int) -> DataFrame:
        mixed = F.xxhash64("doc_id", "cell")
        return cells.repartition("cell").sortWithinPartitions("cell", mixed, "doc_id").mapInArrow(tidy(lambda batches: compare(batches, most, all_pairs)), "a long, b long, cell long, " + bits_schema)

    # at most tables / HOT_SHARE anchors are hot, whatever the size; which ones only says how the work is dealt out
    share_of = min(1.0, HOT_SAMPLE / max(1, sketches.count()))
    sample = sketches.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(1 << 30)) < int(share_of * (1 << 30)))
    n_sample = sample.count()
    often = spread(sample, np.zeros(0, np.int64)).groupBy("cell").count().where(F.col("count") > max(50, int(HOT_SHARE * n_sample)))
    hot = np.array(sorted(r[0] for r in often.select("cell").collect()), np.int64)

    def linked(cells: DataFrame, most: int, all_pairs: int = 2) -> DataFrame:
        """Pairs (a, b) that lie near in a cell, or as leaders of the cells of a hot anchor: a forest, or all pairs of a cell of so few rows."""
        first = cut(compared(cells, most, all_pairs))
        again = compared(first.where("a is null").select("cell", "doc_id", *words_of), most, all_pairs)
        both = first.where("a is not null").select("a", "b").unionByName(again.where("a is not null").select("a", "b")).where("a <> b")
        both = cut(both.distinct(), few=True)
        forget(first)
        return both

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a cut table) that are similar by their shingles. An id with a large share of the pairs, a leader's, has its shingles sent to several tasks."""
        ends = pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n"))).distinct()
        sets = maybe_in(rows, F.col("doc_id"), ends).join(ends, F.col("doc_id") == F.col("n"), "left_semi").select("doc_id", "text").mapInArrow(tidy(shingle_sets), "doc_id long, shingles binary")
        share = max(PAIRS_AT_ONCE, pairs.count() // HOT_IDS)
        both = pairs
        for end, x, found in (("a", "x", "s"), ("b", "y", "t")):
            # at most HOT_IDS ids have over 1 / HOT_IDS of the pairs
            hot = F.broadcast(pairs.groupBy(F.col(end).alias("h")).count().where(F.col("count") > share).select("h", F.ceil(F.col("count") / share).cast("int").alias("parts")))
            side = sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(found)).join(hot, F.col(x) == F.col("h"), "left")
            side = side.select(x, found, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias(f"part_{x}"))
            both = both.join(hot, F.col(end) == F.col("h"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int"), F.lit(0))).drop("h", "parts")
            both = both.join(side, (F.col(end) == F.col(x)) & (F.col("part") == F.col(f"part_{x}"))).drop("part", x, f"part_{x}")
        return both.select("a", "b", "s", "t").mapInArrow(tidy(check), "a long, b long").distinct()

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            for i, j in slices(text):
                sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)).tobytes() for t in text.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                whole = len(x) + len(y) - both
                keep.append(not whole or both >= similarity * whole)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = linked(spread(sketches, hot), most)
    found = cut(verified(near), few=True)
    roots = cut(components(found).distinct(), few=True)
    # a wider cut than before, as nothing else is to be found here: that of sets of 4 and 5, the smallest that are similar but not equal
    rest = cut(cross_pairs(prefix_cells(rows, roots, sketches, words, similarity), int(bits * 3 / 16 + 6 * np.sqrt(bits * 3 / 16 * 13 / 16)), similarity).distinct(), few=True)
    return found, roots, cut(verified(rest), few=True)


#: A cell of a rare shingle with more rows is cut into parts of about so many, each pair of which is a cell of its own.
PART_ROWS = 4000
#: Ids with over 1 / HOT_IDS of all pairs, and over PAIRS_AT_ONCE, are compared in several tasks.
HOT_IDS, PAIRS_AT_ONCE = 500, 1000
#: A shingle on so many of about PREFIX_SAMPLE texts is common: common shingles come last in the order that prefixes are taken in, the commonest at the end.
PREFIX_SAMPLE, COMMON = 20_000, 5


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set h in the common order, so many that two sets of this similarity have one of them in common."""
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
    return h[: len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1]


def prefix_cells(rows: DataFrame, roots: DataFrame, sketches: DataFrame, words: int, similarity: float) -> DataFrame:
    """The sketch of each text of rows(doc_id, th, text) at its first shingles, where these stand in texts of different components (roots: node, root): shingle, p, q, part, doc_id, root, n (the set's size), at (the shingle's place in it), the sketch and the parities.

    Two sets with a Jaccard similarity of t have more in common than what either has behind its first n - ceil(t n) + 1 shingles,
    in any order that holds for all sets; so they share one of these, and meet in its cell. Rare shingles come first, so cells are small:
    what many texts share brings together only texts of hardly anything else. Of shingles that exactly the same texts have in front only the first in that order
    has a cell, as all pairs of the others meet there before. No cell is capped: one with over PART_ROWS rows is cut into parts, and a row goes
    to a cell (p, q) for each part that its own may be paired with.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for b in batches:
            text = pc.fill_null(b.column(2), "")
            for i, j in slices(text):
                # a text without words is the set of one shingle, 0
                yield b.slice(i, j - i), [np.unique(np.array(shingle_hashes(t, words) or [0], np.uint64)) for t in text.slice(i, j - i).to_pylist()]

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64))], ["shingle"])

    share_of = min(1.0, PREFIX_SAMPLE / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("prefix"), "doc_id"), F.lit(1 << 30)) < int(share_of * (1 << 30)))
    often = sample.mapInArrow(tidy(all_of), "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON).toArrow()
    common, counts = often["shingle"].to_numpy().view(np.uint64), often["count"].to_numpy()
    by = np.argsort(common)
    common, counts = common[by], counts[by]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, some in sets(batches):
            first = [prefix(h, similarity, common, counts) for h in some]
            sizes = [len(x) for x in first]
            again = pa.array(np.repeat(np.arange(len(some)), sizes))
            n = np.repeat(np.array([len(h) for h in some], np.int64), sizes)
            at = np.concatenate([np.arange(k, dtype=np.int64) for k in sizes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), b.column(0).take(again), b.column(1).take(again), pa.array(n), pa.array(at)], ["shingle", "doc_id", "th", "n", "at"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of shingles those whose shingle another row has too. The last row waits for the next batch."""
        held: pa.RecordBatch | None = None
        before = False  # the held row's shingle is also on the row before it
        for b in batches:
            if not b.num_rows:
                continue
            rows_now = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks().to_batches()[0]
            key = rows_now.column(0).to_numpy(zero_copy_only=False)
            same = key[1:] == key[:-1]
            keep = np.concatenate([[before], same]) | np.concatenate([same, [False]])
            yield rows_now.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
            held, before = rows_now.slice(len(key) - 1), bool(same[-1]) if len(same) else before
        if held is not None and before:
            yield held

    schema = "shingle long, doc_id long, th long, n long, at long"
    firsts = rows.mapInArrow(tidy(prefixes), schema).repartition("shingle").sortWithinPartitions("shingle").mapInArrow(tidy(shared), schema)
    firsts = cut(firsts.distinct())
    known = firsts.join(roots, F.col("doc_id") == F.col("node"), "left").select("shingle", "doc_id", "th", "n", "at", F.coalesce("root", "doc_id").alias("root"))
    members = [F.bit_xor(F.xxhash64(*c)).alias(m) for m, c in (("m0", ("doc_id", "th")), ("m1", ("th", "doc_id", F.lit("members"))))]
    split = known.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"), *members).where("r0 <> r1")
    split = split.groupBy("rows", "m0", "m1").agg(F.min_by("shingle", "first").alias("k"))  # a text has each shingle at another place, so the first is one
    split = split.select("k", F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts"))
    known = known.join(split, F.col("shingle") == F.col("k")).withColumn("part", F.pmod(F.xxhash64("doc_id", "th"), F.col("parts")).cast("int"))
    bits = sketches.dropDuplicates(["doc_id", "th"]).withColumnsRenamed({"doc_id": "d", "th": "t"})
    known = known.join(bits, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t"))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    known = known.withColumns({"p": F.least("part", "x"), "q": F.greatest("part", "x")})
    out = cut(known.select("shingle", "p", "q", "part", "doc_id", "root", "n", "at", *[c for c in sketches.columns if c not in ("doc_id", "th")]))
    forget(firsts)
    return out


def cross_pairs(cells: DataFrame, most: int, similarity: float, at_once: int = 64, pairs_at_once: int = 50_000) -> DataFrame:
    """Pairs (a, b) of the cells of prefix_cells() that may be similar, all of them: of different components, sketches at most `most` bits apart,
    enough shingles from the cell's on, and parities that differ in no more classes than similar sets in shingles. Both last are exact: what two sets have in common
    begins at the first shingle they share, so at that cell the smaller rest of the two bounds it; and see Apart. A pair that meets in several cells of a task comes once from each `pairs_at_once` pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal size
            size = 0
            ends = np.concatenate([np.zeros((0, 2), np.int64), *found])
            ends = np.unique(np.sort(ends, axis=1), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

        def pairs(c: np.ndarray, odd: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            p, q, part, ids, root, n, at = (c[:, 1 + k] for k in range(7))
            f, rest = c[:, 8:].view(np.uint64), n - at
            two_parts, apart = bool(p[0] != q[0]), Apart(odd)
            for i in range(0, len(c), at_once):
                x = slice(i, i + at_once)
                may = root[x, None] != root[None, i:]
                may &= np.minimum(rest[x, None], rest[None, i:]) >= similarity / (1 + similarity) * (n[x, None] + n[None, i:]) - 1e-6
                if two_parts:
                    may &= part[x, None] != part[None, i:]
                a, b = np.nonzero(np.triu(may, 1))
                if not len(a):
                    continue
                a, b = i + a, i + b
                near = np.bitwise_count(f[a] ^ f[b]).sum(axis=1, dtype=np.int64) <= most
                a, b = a[near], b[near]
                near = apart(a, b) <= (1 - similarity) / (1 + similarity) * (n[a] + n[b]) + 1e-6
                if near.any():
                    found.append(np.stack([ids[a[near]], ids[b[near]]], axis=1))
                    size += len(found[-1])
                if size >= pairs_at_once:
                    yield out()

        held: list[tuple[np.ndarray, list[bytes]]] = []  # rows of the last cell, which may go on

        def last() -> tuple[np.ndarray, list[bytes]]:
            return np.concatenate([c for c, _ in held]), [x for _, odd in held for x in odd]

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for x in b.columns[:-1]], axis=1)
            odd = b.columns[-1].to_pylist()
            cuts = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1).tolist(), len(rows)]
            if held and (held[-1][0][-1, :3] != rows[0, :3]).any():
                yield from pairs(*last())
                held = []
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                held.append((rows[i:j].copy(), odd[i:j]))
                if k < len(cuts) - 2:  # the batch's last cell may go on
                    if len(held) > 1 or j - i > 1:
                        yield from pairs(*last())
                    held = []
        if held:
            yield from pairs(*last())
        yield out()

    return cells.repartition("shingle", "p", "q").sortWithinPartitions("shingle", "p", "q").mapInArrow(tidy(run), "a long, b long")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of each group that similar() joins only those of the smallest id. Rows that repeat an id stay or go together; rows with a null id stay."""
    _, roots, more = _two_passes(docs, words, similarity, TABLES, id_col, text_col)
    # links of the second pass join components, which stand for all their nodes
    for end in ("a", "b"):
        of = roots.select(F.col("node").alias("n"), F.col("root").alias("of"))
        more = more.join(of, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("of", end)).drop("n", "of")
    joined = cut(components(more.distinct()).distinct(), few=True).withColumnsRenamed({"node": "n", "root": "r"})
    known = roots.join(joined, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
    alone = joined.join(roots.select("node"), F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("r").alias("root"))
    gone = cut(known.unionByName(alone).where("node <> root").select(F.col("node").alias("__webloom_gone")).distinct(), few=True)
    key = named(id_col).cast("long")
    unsure = maybe_in(docs, key, gone).join(gone, key == F.col("__webloom_gone"), "left_anti")
    return maybe_in(docs, key, gone, "left_anti").unionByName(unsure)
