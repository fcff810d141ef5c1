r"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts that are marked good; unlabelled texts are drawn from all. A linear score over features of
the text is fitted by minimising the non-negative unbiased risk: with class prior p, the risk of good texts counts p
times on the positives, and the risk of bad ones is that of the unlabelled less p times that of the positives, never
below 0; where it would be, a step undoes the excess instead. The prior is the share of good texts among the marked rows
that may be learnt from.

Features come from the whole text: the shares of kinds of bytes and of words by shape, how much of the text repeats, its
length, and shares of hashed pairs of neighbouring bytes.

The fit reads bounded samples (`positives`, `unlabelled` rows, by the order of a hash of the id, which is the only bound);
their features go to the driver, 1.2 kB a row. Scoring reads every text, in array batches.

Defined results: a null text counts as empty and is scored; without any positives every score is the prior (0.5 where
nothing is marked at all); rows that repeat are scored each; labels of unknown documents are ignored; an empty table gives
no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, slices, small_batches, tidy

PAIRS = 256
DENSE = 26
N_FEATURES = DENSE + PAIRS
#: Bytes of text at a time; a byte takes about 150 bytes of arrays.
SLICE = 1 << 20

_KIND = np.zeros(256, np.int64)  # 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 line end, 6 . , ; : ? ' " - ( ), 7 ! 8 | 9 other ASCII signs, 10 above ASCII
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[32, 9]] = 4
_KIND[[10, 11, 12, 13]] = 5
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 9
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 6
_KIND[ord("!")], _KIND[ord("|")] = 7, 8
_KIND[128:] = 10
N_KINDS = 11


def features_of(texts: list[bytes]) -> np.ndarray:
    """One row of features for each text, as float32."""
    n = len(texts)
    out = np.zeros((n, N_FEATURES), np.float32)
    lens = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), lens)
    kind = _KIND[data]
    size = np.maximum(lens, 1)[:, None]
    out[:, :N_KINDS] = np.bincount(doc * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, N_KINDS) / size
    same = doc[1:] == doc[:-1]
    pair = (data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761) >> np.uint32(24)
    pairs = np.bincount(doc[1:][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, DENSE:] = np.sqrt(pairs / size)
    # words: where a byte that is no space follows one or starts a text
    space = (kind == 4) | (kind == 5)
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1] | ~same]))
    if len(begins):
        stops = np.flatnonzero(~space & np.concatenate([space[1:] | ~same, [True]]))
        of = doc[begins]
        words = np.maximum(np.bincount(of, minlength=n), 1)
        width = stops - begins + 1
        first, last = kind[begins], kind[stops]
        upper = np.concatenate([[0], np.cumsum(kind == 2)])
        lower = np.concatenate([[0], np.cumsum(kind == 1)])
        ups, lows = upper[stops + 1] - upper[begins], lower[stops + 1] - lower[begins]
        shape = [
            (last == 6), (last == 7) | (last == 9), (width == 1) & (first == 8), (width == 1), (ups >= 2) & (lows == 0), (first == 2) & (ups == 1),
            (width > 14), (first == 3), (last == 9) & (width > 3) & (data[stops] == data[np.maximum(stops - 1, 0)]),
        ]
        for k, x in enumerate(shape):
            out[:, N_KINDS + k] = np.bincount(of[x], minlength=n) / words
        out[:, 20] = np.bincount(of, weights=width, minlength=n) / words / 10
        out[:, 21] = np.log1p(words) / 10
        out[:, 22] = _repeated(data, begins, stops, of, n, words)
    ends = np.bincount(doc[data == 10], minlength=n) + 1
    out[:, 23] = np.log1p(ends) / 10
    out[:, 24] = np.log1p(lens / ends) / 10
    out[:, 25] = lens == 0
    return out


def _repeated(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, of: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
    """The share of word triples that come again in the same text."""
    if len(begins) < 3:
        return np.zeros(n)
    none = np.zeros(1, np.uint64)
    sums = np.concatenate([none, np.cumsum(data * np.arange(1, len(data) + 1, dtype=np.uint64))])
    plain = np.concatenate([none, np.cumsum(data, dtype=np.uint64)])
    place = begins.astype(np.uint64)
    total = plain[stops + 1] - plain[begins]
    with np.errstate(over="ignore"):
        code = (sums[stops + 1] - sums[begins] - place * total) * np.uint64(0x9E3779B97F4A7C15) ^ total * np.uint64(0xC2B2AE3D27D4EB4F) ^ (stops - begins).astype(np.uint64)
        triple = (code[:-2] * np.uint64(31) + code[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + code[2:]
        triple = triple ^ triple >> np.uint64(29)
        inside = np.flatnonzero(of[2:] == of[:-2])
        key = triple[inside] ^ of[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(inside), bool)
    again[first] = False
    return np.bincount(of[inside][again], minlength=n) / words


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.centre) / self.scale).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.03, decay: float = 1e-3, seed: int = 7) -> Model:
    """Minimises the non-negative PU risk of the logistic loss by Adam on mini-batches."""
    prior = float(np.clip(prior, 0.01, 0.99))
    n = positive.shape[1] if len(positive) else unlabelled.shape[1] if len(unlabelled) else N_FEATURES
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(n), float(np.log(prior / (1 - prior))), np.zeros(n, np.float32), np.ones(n, np.float32), prior)
    centre, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-4
    xp, xu = (positive - centre) / scale, (unlabelled - centre) / scale
    xp, xu = np.clip(xp, -8, 8), np.clip(xu, -8, 8)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    kept_w, kept_b = np.zeros(n), 0.0
    for step in range(1, steps + 1):
        p = xp[rng.integers(0, len(xp), min(len(xp), 1024))]
        u = xu[rng.integers(0, len(xu), min(len(xu), 2048))]
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_good = -prior * (1 - sp) / len(p)  # d risk of positives as positives
        g_bad_u, g_bad_p = su / len(u), -prior * sp / len(p)
        if negative >= 0:
            gz_p, gz_u = g_good + g_bad_p, g_bad_u
        else:  # undo the excess
            gz_p, gz_u = -g_bad_p, -g_bad_u
        g = np.append(gz_p @ p + gz_u @ u + decay * w, gz_p.sum() + gz_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if step > steps // 2:  # the mean of the later half
            kept_w, kept_b = kept_w + w, kept_b + b
    half = steps - steps // 2
    return Model(kept_w / half, kept_b / half, centre.astype(np.float32), scale.astype(np.float32), prior)


def held_out(id_col: Column) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text leaves 1 modulo 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def _feature_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(0), "")
            for i, j in slices(text, SLICE):
                x = features_of(pc.cast(text.slice(i, j - i), pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return rows.select("text").mapInArrow(tidy(run), "x binary")


def fit(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labels(doc_id, quality), of rows that are not held out, and from unlabelled rows of docs, at most so many of each: those first in the order of a hash of the id."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").alias("l"), F.col("quality").cast("int").alias("q")).where(~held_out(F.col("l"))).where("q is not null")
    share = marked.agg(F.avg((F.col("q") == 1).cast("double"))).first()[0]
    order = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    first_ids = marked.where("q = 1").select(F.col("l").alias("doc_id")).distinct().orderBy(order, "doc_id").limit(positives)
    good = own.join(F.broadcast(first_ids), "doc_id", "left_semi")  # at most `positives` ids
    some_ids = own.select("doc_id").distinct().orderBy(F.xxhash64(F.lit("unlabelled"), F.col("doc_id")), "doc_id").limit(unlabelled)
    free = own.join(F.broadcast(some_ids), "doc_id", "left_semi")
    arrays = []
    for rows in (good, free):
        one = rows.groupBy("doc_id").agg(F.min("text").alias("text"))  # of rows that repeat an id
        got = _feature_rows(one).toArrow().column("x").to_pylist()
        x = np.frombuffer(b"".join(got), np.float32).reshape(-1, N_FEATURES)
        arrays.append(x[np.lexsort(x.T[:24])] if len(x) else x)  # an order that no run changes
    return fit_nnpu(arrays[0], arrays[1], 0.5 if share is None else share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1) of each row, with the columns named in keep after them."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(id_col).alias("__webloom_id"), named(text_col).cast("string").alias("__webloom_text"), *[named(c) for c in keep])
    schema = ", ".join([f"doc_id {rows.schema[0].dataType.simpleString()}", "score double", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            for i, j in slices(text, SLICE):
                part = pc.cast(text.slice(i, j - i), pa.binary()).to_pylist()
                x = np.clip((features_of(part) - model.centre) / model.scale, -8, 8) * model.scale + model.centre
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(model.score(x)), *[b.column(k).slice(i, j - i) for k in range(2, b.num_columns)]], ["doc_id", "score", *keep])

    return rows.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, positives, unlabelled))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
