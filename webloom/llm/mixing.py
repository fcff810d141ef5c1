r"""Mixing sources to target weights by a low-discrepancy source schedule.

Each source's documents, shuffled by a hash of their id, form an endless cycle of words that is cut into blocks of equal
size. A source whose target is T words owns ceil(T / block) places on the line [0, N) of all slots. The van der Corput
points of N slots (the bit reversal of a slot's place) are mapped through these cumulative weights: in the order of
the points every source comes up evenly spread, exactly as often as it has blocks. The rank of a slot among those of its
source names the block that fills it; segments of documents are joined to slots by source and block.

Targets: `weights`, repeated over the sources by code point (null last), share `factor` times all words. A target stops
at `most` times its source's words; the excess is shared again by weight until none is above. Solved at once: sources in
order of their cap per weight, the water level after each prefix of full ones.

No group of a hot source meets in a task: positions in the shuffled order are sums over hash buckets plus a
window inside each bucket (buckets grow in number with the rows), ranks of slots are computed in closed form, and sums over sources are made in ranges of them.

Defined results: a null text has 0 words and takes none; a null source is a source of its own; sources without words get
target 0; rows that repeat an id are mixed as documents of their own; empty input gives empty output. Extra columns play
no part. Order depends on ids and sizes alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named, one_space, sums_before, tidy

WEIGHTS = (3, 1, 2)
#: Words in a block.
BLOCK = 2048
#: Rows of one bucket of the shuffled order, about.
BUCKET_ROWS = 20_000


def word_count(c: Column) -> Column:
    r"""The number of [^\x20\x09-\x0D]+ in c; 0 for null."""
    t = F.trim(one_space(c))
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """by_source(source, source_size) with weight, cap, target (double) and order (by code point). Sums over the sources before one are made in ranges, so that there may be any number of sources."""
    rows = sums_before(by_source.withColumn("one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], {"one": "order"}).drop("one")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("order") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("order", F.col("order") + 1)
    # sources in the order in which they fill up: the caps and weights of those that do so before
    rows = cut(sums_before(rows, [], [F.col("cap") / F.col("weight"), F.col("order")], {"cap": "before", "weight": "lighter"}), few=True)
    whole = rows.agg((F.sum("source_size") * F.lit(float(factor))).alias("total"), F.sum("weight").alias("weights"))
    rows = rows.join(F.broadcast(whole)).withColumn("level", (F.col("total") - F.col("before")) / (F.col("weights") - F.col("lighter")))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    first = rows.agg(F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "order", "level")))["level"].alias("water"))
    rows = rows.join(F.broadcast(first)).withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("weight")))
    return rows.select("source", "source_size", "weight", "cap", "target", "order")


def shuffled(sized: DataFrame) -> DataFrame:
    """sized(doc_id, source, size, ...) with `start`: the words before it in its source's shuffled order."""
    n = sized.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / BUCKET_ROWS)))))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.withColumn("key", key).withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long"), 28 - min(bits, 28)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    above = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(above), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    rows = rows.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(inside))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.withColumn("start", F.col("base") + F.col("within")).drop("key", "within", "base", "s", "b")


def reversed_bits(x: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros_like(x)
    for j in range(m):
        out |= ((x >> j) & 1) << (m - 1 - j)
    return out


def _below(end: np.ndarray, point: np.ndarray, m: int) -> np.ndarray:
    """How many x in [0, end) have reversed_bits(x, m) < point: one class of x modulo a power of 2 for each set bit of the point."""
    n, low = np.zeros_like(point), np.zeros_like(point)
    for j in range(m):  # the point's bits from the top are x's bits from the bottom
        bit = (point >> (m - 1 - j)) & 1
        step = np.int64(1) << (j + 1)
        n += bit * np.maximum(0, (end - low + step - 1) // step)
        low |= bit << j
    return n


def slots(wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """The schedule: source_order, block_no, point; sort by point to read the mix. wanted(order, words): whole words to take of each source."""
    rows = wanted.withColumn("n_slots", F.ceil(F.col("words") / F.lit(block)).cast("long"))
    rows = cut(sums_before(rows, [], [F.col("order")], {"n_slots": "first"}), few=True)
    total = rows.agg(F.sum("n_slots")).first()[0] or 0
    m = max(1, int(total - 1).bit_length()) if total else 1
    chunk = 1 << 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for order, n, first, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = first + np.arange(c * chunk, min(n, (c + 1) * chunk), dtype=np.int64)
                point = reversed_bits(x, m)
                rank = _below(np.full_like(x, first + n), point, m) - _below(np.full_like(x, first), point, m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), order, np.int32)), pa.array(rank), pa.array(point)], ["source_order", "block_no", "point"])

    chunks = rows.where("n_slots > 0").select(F.col("order").cast("int"), "n_slots", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / chunk).cast("long"))).alias("c"))
    return chunks.repartition("order", "c").mapInArrow(tidy(fill), "source_order int, block_no long, point long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = 1.5, most: float = 2.0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as segments, one row for each part of a document that fills a slot: doc_id, nth, bucket (they tell rows that repeat an id apart), source, size, source_size, target, epoch, block_no, point (order of slots), at (first word in the document), words. A document of which nothing is taken has one row with words 0 and point null."""
    sized = cut(docs.select(named(id_col).alias("doc_id"), named(source_col).cast("string").alias("source"), word_count(named(text_col)).alias("size")))
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, factor, most).withColumn("words", F.floor("target").cast("long")), few=True)
    plan = sources.select(F.col("source").alias("s"), "source_size", "target", "order", F.col("words").alias("wanted"))
    rows = shuffled(sized)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epoch = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("wanted") / F.col("source_size")).cast("int") - 1)))
    some = rows.where("size > 0 and source_size > 0").withColumn("epoch", epoch)
    some = some.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("to", F.least("wanted", F.col("from") + F.col("size")))
    taken = some.where("to > from").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("from") / block).cast("long"), F.floor((F.col("to") - 1) / block).cast("long"))))
    lo, hi = F.greatest("from", F.col("block_no") * block), F.least("to", (F.col("block_no") + 1) * block)
    taken = taken.withColumn("at", lo - F.col("from")).withColumn("words", hi - lo).drop("from", "to")
    # a written table, so that the planner knows its size: it grows with the words and is broadcast only while that is small
    schedule = cut(slots(sources.select("order", "words"), block)).withColumnRenamed("source_order", "o").withColumnRenamed("block_no", "k")
    taken = taken.join(schedule, (F.col("order") == F.col("o")) & (F.col("block_no") == F.col("k"))).drop("o", "k")
    none = rows.where("size = 0 or source_size = 0 or start >= wanted").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("epoch", "int"), ("block_no", "long"), ("at", "long"))], F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("point"))
    return taken.unionByName(none).drop("start", "wanted")


def taken_words(segments: DataFrame) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, first_point and last_point (of the slots that its words fill; null if none is taken)."""
    by = ["source", "bucket", "nth", "doc_id", "size", "source_size", "target"]
    return segments.groupBy(*by).agg(F.sum("words").alias("taken"), F.min("point").alias("first_point"), F.max("point").alias("last_point")).drop("bucket", "nth")


def scheduled(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = 1.5, most: float = 2.0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix comes to them, with their own columns, in the order of the schedule: sorted by the first slot that a pass over the row fills, in ranges of slots. What is taken of a row in part comes whole, which is the last row of a source at most; rows without words, or of which nothing is taken, are left out. Rows that repeat an id are told apart by source and size; those that share these too come equally often."""
    segments = mix(docs, weights, factor, most, block, id_col, text_col, source_col)
    key = {"__webloom_id": "doc_id", "__webloom_source": "source", "__webloom_size": "size", "__webloom_epoch": "epoch"}
    passes = segments.where("words > 0").groupBy(*[F.col(c).alias(k) for k, c in key.items()]).agg(F.min("point").alias("__webloom_point"))
    passes = cut(passes, few=True)
    same = named(id_col).eqNullSafe(F.col("__webloom_id")) & named(source_col).cast("string").eqNullSafe(F.col("__webloom_source")) & (word_count(named(text_col)) == F.col("__webloom_size"))
    rows = docs.join(passes, same).repartitionByRange("__webloom_point").sortWithinPartitions("__webloom_point", "__webloom_id")
    return rows.drop("__webloom_point", *key)
