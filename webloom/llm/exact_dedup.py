r"""Exact dedup by skew-safe combining, in DataFrame functions only.

Rows are deduplicated locally (partial aggregation), groups of equal digest are merged under a salt taken from the map
partition, and the winners of all salts are combined globally. Each of these steps groups by the digest and the full
text, so two texts of one digest never merge. Only digests travel in the last step, which gives each row its group: by
then it is known whether a digest stands for one text, and how many rows have it. The few texts that a large share of the rows
have are broadcast, all others joined. Digests that stand for several texts take a join on the full text.

Defined results: a null text equals the empty one; a null id loses to any other; rows that repeat both the id and the
text of the row that stays all count in group_size and are all marked kept in `members` (they are the same row), while
`distinct_rows` returns one of them. Empty input gives empty output. Columns other than id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, named, one_space

#: Partial groups of one text that meet in a task are at most the map partitions over this, and then this many.
SALTS = 64
#: Texts with over 1 / HOT of all rows; there are fewer than HOT of them, so they may be broadcast whatever the size of the table.
HOT = 2000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(named(id_col).alias("doc_id"), one_space(named(text_col)).alias("norm"))
    return rows.withColumn("digest", F.sha2("norm", 256))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: digest, norm, keep_id, group_size."""
    local = _keyed(docs, id_col, text_col).withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("digest", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _by_digest(found: DataFrame) -> DataFrame:
    """found without the texts; n_texts above 1 tells of texts that share a digest."""
    return cut(found.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_texts")), few=True)


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256 (of the text with single spaces)."""
    found = winners(docs, id_col, text_col, salts)
    groups = _by_digest(found)
    rows = _keyed(docs, id_col, text_col)
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = F.col("group_size") * HOT > total
    single = groups.where("n_texts = 1").drop("n_texts")
    # copies of a hot text meet its row by broadcast and travel on under keys of their own; no other key has over 1 / HOT of the rows
    near = F.broadcast(single.where(hot).select(F.col("digest").alias("d1"), F.col("keep_id").alias("k1"), F.col("group_size").alias("n1")))
    far = single.where(~hot).select(F.col("digest").alias("d2"), F.col("keep_id").alias("k2"), F.col("group_size").alias("n2"))
    out = rows.select("doc_id", "digest").join(near, F.col("digest") == F.col("d1"), "left")
    key = F.when(F.col("d1").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("doc_id").cast("string")))
    out = out.withColumn("key", key).join(far, F.col("key") == F.col("d2"), "left").where("n1 is not null or n2 is not null")
    out = out.select("doc_id", "digest", F.when(F.col("n1").isNotNull(), F.col("k1")).otherwise(F.col("k2")).alias("keep_id"), F.coalesce("n1", "n2").alias("group_size"))
    shared = groups.where("n_texts > 1").select("digest")
    if not shared.isEmpty():
        texts = rows.join(shared, "digest")
        out = out.unionByName(texts.join(found, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with their own columns: of equal texts the smallest id, one of rows that repeat it, or one row where all ids are null. Joined by digest and id, so copies of one text stay spread, and the rows travel once."""
    found = winners(docs, id_col, text_col, salts)
    groups = _by_digest(found)
    digest, kept = "__webloom_digest", "__webloom_keep"
    rows = docs.withColumn(digest, F.sha2(one_space(named(text_col)), 256))
    one = groups.where("n_texts = 1").select(F.col("digest").alias("__webloom_d"), F.col("keep_id").alias(kept))
    out = rows.join(one, (F.col(digest) == F.col("__webloom_d")) & (named(id_col) == F.col(kept)), "left_semi").dropDuplicates([digest, id_col])
    if not one.where(F.col(kept).isNull()).isEmpty():
        nameless = rows.where(named(id_col).isNull()).join(one.where(F.col(kept).isNull()), F.col(digest) == F.col("__webloom_d"), "left_semi")
        out = out.unionByName(nameless.dropDuplicates([digest]))
    shared = groups.where("n_texts > 1").select("digest")
    if not shared.isEmpty():
        several = found.join(shared, "digest").select(F.col("digest").alias("__webloom_d"), F.col("norm").alias("__webloom_n"), F.col("keep_id").alias(kept))
        norm = "__webloom_norm"
        rows = rows.withColumn(norm, one_space(named(text_col)))
        same = (F.col(digest) == F.col("__webloom_d")) & (F.col(norm) == F.col("__webloom_n")) & named(id_col).eqNullSafe(F.col(kept))
        out = out.unionByName(rows.join(several, same, "left_semi").dropDuplicates([digest, norm, id_col]).drop(norm))
    return out.drop(digest)
