"""The inverted index as a table of postings: word, url, origin_url, depth, term_frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import tables
from webloom.functions.text import fold, sanitize, shard, tokens, word_key

KEY = ("word", "url")
SCHEMA = "word string, url string, origin_url string, depth int, term_frequency long"


def first_origin(order: Column | None = None) -> Column:
    """The first origin that is not empty (by `order`, else the least), or the empty text."""
    full = F.when(F.coalesce(F.col("origin_url"), F.lit("")) != "", F.col("origin_url"))
    got = F.min(full) if order is None else F.min_by(full, F.when(full.isNotNull(), order))
    return F.coalesce(got, F.lit(""))


def postings(corpus: DataFrame) -> DataFrame:
    """Postings of corpus(url, text, origin_url, depth): one insert for each token. Counting starts before the shuffle."""
    rows = corpus.where("url <> ''").select(F.explode(tokens(F.col("text"))).alias("word"), "url", "origin_url", F.coalesce(F.col("depth").cast("int"), F.lit(0)).alias("depth"))
    return rows.groupBy(*KEY).agg(first_origin().alias("origin_url"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("term_frequency"))


def postings_of(*corpora: DataFrame) -> DataFrame:
    """merge() of the postings of each corpus, counted at once: one shuffle."""
    rows = None
    for i, c in enumerate(corpora):
        c = c.where("url <> ''").select(F.explode(tokens(F.col("text"))).alias("word"), "url", "origin_url", F.coalesce(F.col("depth").cast("int"), F.lit(0)).alias("depth"), F.lit(i).alias("part"))
        rows = c if rows is None else rows.unionByName(c)
    return rows.groupBy(*KEY).agg(first_origin(F.struct("part", "origin_url")).alias("origin_url"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("term_frequency"))


def merge(*parts: DataFrame) -> DataFrame:
    """Postings added up: frequencies add, the least depth stays, as does the first origin that is not empty (by the order of parts)."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select(*KEY, "origin_url", "depth", "term_frequency", F.lit(i).alias("part"))
        rows = p if rows is None else rows.unionByName(p)
    return rows.groupBy(*KEY).agg(first_origin(F.struct("part", "origin_url")).alias("origin_url"), F.min("depth").alias("depth"), F.sum("term_frequency").alias("term_frequency"))


def bulk_upsert(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The last posting given for each word and url, without adding up; a missing frequency counts 1."""
    rows = rows.withColumn("word", word_key(F.col("word"))).where("word <> '' and url <> ''")
    last = F.max_by(F.struct(F.coalesce("origin_url", F.lit("")).alias("origin_url"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("term_frequency", F.lit(1)).cast("long").alias("term_frequency")), order)
    return rows.groupBy(*KEY).agg(last.alias("p")).select(*KEY, "p.*")


def exact(index: DataFrame, word: str) -> DataFrame:
    """Postings of one word. The literal is folded on the driver's plan, so the filter reaches the scan."""
    return index.where(F.col("word") == word_key(F.lit(word)))


def prefix(index: DataFrame, word: str) -> DataFrame:
    """Postings of all words with this prefix, added up by url. The filter reaches the scan of a stored index."""
    found = index.where(F.col("word").startswith(word_key(F.lit(word))) & (word_key(F.lit(word)) != ""))
    return found.groupBy("url").agg(F.sum("term_frequency").alias("term_frequency"), F.min("depth").alias("depth"), first_origin(F.struct("word", "origin_url")).alias("origin_url"))


def lookup(index: DataFrame, word: str, exact_only: bool | None = None, prefix_too: bool = False) -> DataFrame:
    """exact_only, where given, decides over prefix_too."""
    by_prefix = prefix_too if exact_only is None else not exact_only
    return prefix(index, word) if by_prefix else exact(index, word).select("url", "term_frequency", "depth", "origin_url")


def contains(index: DataFrame, words: DataFrame) -> DataFrame:
    """words(word) with `found`."""
    known = index.select(F.col("word").alias("known")).distinct()
    w = words.withColumn("key", word_key(F.col("word")))
    return w.join(known, F.col("key") == F.col("known"), "left").select("word", F.col("known").isNotNull().alias("found"))


def starts_with(index: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes(prefix) with `found`: an equi-join on the prefix of each length asked for, not a comparison of all with all."""
    asked = prefixes.withColumn("key", word_key(F.col("prefix"))).withColumn("n", F.length("key"))
    words, sizes = index.select("word").distinct(), asked.select(F.col("n").alias("size")).distinct()
    begins = words.join(F.broadcast(sizes), F.length("word") >= F.col("size")).select(F.expr("substring(word, 1, size)").alias("begin")).distinct()
    return asked.join(begins, F.col("key") == F.col("begin"), "left").select("prefix", (F.col("begin").isNotNull() & (F.col("key") != "")).alias("found"))


def vocabulary_size(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("word").alias("words"))


def node_count(index: DataFrame) -> DataFrame:
    """Nodes of a trie of the words: distinct prefixes and the root."""
    words = index.select("word").distinct()
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.col("word").substr(F.lit(1), n))).alias("p"))
    return prefixes.distinct().agg((F.count(F.lit(1)) + 1).alias("nodes"))


def purge_origin(index: DataFrame, origin: str) -> tuple[DataFrame, DataFrame]:
    """What stays, and a row of postings_removed, words_unindexed (words left without postings) and postings_left: one count for each word, then their sums."""
    gone = F.coalesce("origin_url", F.lit("")) == origin
    words = index.groupBy("word").agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("left"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return index.where(~gone), words.agg(total("gone").alias("postings_removed"), F.count_if((F.col("left") == 0) & (F.col("gone") > 0)).alias("words_unindexed"), total("left").alias("postings_left"))


def store(index: DataFrame, path: str) -> None:
    """The index as a table to look words up in: a folder for each shard, files by ranges of words and sorted by word, so that a lookup reads the row groups that may hold its words, and nothing else."""
    by = ["shard", "word", "url"]
    rows = index.select("*", shard(F.col("word")).alias("shard"))
    tables.write(rows.repartitionByRange(*by).sortWithinPartitions(*by), path, "shard")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The postings of a stored index, with their shard."""
    return spark.read.schema(SCHEMA + ", shard string").parquet(path)


def only(index: DataFrame, words: list[str]) -> DataFrame:
    """Postings of these words, folded ones: of a stored index only their shards and row groups are read, of any other only their rows go on to be counted."""
    found = index.where(F.col("word").isin(words)) if words else index.limit(0)
    if "shard" in index.columns:
        found = found.where(F.col("shard").isin(sorted({w[0] if "a" <= w[0] <= "z" else "_misc" for w in words}))) if words else found
        found = found.drop("shard")
    return found


def clear(index: DataFrame) -> DataFrame:
    """The empty index."""
    return index.limit(0)


def walk(index: DataFrame) -> DataFrame:
    """All postings, word by word, in the order in which a stack gives a tree's words: descending; those of a word by url."""
    return index.orderBy(F.col("word").desc(), "url")


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by partial aggregates, so that a key of any number of rows is no group in a task."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, order).alias("r")).select(*[F.col("r")[c].alias(c) for c in rows.columns])


def upsert_metadata(stored_rows: DataFrame, rows: DataFrame, order: str = "ts") -> DataFrame:
    """Page metadata by url, the last one written of each; title and snippet are cleaned again."""
    new = rows.withColumns({c: sanitize(F.col(c)) for c in ("title", "snippet")})
    return last_written(stored_rows.unionByName(new, allowMissingColumns=True).where("url <> ''"), "url", order)


__all__ = ["bulk_upsert", "clear", "contains", "exact", "fold", "last_written", "lookup", "merge", "node_count", "only", "postings", "prefix", "purge_origin", "starts_with", "store", "stored", "upsert_metadata", "vocabulary_size", "walk"]
