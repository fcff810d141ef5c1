"""A training corpus from documents: quality filter, exact dedup, near-dedup, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents. Documents that are mixed in more than once come as that many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import exact_dedup, mixing, pieces, quality, simhash
from webloom.llm.common import cut, read_table
from webloom.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; the classifier is fitted on these documents and their labels."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    return quality.score(docs, model, keep=rest).where("score >= 0.5").select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact_dedup.distinct_rows(docs).select(*COLUMNS)


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs, words=5, similarity=0.8).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix comes to them, in the order of its schedule; what it takes of a source's last document in part comes whole."""
    return mixing.scheduled(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return pieces.digests(docs, tokenizer_file("piece_bpe_32k.model"), slice_bytes=1 << 20, keep_words=False)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("simhash near-dedup", near_distinct),
    ("source mixing", mixed),
    ("sentencepiece encoding", encoded),
]

#: A fitted classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
