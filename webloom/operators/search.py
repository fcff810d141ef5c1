"""Ranked free-text search over postings."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import tokens
from webloom.operators.index import first_origin, only

PER_HIT, PER_LEVEL, BASE = 10, 5, 1000
MOST_ROWS, MOST_OFFSET = 100, 100_000


def score(frequency: Column, depth: Column) -> Column:
    """More hits and less depth rank higher, in whole numbers."""
    return PER_HIT * frequency + BASE - PER_LEVEL * depth


def clamp(value: object, default: int) -> int:
    try:
        return max(0, int(value))
    except (TypeError, ValueError):
        return default


def query_tokens(spark: SparkSession, query: str | None) -> list[str]:
    """The tokens of a query, in order, repeats included, as the index holds them: one row, computed before the search is planned, so that its words are literals in the plan."""
    return spark.range(1).select(tokens(F.lit(query or "")).alias("t")).first()["t"]


def hits(index: DataFrame, query: str) -> DataFrame:
    """One row for each url that holds any of the query's tokens: frequency, depth, origin_url. A token that the query repeats counts again. Only the query's words are read, counted and moved; its few tokens are broadcast."""
    words = query_tokens(index.sparkSession, query)
    rows = [(t, at) for at, t in enumerate(words)]
    asked = index.sparkSession.createDataFrame(rows, "token string, at int")
    found = only(index, sorted(set(words))).join(F.broadcast(asked), F.col("word") == F.col("token"))
    return found.groupBy("url").agg(F.sum("term_frequency").alias("frequency"), F.min("depth").alias("depth"), first_origin(F.struct("at", "origin_url")).alias("origin_url"))


def rank(found: DataFrame) -> DataFrame:
    """Scored rows in a total order: score, depth, url."""
    rows = found.where("url <> ''").withColumn("relevance_score", score(F.col("frequency"), F.col("depth")))
    return rows.orderBy(F.col("relevance_score").desc(), "depth", "url")


def total(index: DataFrame, query: str) -> DataFrame:
    return hits(index, query).where("url <> ''").agg(F.count(F.lit(1)).alias("total"))


def page(index: DataFrame, query: str, limit: object = 10, offset: object = 0) -> DataFrame:
    """One page of ranked rows; the limit reaches the sort as a top-k."""
    return rank(hits(index, query)).offset(clamp(offset, 0)).limit(clamp(limit, 10))


def hydrate(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """title and snippet of a page of rows, after the limit: the page's few rows are what is broadcast, and metadata is narrowed to their urls before its own columns are computed."""
    few = metadata.join(F.broadcast(rows.select(F.col("url").alias("__url"))), F.col("url") == F.col("__url"), "left_semi")
    meta = few.select(F.col("url").alias("u"), "title", "snippet")
    return meta.join(F.broadcast(rows), F.col("u") == F.col("url"), "right").drop("u").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "snippet")})


@dataclass
class Result:
    rows: DataFrame
    total: DataFrame


def search(index: DataFrame, metadata: DataFrame, query: str, limit: int = 10, offset: int = 0) -> Result:
    """The public search: bounds are checked, rows come hydrated and in order."""
    if not 0 <= limit <= MOST_ROWS or not 0 <= offset <= MOST_OFFSET:
        raise ValueError(f"limit must be 0 to {MOST_ROWS}, offset 0 to {MOST_OFFSET}")
    rows = hydrate(page(index, query.strip(), limit, offset), metadata)
    return Result(rows.orderBy(F.col("relevance_score").desc(), "depth", "url"), total(index, query.strip()))


def answer(index: DataFrame, metadata: DataFrame, query: str | None, limit: int = 10, offset: int = 0) -> dict:
    """What a search service replies: query, results (a page's rows as dicts), limit, offset, count (of this page), total, elapsed_ms; an empty query gives no results and no elapsed_ms."""
    text = (query or "").strip()
    reply = {"query": text, "results": [], "limit": limit, "offset": offset, "count": 0, "total": 0}
    began = time.time()
    found = search(index, metadata, text, limit, offset)  # checks the bounds
    if not text:
        return reply
    rows = [r.asDict() for r in found.rows.collect()]  # at most MOST_ROWS
    return reply | {"results": rows, "count": len(rows), "total": found.total.first()["total"], "elapsed_ms": int((time.time() - began) * 1000)}


def page_math(rows: DataFrame) -> DataFrame:
    """rows(total, limit, offset, shown) with page, pages, first, last and has_next."""
    size = F.greatest(F.lit(1), F.col("limit"))
    return rows.withColumns({
        "page": (F.floor(F.col("offset") / size) + 1).cast("long"),
        "pages": F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"),
        "first": F.when(F.col("shown") > 0, F.col("offset") + 1).otherwise(0).cast("long"),
        "last": (F.col("offset") + F.col("shown")).cast("long"),
        "has_next": F.col("offset") + F.col("shown") < F.col("total"),
    })
