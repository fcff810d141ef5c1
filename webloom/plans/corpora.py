"""Tables as corpora (url, text, origin_url, depth), and as logs, jobs and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.urls import normalize_url, origin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url (canonical), origin_url, depth (path segments), html."""
    u = normalize_url(F.col("url"))
    path = F.regexp_extract(u, r"^[^:]+://[^/]*([^?]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("url"), origin(F.col("url")).alias("origin_url"), depth.alias("depth"), "html")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.parsed(page_rows(spark, sf_dir)).select("url", "text", "origin_url", "depth")


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.parsed(page_rows(spark, sf_dir))
    return rows.select("url", "title", "snippet", "depth", F.col("origin_url").alias("origin"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat(F.lit("doc://"), F.col("source"))
    return table(spark, sf_dir, "documents").select(F.concat(place, F.lit("/"), F.col("doc_id").cast("string")).alias("url"), "text", place.alias("origin_url"), (F.col("doc_id") % 4).cast("int").alias("depth"), "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat(F.lit("conv://"), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").select(F.concat(place, F.lit("/"), F.col("turn").cast("string")).alias("url"), "text", place.alias("origin_url"), F.col("turn").cast("int").alias("depth"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with `at`, the seconds since 1970."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").withColumn("at", seconds)


def supplier_part_edges(spark: SparkSession, sf_dir: str, sources: DataFrame | None = None) -> DataFrame:
    """A graph of suppliers and parts that occur on one line, both ways; with sources(node), its edges from these."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    if sources is None:
        lines = lines.distinct()
        return lines.unionByName(lines.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = lines.unionByName(lines.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.join(sources, F.col("src") == F.col("node"), "left_semi").distinct()
