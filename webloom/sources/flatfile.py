"""Postings as sharded flat files (five escaped fields to a line), and state tables as JSON snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom import tables
from webloom.functions.text import decode_field, encode_field, shard

FIELDS = ("word", "url", "origin_url", "depth", "term_frequency")


def export_postings(index: DataFrame, path: str) -> DataFrame:
    """Writes one folder for each shard (shard=a to z and _misc), replacing what was there, so that emptied shards go. Counts for each shard: of the lines written, 0 for those that went. The counts are of the files, so the index is computed once."""
    spark = index.sparkSession
    before = [n.removeprefix("shard=") for n in tables.children(spark, path) if n.startswith("shard=")]
    text = [encode_field(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS[:3]]
    line = F.concat_ws("\t", *text, F.coalesce(F.col("depth"), F.lit(0)).cast("string"), F.col("term_frequency").cast("string"))
    lines = index.select(shard(F.col("word")).alias("shard"), line.alias("value"))
    lines.write.partitionBy("shard").mode("overwrite").text(path)
    now = {n.removeprefix("shard=") for n in tables.children(spark, path) if n.startswith("shard=")}
    gone = spark.createDataFrame([(n, 0) for n in before if n not in now], "shard string, records long")
    if not now:
        return gone
    return spark.read.schema("value string, shard string").text(path).groupBy("shard").agg(F.count(F.lit(1)).alias("records")).unionByName(gone)


def shard_counts(index: DataFrame) -> DataFrame:
    return index.groupBy(shard(F.col("word")).alias("shard")).agg(F.count(F.lit(1)).alias("records"))


def import_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings from such files: lines without exactly five fields, without word or url, or whose numbers are no numbers or below 1 are skipped; the last line of a word and url counts, in the order of files by name and of lines in them."""
    names = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    raw = spark.read.text(path).select("value", F.struct(names[0].alias("file"), names[1].alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    parts = F.split("value", "\t", -1)
    rows = raw.where(F.size(parts) == 5).select("at", *[decode_field(parts[i]).alias(c) for i, c in enumerate(FIELDS[:3])], F.expr("try_cast(split(value, '\\t', -1)[3] AS int)").alias("depth"), F.expr("try_cast(split(value, '\\t', -1)[4] AS bigint)").alias("term_frequency"))
    rows = rows.where("word <> '' and url <> '' and depth is not null and term_frequency > 0")
    last = rows.groupBy("word", "url").agg(F.max_by(F.struct("origin_url", "depth", "term_frequency"), "at").alias("p"))
    return last.select("word", "url", "p.*")


def save_snapshot(parts: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines under its name, as its next version: readers see a version when it is whole."""
    for name, df in parts.items():
        known = tables.committed(df.sparkSession, f"{path}/{name}", "version=")
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}/version={known[-1][0] + 1 if known else 0}")
        for _, old in known[:-1]:
            tables.drop(df.sparkSession, old)


def load_snapshot(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The newest whole version of each table, by its schema: missing ones are empty, unknown ones and unknown fields are left out, missing fields are null, damaged lines go."""
    out = {}
    for name, schema in schemas.items():
        known = tables.committed(spark, f"{path}/{name}", "version=")
        if not known:
            out[name] = spark.createDataFrame([], schema)
            continue
        marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        df = spark.read.schema(marked).option("mode", "PERMISSIVE").json(known[-1][1])
        out[name] = df.where(F.col("_corrupt_record").isNull()).select(*schema.names)
    return out
