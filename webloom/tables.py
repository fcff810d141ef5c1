"""Tables in the folder that the cluster shares: cut off from their lineage, or published as versions that readers see whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whether Spark removes the shuffle files of a query once that is done.
TIDY_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="webloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/webloom-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *partitions: str) -> None:
    """df as Parquet; what was shuffled for it goes when it is written."""
    spark = df.sparkSession
    before = spark.conf.get(TIDY_SHUFFLES, "false")
    spark.conf.set(TIDY_SHUFFLES, "true")
    try:
        (df.write.partitionBy(*partitions) if partitions else df.write).mode("overwrite").parquet(path)
    finally:
        spark.conf.set(TIDY_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a table in the shared folder, which ends its lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._webloom_table = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the tables of cut(), which nothing reads any more."""
    for df in tables:
        drop(df.sparkSession, df._webloom_table)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 0, in an order that is unique: dealt out by ranges, numbered in each, and moved on by what stands in the ranges before, so that no task has all rows."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sizes = sizes.select(F.col("__part").alias("__at"), before.alias("__before"))
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(sizes), F.col("__part") == F.col("__at")).withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    fs, p = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, p = _path(spark, path)
    fs.create(p, True).close()


def committed(spark: SparkSession, path: str, prefix: str) -> list[tuple[int, str]]:
    """number and path of the folders `prefix`N that a writer has finished, in order: the job's marker comes last, so readers see whole versions only."""
    found = [(int(n.removeprefix(prefix)), f"{path}/{n}") for n in children(spark, path) if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]
    return sorted((n, p) for n, p in found if exists(spark, f"{p}/_SUCCESS"))


def publish(df: DataFrame, path: str) -> int:
    """df as the next version of a table; versions before the one that it replaces go, so that who reads that one may end."""
    spark = df.sparkSession
    known = committed(spark, path, "version=")
    n = known[-1][0] + 1 if known else 0
    write(df, f"{path}/version={n}")
    for _, old in known[:-1]:
        drop(spark, old)
    return n


def latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest whole version of a table; empty if there is none."""
    known = committed(spark, path, "version=")
    return spark.read.schema(schema).parquet(known[-1][1]) if known else spark.createDataFrame([], schema)
