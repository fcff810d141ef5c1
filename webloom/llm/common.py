"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text handed to one step of a Python worker at a time, in bytes: bounds its memory however long a batch is.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="webloom-")
        sc.setCheckpointDir(folder)
    return folder


#: Whether Spark removes the shuffle files of a query once that is done.
TIDY_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """df, computed once and read back from a table in the shared folder: survives lost executors and ends the lineage. What was shuffled for it goes when the table is written. few: for small rows after a shuffle, not one small file for each partition but for eight."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/webloom-{uuid.uuid4().hex}"
    if few:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    before = spark.conf.get(TIDY_SHUFFLES, "false")
    spark.conf.set(TIDY_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._webloom_table = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the tables that cut() wrote for these, which nothing may read any more: all that came from them has been cut itself."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._webloom_table)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows, as texts are long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def tidy(run):
    """run, a function from batches to batches, with the memory it freed handed back to the system at a task's end: workers wait for the next task beside the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                import ctypes

                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def sums_before(rows: DataFrame, group: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """rows with, for each value: name of values, `name`: the sum of value over the rows of the same group (of all, if none is named) that come before in order, which is unique in a group. Rows are dealt out by ranges of group and order, so that a group of any size is many tasks' work: each task sums its own range, and a row for each task that a group reaches into carries the sums on."""
    part = "__webloom_part"
    dealt = cut(rows.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    above = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, part).agg(*[F.sum(v).alias(n) for v, n in values.items()])
    sums = sums.select(*[F.col(g).alias(f"__webloom_{g}") for g in group], F.col(part).alias("__webloom_at"), *[F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"__webloom_of_{n}") for n in values.values()])
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for v, n in values.items()])
    same = F.col(part) == F.col("__webloom_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__webloom_{g}"))
    return within.join(sums, same).select(*rows.columns, *[(F.col(n) + F.col(f"__webloom_of_{n}")).alias(n) for n in values.values()])


#: Classes of ids that a prefilter tells apart; so many rows of one long are the most it broadcasts.
CLASSES = 1 << 20


def maybe_in(df: DataFrame, key: Column, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose key may be among ids (a table of one column), or with left_anti those whose key certainly isn't: by a class of its hash, of which there are CLASSES, so the other side of this broadcast has a bound. What is left to be compared exactly is then a few rows more than needed, or, beyond millions of ids, as many as before."""
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(CLASSES)).alias("__webloom_class")
    classes = ids.select(of(F.col(ids.columns[0]))).distinct()
    return df.join(F.broadcast(classes), F.pmod(F.xxhash64(key), F.lit(CLASSES)) == F.col("__webloom_class"), how)


def named(c: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + c.replace("`", "``") + "`")


def one_space(c: Column) -> Column:
    r"""c with every run of [\x20\x09-\x0D] as one space; null as the empty text. Regular expressions run only where runs are longer than 1."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for x in "\t\n\x0b\x0c\r":
        c = F.replace(c, F.lit(x), F.lit(" "))
    return F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(c)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first, after) row ranges of at most `limit` bytes of text, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j
