"""Cutting lineage between the rounds of iterative operators, and tables that are written once and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that all executors share; a folder of our own only where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="wicker-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


#: Drops an execution's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_clean(df: DataFrame, folder: str) -> None:
    """df as Parquet in the folder; the shuffle files that it took are dropped at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the shared folder, so that its real size is known to what reads it."""
    folder = f"{shared_root(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    write_clean(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_written: dict[tuple, str] = {}


def stamps(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, length and time of change of every file of the paths: what tells whether something made from them still holds."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return tuple(out)


def written_once(spark: SparkSession, name: str, paths: list[str], build: Callable[[str], None]) -> str:
    """The shared folder that ``build`` has written, made once in an application for as long as the files of the paths stay as they are."""
    key = (spark.sparkContext.applicationId, name, stamps(spark, paths))
    if key not in _written:
        folder = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        build(folder)
        _written[key] = folder
    return _written[key]


#: Keys of a block and blocks of a block of blocks, in prefix sums.
BLOCK = 4096


def prefix_sums(rows: DataFrame, key: str, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """rows with, as ``out``, the sum of ``value`` over the rows with smaller keys (of the same ``by``); keys are distinct.

    Integer keys are summed inside blocks, blocks inside blocks of blocks, and these over all, so that no task sees more
    than its own: the last level has a row for 16 million keys. Other keys are sorted as they are, group by group.
    """
    by = by or []
    if dict(rows.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn(out, F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = lambda c, part, order: F.coalesce(F.sum(c).over(W.partitionBy(*by, *part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fine = rows.withColumn("__b", F.floor(F.col(key) / BLOCK)).withColumn("__i", before(value, ["__b"], key))
    blocks = rows.withColumn("__b", F.floor(F.col(key) / BLOCK)).groupBy(*by, "__b").agg(F.sum(value).alias("__t")).withColumn("__c", F.floor(F.col("__b") / BLOCK))
    coarse = blocks.groupBy(*by, "__c").agg(F.sum("__t").alias("__u")).withColumn("__k", before("__u", [], "__c")).drop("__u")
    blocks = blocks.withColumn("__j", before("__t", ["__c"], "__b")).drop("__t")
    base = same(blocks, coarse, [*by, "__c"]).select(*by, "__b", (F.col("__j") + F.col("__k")).alias("__base"))
    return same(fine, base, [*by, "__b"]).withColumn(out, F.col("__base") + F.col("__i")).drop("__b", "__i", "__base")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with equal keys, nulls included."""
    other = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = one if on is None else on & one
    return a.join(other, on).drop(*(f"_r_{k}" for k in keys))
