"""Shared helpers: shared-folder checkpoints, ASCII lower-casing, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: White space as every contract here means it.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest table, in rows, that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


#: Paths written by cut() since the innermost finished() of this thread began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir. Only a local session may go without and gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = getattr(spark, "_inkwell_shared", None) or tempfile.mkdtemp(prefix="inkwell-")
        spark._inkwell_shared = where
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back, so later stages neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (own := _written.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of make(), written out; every other table that it wrote is deleted, also when it fails. Threads do not see each other's tables."""
    inner: list[str] = []
    outer = _written.set(inner)
    try:
        df = make()
    except BaseException:
        _written.reset(outer)
        _delete_all(SparkSession.getActiveSession(), inner)
        raise
    _written.reset(outer)
    try:
        return cut(df)  # belongs to the finished() around this one, if there is one
    finally:
        _delete_all(df.sparkSession, inner)


def _delete_all(spark: SparkSession | None, paths: list[str]) -> None:
    for path in paths if spark else ():
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove(df: DataFrame) -> None:
    """Delete what cut() wrote for df."""
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, unless the session sets a size of its own: texts are long, and a task holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(8 << 20))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it has at most BROADCAST_ROWS rows; rows is its measured count."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Maximal runs of characters outside SPACE; null gives none."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x09-\\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df with _p, its place in a range partitioning by order: rows of a lower _p come before those of a higher one. Written out, so that _p stays."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df (with _p, see in_order) with running sums up to each row, in order: sums within a part, and those of the parts before it. Only one row a part meets in one task."""
    own = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy("_p").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    parts = cut(parts.select("_p", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums]))
    out = df.join(F.broadcast(parts), "_p")
    return out.select(*df.columns, *[(F.sum(c).over(own) + F.col(f"_{k}")).alias(k) for k, c in sums.items()])
