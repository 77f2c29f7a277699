"""The folder that driver and executors share, and tables kept there, so that later steps neither compute them again nor need their executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may go without and gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = getattr(spark, "_inkwell_shared", None) or tempfile.mkdtemp(prefix="inkwell-")
        spark._inkwell_shared = where
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a file of few row groups would be read, and all that follows done, by few tasks. Larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().executedPlan().execute().getNumPartitions() < cores else df


@contextmanager
def cleared(spark: SparkSession):
    """Shuffles of what is written meanwhile are deleted once it is written, not whenever the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, written as a table in the shared folder and read from there from then on."""
    path = f"{shared_dir(df.sparkSession)}/inkwell-{uuid.uuid4().hex}"
    with cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table that kept() wrote for df."""
    spark = df.sparkSession
    for name in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, unless the session sets a size of its own: texts are long, and a task holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(8 << 20))
