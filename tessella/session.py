"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; only where it
    names none, on a single machine, set a temporary one."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-checkpoint-"))


@contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles goes when it ends; else it stays until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the folder that driver and executors share, read back: cuts
    the lineage as a checkpoint does, in a fraction of its space. It goes by ``dropped``, or when the JVM ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()
    name = f"{top.rstrip('/')}/tessella-{uuid.uuid4().hex}"
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    with _without_old_shuffles(spark):
        df.write.option("compression", "zstd").parquet(name)
    out = spark.read.schema(df.schema).parquet(name)
    out._saved_at = name
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``saved`` has made; what reads them can't be worked out afterwards."""
    for df in tables:
        path, files = _path(df.sparkSession, df._saved_at)
        files.delete(path, True)
