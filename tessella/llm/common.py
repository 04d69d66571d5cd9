"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: The six white-space characters of the contracts: space, tab, LF, VT, FF, CR.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: One word, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where a local session names none (tests) a temporary folder is set; on a
    cluster such a folder would be another one on each machine, so that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


#: Tables that this process has made in the shared folder.
_MADE: list[str] = []


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that operators have made so far. Results that haven't been
    written elsewhere can't be read afterwards."""
    while _MADE:
        removed(spark, _MADE.pop())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed by clean_up or when the JVM ends."""
    path = f"{shared_dir(spark)}/tessella-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, and what is read afterwards survives the loss of executors."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows up to which a list of keys is broadcast (24 bytes each); beyond it, a shuffled join.
BROADCAST_KEYS = 1_000_000


def text_key(text):
    """Tells rows that repeat a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_key) is in ``keys``, a written table."""
    small = keys.count() <= BROADCAST_KEYS
    keys = keys.select(F.col("doc_id").alias("__drop_id"), F.col("text_key").alias("__drop_key")).distinct()
    met = docs["doc_id"].eqNullSafe(F.col("__drop_id")) & (text_key(docs["text"]) == F.col("__drop_key"))
    return docs.join(F.broadcast(keys) if small else keys, met, "left_anti")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each group. ``found`` is a written table of the rows that
    are in a group of several: doc_id, text_key, group, kept. Rows that aren't kept go;
    of several that are kept in a group (they repeat a doc_id), one stays."""
    rest = without(docs, found.filter("not kept"))
    many = found.filter("kept").groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not many.head(1):
        return rest
    keys = found.filter("kept").join(many, "group", "left_semi").select("doc_id", "text_key", F.col("group").alias("__group")).distinct()
    keys = written(keys.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_key", "__key"), "repeated")
    small = keys.count() <= BROADCAST_KEYS
    met = rest["doc_id"].eqNullSafe(F.col("__id")) & (text_key(rest["text"]) == F.col("__key"))
    marked = rest.join(F.broadcast(keys) if small else keys, met, "left")
    # a null group is no group: only rows of repeated ones are reduced
    one = marked.filter("__group is not null").dropDuplicates(["__group"])
    return marked.filter("__group is null").union(one).select(*docs.columns)


#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows where they are larger:
    texts can be long, and a batch is in memory several times on its way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def giving_back(run):
    """``run`` of mapInArrow, after which the worker hands memory that it no longer uses back to
    the machine: a worker waits for its next task with all that it has."""

    def whole(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def words(text):
    """Number of words of a text column, null counting as empty."""
    return F.size(F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * 6)), " +")) - F.when(
        F.trim(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * 6)) == "", 1
    ).otherwise(0)


def running_start(df: DataFrame, order: list[str], size: str, start: str, label: str) -> DataFrame:
    """Add ``start``: the sum of ``size`` over all rows before this one in the
    total order of ``order``.

    Rows are range-partitioned and written with the sum inside their partition;
    the totals, one row a partition, are then summed and added. No task sees
    more than its range, whatever the number of rows.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def local(batches):
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = b.column("_size").to_numpy(zero_copy_only=False).astype("int64")
            ends = sizes.cumsum() + total
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(ends - sizes), pa.array([part] * len(sizes), pa.int32())],
                names=[*b.schema.names, "_local", "_part"],
            )
            total = int(ends[-1]) if len(ends) else total

    spark = df.sparkSession
    cols = [F.col(c) for c in order]
    base = df.withColumn("_size", F.col(size).cast("long"))
    schema = StructType([*base.schema, StructField("_local", LongType()), StructField("_part", IntegerType())])
    spread = base.repartitionByRange(*cols).sortWithinPartitions(*cols)
    parts = written(spread.mapInArrow(local, schema), label)
    sums = parts.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    # one row for each partition of the write: bounded by the number of partitions
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(start, F.col("_local") + F.col("_before"))
        .drop("_size", "_local", "_part", "_before")
    )
