"""Streaming ingest of blobs (an extension): new files in a folder go to the store once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import sha1_base32
from ..operators.store import store


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(rows: DataFrame, path: str, checkpoint: str, content: str = "content") -> StreamingQuery:
    """Append the blobs of a stream that the store at ``path`` lacks. A batch that is
    run again after a failure finds its blobs there and adds nothing."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: store(batch, path, content) and None)
        .trigger(availableNow=True)
        .start()
    )


def arrivals(rows: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes", content: str = "content") -> DataFrame:
    """Blobs and bytes that arrive in each window of event time; rows later than ``late`` are left out."""
    timed = rows.withWatermark(time, late).withColumn("_size", F.octet_length(content)).withColumn("_name", sha1_base32(F.col(content)))
    return timed.groupBy(F.window(time, window)).agg(
        F.count(F.lit(1)).alias("blobs"), F.sum("_size").alias("bytes"), F.approx_count_distinct("_name").alias("distinct_blobs")
    )
