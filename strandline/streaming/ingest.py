"""Incremental ingest of new files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def ingest_new_files(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], pattern: str = "*") -> StreamingQuery:
    """Hand each batch of files that appeared under ``root`` to ``handle`` (path, size, modified_at, content), then stop.

    A file stream tells neither of deletions nor of changes in place; those come from
    ``operators.changes``. ``handle`` may see a batch again after a failure, so it upserts.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"), "content")
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
