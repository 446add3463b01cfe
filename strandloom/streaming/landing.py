"""Structures as they land in a folder, parsed batch by batch; a structure is one file, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.structures import lines


def landing_lines(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Streaming structure_id, line_no, line of files that appear in ``path``."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_at_once).schema("value string").load(path)
    return lines(files.select(F.col("_metadata.file_path").alias("structure_id"), F.col("value").alias("text")))


def ingest(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give each batch of lines to ``handle``; batches that are done are not read again after a restart."""
    return landing_lines(spark, path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
