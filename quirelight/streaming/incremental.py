"""Incremental runs with Structured Streaming: each file, text or document is processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelight.sources.files import exists


def new_texts(spark: SparkSession, root: str, pattern: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """A stream of ``(path, value)`` of files as they arrive; empty texts are skipped. The checkpoint is the log of what was seen."""
    texts = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).option("wholetext", True).text(root)
    return texts.select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("value").rlike(r"\S"))


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process all that is there and stop."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def append_unseen(batch: DataFrame, target: str, key: str) -> None:
    """Add a batch's rows whose key isn't in the target yet, once each; a batch that is tried again adds nothing twice."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    if exists(spark, target):
        rows = rows.join(spark.read.parquet(target).select(key), key, "left_anti")  # of the target only the keys are read
    rows.write.mode("append").parquet(target)


def first_of_each(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Rows whose key didn't occur within the given time; late rows beyond the watermark are dropped, and so is their state."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts in windows of event time; windows close when the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def recompute(spark: SparkSession, source: str, target: str, pipeline: Callable[[DataFrame], DataFrame]) -> None:
    """The whole result again, in place of the old."""
    pipeline(spark.read.parquet(source)).write.mode("overwrite").parquet(target)
