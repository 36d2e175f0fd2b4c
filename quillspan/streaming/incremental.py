"""Incremental review: files arrive as a stream, each content is judged once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.operators.pattern_rules import pattern_evidence, span_texts
from quillspan.operators.spans import candidates

FILE_SCHEMA = "file_path string, source string, seen timestamp"


def file_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """New files of a folder of Parquet (FILE_SCHEMA), each (path, content) once within the watermark."""
    rows = spark.readStream.schema(FILE_SCHEMA).parquet(folder).withColumn("digest", F.sha2(F.concat_ws("\n", "file_path", "source"), 256))
    return rows.withWatermark("seen", late).dropDuplicatesWithinWatermark(["digest"])


def review_batch(files: DataFrame) -> DataFrame:
    """Evidence of the pattern rules for a batch of files."""
    return pattern_evidence(span_texts(files, candidates(files)))


def start(files: DataFrame, folder: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame] = review_batch, once: bool = False) -> StreamingQuery:
    """Writes what `judge` finds in each batch below `folder`, by batch number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        judge(batch.select("file_path", "source").dropDuplicates(["file_path"])).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def rule_counts(evidence: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Findings of each rule by event-time window (evidence: rule_id, seen)."""
    return evidence.withWatermark("seen", late).groupBy(F.window("seen", window), "rule_id").agg(F.count("*").alias("n"))


__all__ = ["FILE_SCHEMA", "file_stream", "review_batch", "rule_counts", "start"]
