"""Answers of earlier runs, kept by digest in a folder and brought up to date by each run.

The folder is a Parquet table with a partition for each shard of digests. An update writes only the
shards that it touches, whole, in place of what they held (dynamic partition overwrite): repeating it
changes nothing, and an update that is cut off leaves the shards that it did not reach as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.review import shard
from quillspan.session import stored

#: The form of the rows; rows of another form are not read.
FORMAT = 1
SCHEMA = "format int, digest string, probability double, shard string"


def sound(probability: Column) -> Column:
    return F.coalesce(probability.between(0, 1) & ~F.isnan(probability), F.lit(False))


@dataclass(frozen=True)
class AnswerStore:
    """Answers below `folder`; with `refresh` nothing that it holds counts as known, and all is written anew."""

    spark: SparkSession
    folder: str
    refresh: bool = False

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self) -> DataFrame:
        if not self._there():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def known(self) -> DataFrame:
        """(digest, probability) of sound answers, one for each digest."""
        rows = self.rows().where((F.col("format") == FORMAT) & sound(F.col("probability")) & F.col("digest").rlike("^[0-9a-f]{64}$"))
        rows = rows.where("false") if self.refresh else rows
        return rows.groupBy("digest").agg(F.min("probability").alias("probability"))

    def update(self, answers: DataFrame) -> None:
        """Takes in answers (digest, probability): new ones replace old ones and rows that cannot be read; those that are not sound are not kept."""
        new = answers.where(sound(F.col("probability"))).groupBy("digest").agg(F.min("probability").alias("probability"))
        new = new.withColumn("shard", shard(F.col("digest")))
        touched = new.select("shard").distinct()
        old = self.rows().where((F.col("format") == FORMAT) & sound(F.col("probability"))).join(touched, "shard", "left_semi").join(new.select("digest"), "digest", "left_anti")
        whole = new.unionByName(old.select("digest", "probability", "shard")).select(F.lit(FORMAT).alias("format"), "digest", "probability", "shard")
        # stored first, as the folder is both read and written; all rows of a shard meet in one file
        stored(whole).repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.folder)


def state_of(probability: Column, error: Column) -> Column:
    """What became of a question: answered, invalid (no number from 0 to 1) or failed, with its error."""
    return F.when(error.isNotNull(), F.struct(F.lit("failed").alias("state"), error.alias("error"))).when(sound(probability), F.struct(F.lit("answered").alias("state"), F.lit(None).cast("string").alias("error"))).otherwise(
        F.struct(F.lit("invalid").alias("state"), F.lit("missing or invalid answer").alias("error"))
    )
