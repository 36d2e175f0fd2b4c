"""Sessions for tests, benchmarks and small runs; a cluster brings its own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine. The checkpoint folder is a temporary one unless the session has its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quillspan")
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    checkpoint_folder(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder: spark.checkpoint.dir, or in one process a temporary one where it is unset."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))


def stored(df: DataFrame) -> DataFrame:
    """`df` written below the checkpoint folder and read again.

    Unlike a checkpoint, which keeps the estimates of the plan that it cuts, the files have sizes of their own; in a loop
    of joins those estimates would multiply each round.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{base.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows for each partition of what `dealt` deals out.
DEALT_ROWS = 200_000


def dealt(df: DataFrame, *keys: str, made_of: DataFrame | None = None) -> DataFrame:
    """`df` dealt by `keys` over partitions of about DEALT_ROWS rows of itself, or of what it was made of; these are counted, and should be cheap to read.

    For steps that make many rows of each: partitions sized by what was shuffled before would hold too many in one task.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, (made_of or df).count() // DEALT_ROWS + 1), *keys)
