"""Helpers that the corpus operators share: tables, durable cut points, words, salting."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between two of these is a word.
SPACES = " \t\n\x0b\x0c\r"

#: A dimension with at most this many rows may be broadcast; larger ones go through a salted join.
BROADCAST_ROWS = 20_000

#: Copies of each dimension row, and so the number of tasks over which a hot key is dealt.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`.

    Only where the session names none and runs in one process (tests) a temporary one is set.
    """
    here = spark.conf.get("spark.checkpoint.dir", None)
    if here:
        return here.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder name of its own below the shared one, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that `new_folder` named and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_store(folder: str):
    """The file system of a folder that `new_folder` named, for tasks that write files, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def settle(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of steps whose results are stored."""
    gc.collect()
    spark._jvm.System.gc()


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    """Number of words of `text`, without building an array of them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column has, for the names of working columns."""
    prefix = "_w"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_w"
    return prefix + "_"


def let(value: Column, body) -> Column:
    """`body` of one value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_dimension(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", spread: Column | None = None, rows: int | None = None) -> DataFrame:
    """`facts` joined to the settled `dim` on null-safe `keys`.

    The dimension is counted; up to BROADCAST_ROWS it is broadcast, beyond that each of its rows is
    copied SALTS times and the facts are dealt by key and salt, so that a key with a third of all
    facts still spreads over SALTS tasks. `spread` is what the salt of a fact is drawn from.
    """
    named = [F.col(k).alias(f"_d_{k}") for k in keys]
    dim = dim.select(*named, *[c for c in dim.columns if c not in keys])
    same = [facts[k].eqNullSafe(dim[f"_d_{k}"]) for k in keys]
    if (dim.count() if rows is None else rows) <= BROADCAST_ROWS:
        out = facts.join(F.broadcast(dim), _all(same), how)
        return out.drop(*[f"_d_{k}" for k in keys])
    facts = facts.withColumn("_salt", F.pmod(F.xxhash64(spread if spread is not None else F.lit(0)), F.lit(SALTS)))
    dim = dim.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = [facts[k].eqNullSafe(dim[f"_d_{k}"]) for k in keys]
    out = facts.join(dim, _all(same) & (facts["_salt"] == dim["_dim_salt"]), how)
    return out.drop("_salt", "_dim_salt", *[f"_d_{k}" for k in keys])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
