"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before kept. All but the last return the columns of
`documents`; the last returns doc_id, n_tokens and the digests of the ids and of the text decoded
from them, one row for each copy that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.bpe import default_tokenizer, round_trip
from quillspan.llm.common import new_folder, table
from quillspan.llm.jaccard_join import keep_one_of_each
from quillspan.llm.mixing import take_copies
from quillspan.llm.quality_rules import keep_good
from quillspan.llm.substring_dedup import cut

#: Near copies share word n-grams of this length, and this part of them in percent. op5's contract has its own.
NEAR_NGRAM, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, of each group of near copies; rows with a null doc_id count among the copies."""
    return keep_one_of_each(docs, NEAR_NGRAM, NEAR_PERCENT)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that occur more than once."""
    return cut(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return take_copies(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row."""
    return round_trip(docs, default_tokenizer())


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_copies_stage),
    ("suffix-array dedup", passages_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding and decoding", tokens_stage),
]

#: Dependent rounding and byte-pair merges have no SQL form; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
