"""The review itself: rules meet candidates, questions are batched, cached and asked, answers ranked and reported."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.session import checkpoint_folder

#: Limits of one request and of a report.
MOST_QUESTIONS, MOST_CHARACTERS = 24, 48_000
MOST_FAILURE_TEXT, SHOWN, SHOWN_FAILURES = 500, 5, 20
#: The order in which kinds are asked.
KIND_ORDER = ("module", "abstraction", "function", "comment")


def merge_rules(defaults: DataFrame, custom: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules of a run: defaults and custom ones, without those turned off, with overridden fields.

    `overrides` has rule_id, off and nullable scope, category, message. Without any category it is maintainability.
    """
    base = defaults.unionByName(custom)
    off = overrides.where("off").select("rule_id")
    o = overrides.where("not off").select("rule_id", *[F.col(c).alias(f"_{c}") for c in ("scope", "category", "message")])
    merged = base.join(off, "rule_id", "left_anti").join(o, "rule_id", "left")
    fields = {c: F.coalesce(f"_{c}", c) for c in ("scope", "message")} | {"category": F.coalesce("_category", "category", F.lit("maintainability"))}
    return merged.withColumns(fields).select("rule_id", "scope", "category", "message")


def questions(candidates: DataFrame, rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates with each rule of their kind and what its evidence came to: question, abstention or failure.

    `rules` is a bounded table (rule_id, scope, handled), so that it is broadcast; `evidence` has id, rule_id,
    evidence and error. A handled rule without evidence abstains; an unhandled one is asked without.
    """
    met = candidates.join(F.broadcast(rules), candidates["kind"] == rules["scope"]).join(evidence, ["id", "rule_id"], "left")
    outcome = F.when(F.col("error").isNotNull(), "failure").when(F.col("handled") & F.col("evidence").isNull(), "abstention").otherwise("question")
    return met.withColumn("outcome", outcome)


def abstentions(asked: DataFrame) -> DataFrame:
    """(rule_id, kind, count) in order."""
    return asked.where("outcome = 'abstention'").groupBy("rule_id", "kind").agg(F.count("*").alias("count")).orderBy("rule_id", "kind")


def batches(rows: DataFrame, group: str, order: list[str], size: str, most: int = MOST_QUESTIONS, characters: int = MOST_CHARACTERS) -> DataFrame:
    """Adds `batch`: rows of a group packed in order, a batch closing before it passes either limit.

    What a batch holds depends on all rows before it, so that one fold runs over partitions sorted by group;
    it keeps four numbers, however long a group is. A row beyond the limit has a batch of its own.
    """
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",batch:bigint"

    def pack(frames):
        began, inside, batch, held, used = False, None, 0, 0, 0
        for frame in frames:
            numbers = []
            for owner, n in zip(frame.column(group).to_pylist(), frame.column(size).to_pylist(), strict=True):
                if not began or owner != inside:
                    began, inside, batch, held, used = True, owner, 0, 0, 0
                if held and (held == most or used + n > characters):
                    batch, held, used = batch + 1, 0, 0
                held, used = held + 1, used + n
                numbers.append(batch)
            yield frame.append_column("batch", pa.array(numbers, pa.int64()))

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(pack, schema)


def request_size(request: Column) -> Column:
    """Characters of a request as JSON."""
    return F.length(F.to_json(request))


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def question_digest(*parts: Column) -> Column:
    """The key of an answer: a hash of all that can change it, each part with its length in front."""
    text = F.concat(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts])
    return F.sha2(text, 256)


def shard(digest: Column) -> Column:
    return F.substring(digest, 1, 2)


def split_cached(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with probability, misses with each digest once). Cache rows with a bad probability miss."""
    good = cache.where("probability >= 0 and probability <= 1 and not isnan(probability)").groupBy("digest").agg(F.min("probability").alias("probability"))
    hits = asked.join(good, "digest")
    misses = asked.join(good, "digest", "left_anti").dropDuplicates(["digest"])
    return hits, misses


def stub_probability(digest: Column) -> Column:
    """A stand-in for an evaluator: a number from 0 to 1 drawn from the digest. Not a judgment."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def evaluate(asked: DataFrame, score: Callable[[pd.DataFrame], pd.Series], schema: str, too_long: str = "(?i)token limit") -> DataFrame:
    """Asks `score` for the probability of each row, batch by batch (column batch), and adds probability and error.

    A batch that fails for its length is halved and asked again; any other error marks its rows, and so
    do missing, non-numeric and out-of-range answers.
    """
    import re

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            answers = score(pdf).reindex(pdf.index)
        except Exception as problem:
            text = " ".join(str(problem).split())[:MOST_FAILURE_TEXT]
            if re.search(too_long, text) and len(pdf) > 1:
                half = len(pdf) // 2
                return pd.concat([ask(pdf.iloc[:half]), ask(pdf.iloc[half:])])
            return pdf.assign(probability=None, error=text)
        good = answers.between(0, 1)
        return pdf.assign(probability=answers.where(good), error=good.map({True: None, False: "missing or invalid answer"}))

    def rows(frames):
        for pdf in frames:
            for _, part in pdf.groupby("batch", sort=False):
                yield ask(part)

    return asked.mapInPandas(rows, schema)


def answer_state(probability: Column) -> Column:
    """ok, or invalid for a missing, NaN or out-of-range answer."""
    return F.when(probability.isNotNull() & ~F.isnan(probability) & probability.between(0, 1), "ok").otherwise("invalid")


def category_rank(category: Column, order: tuple[str, ...]) -> Column:
    place = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(order)))


def ranked(judgments: DataFrame, categories: tuple[str, ...]) -> list[Column]:
    """The total order of a report."""
    return [category_rank(F.col("category"), categories), F.desc("probability"), *[F.col(c) for c in ("file_path", "start", "end", "rule_id", "kind") if c in judgments.columns]]


def audit_order(candidates: DataFrame) -> list[Column]:
    """Kinds in KIND_ORDER, then importers, position and path."""
    return [category_rank(F.col("kind"), KIND_ORDER), F.desc("in_degree"), F.col("start"), F.col("file_path")]


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the number from 1 of each row in a total order, without gathering the rows in one task."""
    checkpoint_folder(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), part == F.col("_part")).withColumn(name, number).drop("_at", "_part", "_before")


def cap(candidates: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Adds `asked`: whether a candidate is among the first `most`. The cut is found from the `most` rows that
    Spark's top-k keeps, not by a sort of all."""
    first = candidates.orderBy(*order).limit(most).select(F.col("id").alias("_id"), F.lit(True).alias("asked"))
    return candidates.join(first, candidates["id"] == first["_id"], "left").drop("_id").withColumn("asked", F.coalesce("asked", F.lit(False)))


def coverage(capped: DataFrame) -> DataFrame:
    """By kind: candidates, how many were asked and how many omitted."""
    return capped.groupBy("kind").agg(F.count("*").alias("candidates"), F.count_if("asked").alias("covered"), F.count_if(~F.col("asked")).alias("omitted"))


def timings(calls: DataFrame) -> DataFrame:
    """Time of each rule, a batch's time shared equally by its questions."""
    share = calls.withColumn("ms", F.col("batch_ms") / F.count("*").over(W.partitionBy("batch")))
    return share.groupBy("rule_id").agg(F.count("*").alias("questions"), F.round(F.sum("ms"), 3).alias("ms"))
