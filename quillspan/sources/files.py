"""Sources of a review: files of a tree, changed files of two snapshots, manifests, rules."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import closest_key, is_source_file, normalize_source
from quillspan.sources.diff import line_hunks

SCOPES = ("function", "comment", "abstraction", "change", "module")
#: Files beside sources that rules read.
OTHER_FILES = r"(^|/)(package\.json|CODEOWNERS)$"


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, source, file_order) of all source files and manifests under a folder of any file system."""
    raw = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root).select("path", "content")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^" + base.replace("\\", "/") + "/", "")
    files = raw.select(relative.alias("file_path"), F.decode("content", "UTF-8").alias("source"))
    return ordered(files.where(is_source_file(F.col("file_path")) | F.col("file_path").rlike(OTHER_FILES)))


def ordered(files: DataFrame) -> DataFrame:
    """Each path once, line ends made one, with file_order, the rank of the path.

    The rank is needed only to break ties, so that paths are ranked within their first directory.
    """
    once = files.dropDuplicates(["file_path"]).withColumn("source", normalize_source(F.col("source")))
    top = F.substring_index("file_path", "/", 1)
    rank = F.row_number().over(W.partitionBy(top).orderBy("file_path"))
    return once.withColumn("file_order", F.struct(top.alias("top"), rank.alias("rank")))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, source, old_source) of files that are new or differ; deleted files go."""
    b = before.select("file_path", F.col("source").alias("old_source"))
    return after.select("file_path", "source").join(b, "file_path", "left").where(F.col("old_source").isNull() | (F.col("old_source") != F.col("source")))


def changed_lines(changes: DataFrame) -> DataFrame:
    """(file_path, line_number, line) of lines that are not common to the old source: new ones, changed ones and those that moved."""
    new = line_hunks(changes).select("file_path", "new_at", F.posexplode("new_lines").alias("at", "line"))
    return new.select("file_path", (F.col("new_at") + F.col("at")).alias("line_number"), "line")


def changed_ranges(lines: DataFrame) -> DataFrame:
    """(file_path, start, end): maximal runs of changed lines."""
    run = F.col("line_number") - F.row_number().over(W.partitionBy("file_path").orderBy("line_number"))
    return lines.withColumn("run", run).groupBy("file_path", "run").agg(F.min("line_number").alias("start"), F.max("line_number").alias("end")).drop("run")


def load_rules(spark: SparkSession, path: str | None, defaults: list[tuple]) -> DataFrame:
    """(rule_id, scope, category, message) of the defaults, or of a JSON file {rule_id: {scope, category, message}}."""
    if path is not None:
        read = json.loads(Path(path).read_text(encoding="utf-8"))
        defaults = [(k, *(check_rule(k, v)[c] for c in ("scope", "category", "message"))) for k, v in read.items()]
    return spark.createDataFrame(defaults, "rule_id string, scope string, category string, message string")


def check_rule(rule_id: str, rule: dict) -> dict:
    """A rule with all its fields, or an error that names what is wrong."""
    if not rule_id or "/" not in rule_id:
        raise ValueError(f"rule {rule_id!r} needs a name of the form namespace/name")
    if rule.get("scope") not in SCOPES:
        raise ValueError(f"rule {rule_id!r} needs a scope among {', '.join(SCOPES)}")
    if not rule.get("message"):
        raise ValueError(f"rule {rule_id!r} needs a message")
    return {"scope": rule["scope"], "category": rule.get("category", "maintainability"), "message": rule["message"]}


def suggest(names: DataFrame, known: list[str]) -> DataFrame:
    """(name, suggestion) for names that are not known."""
    return names.where(~F.col("name").isin(*known)).withColumn("suggestion", closest_key(F.col("name"), known, 3))
