"""Requests to an evaluator and what is written of its answers: compact evidence, numbered questions, scopes, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Evidence sections that may carry sources, and how much of a module's source a request takes.
SECTIONS = ("abstraction", "configuration", "function")
MODULE_SOURCE = 16_000
#: Fixed value: how many files a comparison looks at.
MOST_FILES = 40
_MAP = "map<string,variant>"


def is_truncated(evidence: Column) -> Column:
    """Whether evidence, as JSON without blanks, says somewhere that it was cut."""
    return F.coalesce(F.contains(evidence, F.lit('"truncated":true')), F.lit(False))


def compact_evidence(rows: DataFrame) -> DataFrame:
    """Takes the sources out of the JSON objects in `evidence`; the first module source becomes `module_source`.

    Null evidence stays null. Keys come out sorted.
    """
    parts = F.try_parse_json("evidence").cast(_MAP)
    sources = [F.try_variant_get(F.get(F.array(F.try_element_at(parts, F.lit(s))), F.lit(0)), "$.moduleSource", "string") for s in SECTIONS]

    def without(name: Column, section: Column) -> Column:
        left = F.map_filter(section.cast(_MAP), lambda k, _: ~k.isin("source", "moduleSource"))
        is_object = F.schema_of_variant(section).startswith("OBJECT")
        return F.when(name.isin(*SECTIONS) & is_object, F.to_variant_object(left)).otherwise(section)

    slim = F.to_json(F.to_variant_object(F.transform_values(parts, without)))
    return rows.withColumns({"evidence": slim, "module_source": F.substring(F.coalesce(*sources), 1, MODULE_SOURCE)})


def questions_of(prepared: DataFrame) -> DataFrame:
    """Names of the questions of each batch: question_id, candidate_index and the paths that its instructions point to.

    `prepared` has file_path, batch, position, candidate_id, rule_id, nearby_source and evidence. Rows of one
    candidate share its index, which follows the candidate's first position.
    """
    batch = W.partitionBy("file_path", "batch")
    first = F.min("position").over(W.partitionBy("file_path", "batch", "candidate_id"))
    named = prepared.withColumn("_first", first).withColumn("candidate_index", F.dense_rank().over(batch.orderBy("_first", "candidate_id")) - 1)
    named = named.withColumn("question_id", F.concat(F.lit("q"), F.row_number().over(batch.orderBy("position", "candidate_id", "rule_id")) - 1))
    at = F.format_string("candidates[%d]", "candidate_index")
    source = F.when(F.col("nearby_source").isNull(), ".source").otherwise(".nearbySource")
    path = F.when(F.col("evidence").isNotNull(), F.concat(at, F.lit('.evidence["'), F.col("rule_id"), F.lit('"]')))
    return named.withColumns({"inspect": at, "context": F.concat(at, source), "evidence_path": path}).drop("_first")


def requests(named: DataFrame) -> DataFrame:
    """One row for each batch: its candidates in order, each once with its evidence by rule, and its questions. A batch is bounded by `review.batches`."""
    by = ["file_path", "batch"]
    found = F.array_sort(F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct("rule_id", "evidence"))))
    each = named.groupBy(*by, "candidate_index", "candidate_id").agg(found.alias("evidence"))
    candidates = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("candidate_index", "candidate_id", "evidence"))).alias("candidates"))
    asked = F.array_sort(F.collect_list(F.struct("position", F.struct("question_id", "rule_id", "inspect", "context", "evidence_path").alias("q"))))
    questions = named.groupBy(*by).agg(F.transform(asked, lambda x: x["q"]).alias("questions"))
    return candidates.join(questions, by)


def scope_files(owners: DataFrame, files: DataFrame, related: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(owner, file_path, position, bounded): the files that each owner is compared with.

    The owner comes first, then files related to it, then all others, by `file_order`; `most` in all. Others
    can only come from the first `most` files, so that those alone meet every owner.
    """
    order = files.select("file_path", "file_order")
    own = owners.select("owner", F.col("owner").alias("file_path"), F.lit(0).alias("rank"))
    near = related.select("owner", "file_path", F.lit(1).alias("rank")).join(owners.select("owner"), "owner", "left_semi")
    head = order.orderBy("file_order").limit(most).select("file_path", F.lit(2).alias("rank"))
    rest = owners.select("owner").join(F.broadcast(head), F.lit(True)).select("owner", "file_path", "rank")
    met = own.unionByName(near).unionByName(rest).groupBy("owner", "file_path").agg(F.min("rank").alias("rank")).join(order, "file_path")
    placed = met.withColumn("position", F.row_number().over(W.partitionBy("owner").orderBy("rank", "file_order", "file_path")))
    total = files.agg(F.count("*").alias("_n"))
    return placed.where(F.col("position") <= most).join(F.broadcast(total), F.lit(True)).select("owner", "file_path", "position", (F.col("_n") > most).alias("bounded"))


def artifact_name(path: Column) -> Column:
    """The file that a source file's artifact is written to; an error for a path that leaves the folder."""
    outside = path.isNull() | (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    return F.when(outside, F.raise_error(F.concat(F.lit("artifact outside the output folder: "), F.coalesce(path, F.lit("null")))).cast("string")).otherwise(F.concat(path, F.lit(".json")))


def artifact_totals(judgments: DataFrame, abstentions: DataFrame) -> DataFrame:
    """(file_path, artifact, evaluated, abstained) of each file with a judgment or an abstention."""
    j = judgments.groupBy("file_path").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
    a = abstentions.groupBy("file_path").agg(F.lit(0).cast("long").alias("n"), F.sum("count").alias("m"))
    both = j.unionByName(a).groupBy("file_path").agg(F.sum("n").alias("evaluated"), F.sum("m").alias("abstained"))
    return both.select("file_path", artifact_name(F.col("file_path")).alias("artifact"), "evaluated", "abstained")


def coverage_sentence(counts: DataFrame) -> DataFrame:
    """`counts` (as `review.coverage` gives them) with a sentence for each kind."""
    state = F.when(F.col("omitted") == 0, "complete").otherwise("incomplete")
    return counts.withColumn("sentence", F.format_string("%d of %d candidates of kind %s scored, %d omitted; coverage %s", "covered", "candidates", "kind", "omitted", state))
