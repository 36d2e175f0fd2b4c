"""A review from files to a report, in DataFrames from end to end.

    facts = Repository(files)
    report = audit(facts, rules)                      # the whole tree
    report = review(facts, changes, rules)            # only what changed lines touch

Pattern rules give evidence for single spans, relational rules for functions, types, modules and, in a
review, for the change as a whole; both abstain where they find none. Any other rule of the table
`rules` is asked without evidence. Without a scorer judgments are marked as not scored: their
probability is then a hash of the question, which orders them and means nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import custom_rules, module_facts, modules, references, relation_evidence, relation_rules, requests, review as ops, spans
from quillspan.operators.pattern_rules import PATTERN_RULES, pattern_evidence, span_texts
from quillspan.operators.custom_rules import RuleBook
from quillspan.session import checkpoint_folder, stored
from quillspan.sources.answers import AnswerStore
from quillspan.sources.files import changed_lines, changed_ranges

#: The order of categories in a report.
CATEGORIES = ("security", "correctness", "reliability", "testing", "performance", "maintainability")


#: Rules whose evidence is computed in one job.
TOGETHER = 6


@dataclass(frozen=True)
class Repository:
    """The relations of a tree (file_path, source, file_order), each made once and kept."""

    files: DataFrame

    @cached_property
    def candidates(self) -> DataFrame:
        return spans.candidates(self.files).persist()

    @cached_property
    def texts(self) -> DataFrame:
        return span_texts(self.files, self.candidates).persist()

    @cached_property
    def imports(self) -> DataFrame:
        return modules.resolve(modules.module_imports(self.files), self.files).persist()

    @cached_property
    def edges(self) -> DataFrame:
        return self.imports.where("resolved is not null and resolved <> file_path").select(F.col("file_path").alias("source"), F.col("resolved").alias("target"), "specifier").distinct().persist()

    @cached_property
    def in_degree(self) -> DataFrame:
        return modules.in_degree(self.edges, self.files.select(F.col("file_path").alias("node")))

    @cached_property
    def functions(self) -> DataFrame:
        return relation_rules.functions_of(self.texts).persist()

    @cached_property
    def calls(self) -> DataFrame:
        return relation_rules.resolved_calls(relation_rules.calls_of(self.functions), self.functions, self.imports).persist()

    @cached_property
    def postings(self) -> DataFrame:
        return references.postings(self.files).persist()

    @cached_property
    def references(self) -> DataFrame:
        """Functions named as values, and called from other files, in functions or outside them."""
        return references.function_references(self.functions, self.imports, self.postings).where("kind = 'value' or file_path <> owner").persist()

    def close(self) -> None:
        for name in ("candidates", "texts", "imports", "edges", "functions", "calls", "postings", "references"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()


@dataclass(frozen=True)
class Report:
    judgments: DataFrame
    abstentions: DataFrame
    failures: DataFrame
    coverage: DataFrame
    totals: DataFrame

    def text(self, shown: int = ops.SHOWN, least: float = 0.0) -> DataFrame:
        """The best judgments as lines, ranked; `least` and `shown` bound only what is displayed."""
        best = self.judgments.where(F.col("probability") >= least).orderBy(*ops.ranked(self.judgments, CATEGORIES)).limit(shown)
        return best.select(F.format_string("%s:%d-%d %s %.2f %s", "file_path", "start", "end", "rule_id", "probability", "message").alias("line"))

    def annotations(self) -> DataFrame:
        from quillspan.functions.text import escape_annotation

        line = F.concat(F.lit("::notice file="), escape_annotation(F.col("file_path"), True), F.lit(",line="), F.col("start").cast("string"), F.lit(",endLine="), F.col("end").cast("string"), F.lit("::"), escape_annotation(F.col("message")))
        return self.judgments.select("file_path", "start", line.alias("line"))

    def summary(self) -> DataFrame:
        """One row of totals; complete if nothing failed."""
        j = self.judgments.agg(F.count("*").alias("judgments"))
        a = self.abstentions.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("abstentions"))
        f = self.failures.agg(F.count("*").alias("failures"))
        j = j.join(F.broadcast(self.judgments.where("not scored").agg(F.count("*").alias("unscored"))), F.lit(True))
        return j.join(F.broadcast(a), F.lit(True)).join(F.broadcast(f), F.lit(True)).withColumn("complete", F.col("failures") == 0)

    def coverage_text(self) -> DataFrame:
        """A sentence for each kind of candidate."""
        return requests.coverage_sentence(self.coverage).select("kind", "sentence")

    def write(self, folder: str) -> None:
        """Judgments and totals by file, abstentions and the summary as JSON."""
        self.judgments.withColumn("shard", ops.shard(F.sha2("file_path", 256))).write.mode("overwrite").partitionBy("shard").json(f"{folder}/judgments")
        self.abstentions.write.mode("overwrite").json(f"{folder}/abstentions")
        self.totals.write.mode("overwrite").json(f"{folder}/totals")
        self.summary().write.mode("overwrite").json(f"{folder}/summary")


def default_rules() -> list[tuple]:
    """(rule_id, scope, category, message) of the pattern rules and the relational rules."""
    category = lambda name: "testing" if "test" in name else "maintainability"
    patterns = [(r.rule_id, r.scope, category(r.name), r.message) for r in PATTERN_RULES]
    return patterns + [(relation_evidence.rule_id(n), scope, category(n), message) for n, scope, message in relation_evidence.RELATION_RULES]


def built_in() -> list[str]:
    """Names of the rules that the engine has builders for."""
    return [r.rule_id for r in PATTERN_RULES] + [relation_evidence.rule_id(n) for n, _, _ in relation_evidence.RELATION_RULES]


def audit(
    repository: Repository, rules: DataFrame, most: int | None = None, scorer: Callable[[pd.DataFrame], pd.Series] | None = None, cache: DataFrame | None = None, book: RuleBook | None = None, store: AnswerStore | None = None
) -> Report:
    """All spans and modules of the tree, in audit order if `most` bounds how many are asked.

    `book` holds rules of the user's own. Answers are looked up in `cache` or in `store`, which also takes in the new ones.
    """
    found = _found(repository) | relation_evidence.module_evidence(repository)
    return _judge(repository, _with(repository.texts, module_facts.module_candidates(repository.files)), rules, most, scorer, cache, found, book, store)


def review(
    repository: Repository, changes: DataFrame, rules: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] | None = None, cache: DataFrame | None = None, book: RuleBook | None = None, store: AnswerStore | None = None
) -> Report:
    """The spans that share a line with the changes (file_path, source, old_source), the modules that changed, and the change."""
    ranges = changed_ranges(changed_lines(changes))
    touched = spans.overlapping(repository.texts, ranges, "file_path")
    changed = module_facts.module_candidates(repository.files.join(changes.select("file_path").distinct(), "file_path", "left_semi"))
    before = _before(repository, changes)
    found = _found(repository) | relation_evidence.module_evidence(repository, before) | relation_evidence.change_evidence(repository, before, changes)
    whole = module_facts.change_candidate(changes, ranges)
    return _judge(repository, _with(_with(touched, changed), whole), rules, None, scorer, cache, found, book, store)


def _found(repository: Repository) -> dict[str, relation_evidence.Evidence]:
    of_functions = relation_evidence.function_evidence(repository.functions, repository.calls, repository.references) | relation_evidence.call_evidence(repository)
    return of_functions | relation_evidence.type_evidence(relation_rules.members_of(repository.texts)) | relation_evidence.class_evidence(repository)


def _before(repository: Repository, changes: DataFrame) -> Repository:
    """The tree without the changes; files that it gained are not in it."""
    c = changes.select(F.col("file_path").alias("_f"), "old_source", F.lit(True).alias("_changed"))
    met = repository.files.join(c, F.col("file_path") == F.col("_f"), "left").where("_changed is null or old_source is not null")
    return Repository(met.select("file_path", F.coalesce("old_source", "source").alias("source"), "file_order"))


def _with(texts: DataFrame, more: DataFrame) -> DataFrame:
    columns = ("file_path", "kind", "start_line", "end_line", "id", "text")
    return texts.select(*columns).unionByName(more.select(*columns))


def _judge(repository: Repository, texts: DataFrame, rules: DataFrame, most: int | None, scorer, cache: DataFrame | None, related: dict[str, relation_evidence.Evidence], book: RuleBook | None, store: AnswerStore | None) -> Report:
    spark = texts.sparkSession
    checkpoint_folder(spark)
    book = book or RuleBook()
    if book.rules:
        rules = rules.select("rule_id", "scope", "category", "message").unionByName(spark.createDataFrame(book.rows(), "rule_id string, scope string, category string, message string"))
    if store is not None and cache is None:
        cache = store.known()
    handled = [*built_in(), *book.rules]
    texts = texts.withColumn("id", F.when(F.col("kind") == "change", F.lit("change")).otherwise(F.concat_ws("#", "file_path", "id")))
    found = pattern_evidence(texts, keep=("id",))
    evidence = found.groupBy("id", "rule_id").agg(F.to_json(F.struct(F.first("matches").alias("matches"), F.first("total").alias("total"))).alias("evidence"))
    asked_rules = {r.rule_id for r in rules.select("rule_id").collect()}  # the table of rules is configuration
    evidence = stored(evidence)
    parts = relation_evidence.evidence(related, asked_rules)
    for k in range(0, len(parts), TOGETHER):  # a plan of all rules at once would be too large to optimise
        several = parts[k]
        for part in parts[k + 1 : k + TOGETHER]:
            several = several.unionByName(part)
        evidence = evidence.unionByName(stored(several))
    evidence = evidence.withColumn("error", F.lit(None).cast("string"))
    if book.rules:
        evidence = evidence.unionByName(stored(custom_rules.custom_evidence(texts, book)))
    table = rules.select("rule_id", "scope", "category", "message", F.col("rule_id").isin(*handled).alias("handled"))
    degrees = repository.in_degree.select(F.col("node").alias("_n"), "in_degree")
    placed = texts.join(degrees, F.col("file_path") == F.col("_n"), "left").select("id", "kind", "file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "text", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    placed = placed.withColumn("asked", F.lit(True)) if most is None else ops.cap(placed, ops.audit_order(placed), most)
    placed = placed.persist()
    met = ops.questions(placed.where("asked"), table, evidence)
    met = met.withColumn("digest", ops.question_digest(F.col("rule_id"), F.col("kind"), F.col("text"), F.coalesce("evidence", F.lit("")))).persist()
    asked = met.where("outcome = 'question'").select("id", "rule_id", "kind", "file_path", "start", "end", "category", "message", "digest", F.coalesce("evidence", F.lit("")).alias("evidence"), F.length("text").cast("long").alias("size"))
    known = None
    if cache is not None:
        known, _ = ops.split_cached(asked, cache)
        asked = asked.join(known.select("digest").distinct(), "digest", "left_anti")
    if scorer is None:
        scored = asked.withColumns({"probability": ops.stub_probability(F.col("digest")), "error": F.lit(None).cast("string")})
    else:
        batched = ops.batches(asked, "file_path", ["start", "end", "rule_id"], "size").repartition("file_path", "batch").sortWithinPartitions("file_path", "batch")
        schema = batched.schema.simpleString()[len("struct<") : -1] + ",probability:double,error:string"
        scored = ops.evaluate(batched.withColumn("batch", F.concat_ws("#", "file_path", "batch")), scorer, schema.replace("batch:bigint", "batch:string"))
    scored = scored.withColumn("scored", F.lit(scorer is not None))
    if store is not None and scorer is not None:  # answers that are kept are computed once
        scored = scored.checkpoint()
        store.update(scored.where("error is null").select("digest", "probability"))
    columns = ["category", "probability", "scored", "file_path", "start", "end", "rule_id", "kind", "message", "digest"]
    judgments = scored.where("error is null").select(*columns)
    if known is not None:
        judgments = judgments.unionByName(known.withColumn("scored", F.lit(True)).select(*columns))
    failures = scored.where("error is not null").select("file_path", "rule_id", "id", "error")
    failures = failures.unionByName(met.where("outcome = 'failure'").select("file_path", "rule_id", "id", "error"))
    silent = met.where("outcome = 'abstention'").groupBy("file_path", "rule_id").agg(F.count("*").alias("count"))
    totals = requests.artifact_totals(judgments, silent)
    return Report(judgments, ops.abstentions(met), failures, ops.coverage(placed), totals)

