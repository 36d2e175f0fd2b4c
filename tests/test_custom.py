"""Rules of a user's own, and answers that are kept between runs."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspan import api
from quillspan.operators.custom_rules import CustomRule, RuleBook, custom_evidence
from quillspan.sources import files as src
from quillspan.sources.answers import AnswerStore, state_of

TREE = {
    "a.ts": "export function a(x) {\n  // todo: later\n  return x;\n}\nexport function boom(x) {\n  return x;\n}\n",
    "b.ts": "export function b(x) {\n  return x;\n}\nexport function odd(x) {\n  return x;\n}\n",
}
RULES = "rule_id string, scope string, category string, message string"


@pytest.fixture(scope="module")
def tree(spark):
    return api.Repository(src.ordered(spark.createDataFrame(list(TREE.items()), "file_path string, source string")))


def book_of():
    book = RuleBook(taken=api.built_in())

    @book.rule("own/todo", "function", "holds a to-do")
    def todo(candidate):
        if "boom" in candidate["text"]:
            raise KeyError("no\n  such " + "k" * 900)
        if "odd(" in candidate["text"]:
            return {"value": math.nan}
        candidate["text"] = None  # a builder's own copy
        return {"line": candidate["start_line"], "é": [1, None]} if candidate["file_path"] == "a.ts" else None

    @book.rule("own/sets", "function", "gives no JSON", "style")
    def sets(candidate):
        return {1, 2} if candidate["file_path"] == "b.ts" and "b(" in candidate["text"] else None

    return book


def test_rules_are_checked_before_any_job():
    book = book_of()
    build = lambda c: None

    async def waits(candidate):
        return candidate

    for rule in (
        CustomRule("own/todo", "function", "again", build), CustomRule("todo", "function", "m", build), CustomRule("own/x", "line", "m", build), CustomRule("own/x", "function", "", build),
        CustomRule(api.built_in()[0], "function", "m", build), CustomRule(api.built_in()[-1], "function", "m", build), CustomRule("own/x", "function", "m", "text"), CustomRule("own/x", "function", "m", waits),
    ):
        with pytest.raises(ValueError, match="rule"):
            book.add(rule)
    assert set(book.rules) == {"own/todo", "own/sets"}


def test_a_builder_that_fails_leaves_the_others(spark, tree):
    got = {(r.rule_id, r.evidence, (r.error or "")[:40]) for r in custom_evidence(tree.texts.withColumn("id", F.concat_ws("#", "file_path", "id")), book_of()).collect()}
    assert got == {
        ("own/todo", '{"line":1,"é":[1,null]}', ""), ("own/todo", None, "KeyError: 'no\\n such " + "k" * 19), ("own/todo", None, "ValueError: NaN is no JSON"), ("own/sets", None, "TypeError: Object of type set is not JSO"),
    }
    errors = [r.error for r in custom_evidence(tree.texts, book_of()).collect() if r.error]
    assert max(map(len, errors)) == 500
    assert custom_evidence(tree.texts, RuleBook()).collect() == []


def test_custom_rules_in_an_audit(spark, tree):
    report = api.audit(tree, spark.createDataFrame([], RULES), book=book_of())
    assert [(r.file_path, r.rule_id, r.message, r.category) for r in report.judgments.collect()] == [("a.ts", "own/todo", "holds a to-do", "maintainability")]
    assert {(r.file_path, r.rule_id) for r in report.failures.collect()} == {("a.ts", "own/todo"), ("b.ts", "own/todo"), ("b.ts", "own/sets")}
    assert {(r.rule_id, r["count"]) for r in report.abstentions.collect()} == {("own/todo", 1), ("own/sets", 3)}


def digest(k):
    return f"{k:02x}" * 32


def test_answers_replace_what_they_meet(spark, tmp_path):
    store = AnswerStore(spark, f"file://{tmp_path}/answers")
    answers = lambda *rows: spark.createDataFrame(rows, "digest string, probability double")
    assert store.known().collect() == []
    store.update(answers((digest(1), 0.25), (digest(2), 0.5), (digest(3), float("nan")), (digest(4), 1.5), (digest(5), None)))
    known = lambda s=store: {(r.digest, r.probability) for r in s.known().collect()}
    assert known() == {(digest(1), 0.25), (digest(2), 0.5)}
    for _ in range(2):  # repeating an update changes nothing
        store.update(answers((digest(1), 0.75), (digest(9), 0.125)))
        assert known() == {(digest(1), 0.75), (digest(2), 0.5), (digest(9), 0.125)}
    bad = spark.createDataFrame([(1, digest(2), 7.0), (0, digest(8), 0.5)], "format int, digest string, probability double").withColumn("shard", F.substring("digest", 1, 2))
    bad.write.mode("append").partitionBy("shard").parquet(store.folder)
    assert known() == {(digest(1), 0.75), (digest(2), 0.5), (digest(9), 0.125)}
    store.update(answers((digest(2), 0.0)))
    assert known() == {(digest(1), 0.75), (digest(2), 0.0), (digest(9), 0.125)} and store.rows().where("probability > 1").isEmpty()
    assert known(AnswerStore(spark, store.folder, refresh=True)) == set()


def test_a_second_run_asks_nothing(spark, tree, tmp_path):
    rules = spark.createDataFrame([("own/all", "function", "maintainability", "is a function")], RULES)
    store, folder = AnswerStore(spark, f"file://{tmp_path}/answers"), tmp_path / "asked"
    folder.mkdir()
    base = str(folder)

    def score(rows: pd.DataFrame) -> pd.Series:
        import uuid

        for _ in range(len(rows)):
            open(f"{base}/{uuid.uuid4().hex}", "w").close()
        return pd.Series([0.5] * len(rows), index=rows.index)

    first = {(r.digest, r.probability) for r in api.audit(tree, rules, scorer=score, store=store).judgments.collect()}
    asked = len(list(folder.iterdir()))
    assert len(first) == asked == 4
    again = api.audit(tree, rules, scorer=score, store=store).judgments
    assert {(r.digest, r.probability) for r in again.collect()} == first and len(list(folder.iterdir())) == asked
    api.audit(tree, rules, scorer=score, store=AnswerStore(spark, store.folder, refresh=True)).judgments.collect()
    assert len(list(folder.iterdir())) == 2 * asked


def test_states_of_answers(spark):
    rows = spark.createDataFrame([(0.5, None), (2.0, None), (None, None), (float("nan"), None), (0.5, "late")], "p double, e string")
    assert [tuple(r.s) for r in rows.select(state_of(F.col("p"), F.col("e")).alias("s")).collect()] == [
        ("answered", None), ("invalid", "missing or invalid answer"), ("invalid", "missing or invalid answer"), ("invalid", "missing or invalid answer"), ("failed", "late"),
    ]
