import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan import api
from quillspan.functions import text as T
from quillspan.operators import graph, modules, pattern_rules, relation_rules, review, similarity, spans
from quillspan.sources import files as src
from quillspan.streaming import incremental

A = """import { load, type Row as R } from './store';
import fs from 'node:fs';
import * as z from 'zod';

// TODO tidy this
// return oldTotal(rows);
export async function total(rows: R[], scale: number, limit: number) {
  let sum = 0;
  for (const row of rows) {
    const value = await load(row.id);
    sum = sum + value.amount;
  }
  return sum;
}

export function unused(rows, scale, limit) {
  return JSON.parse(rows);
}

export interface Order {
  id: string;
  amount: number;
  status: string;
  isPaid: boolean;
  isSent: boolean;
  isVoid: boolean;
}
"""
STORE = """export function load(id: string) {
  try { return read(id); } catch (e) {}
}
function read(id, scale, limit) {
  console.log(id);
  return load(id);
}
"""
OTHER = """import { total } from '../a/total';
export const show = (rows) => {
  return total(rows);
}
export type Sale = {
  id: string;
  amount: number;
  status: string;
}
"""


@pytest.fixture(scope="module")
def repository(spark):
    rows = [("a/total.ts", A), ("a/store.ts", STORE), ("b/show.ts", OTHER), ("b/show.test.ts", "import { show } from './show';\ntest('shows', () => { show([]); });\n")]
    return api.Repository(src.ordered(spark.createDataFrame(rows, "file_path string, source string")))


def test_candidates(repository):
    out = {(r.file_path, r.kind, r.start_line, r.end_line) for r in repository.candidates.collect()}
    assert ("a/total.ts", "comment", 5, 6) in out and ("a/total.ts", "function", 7, 14) in out and ("a/total.ts", "abstraction", 20, 27) in out
    assert ("b/show.ts", "function", 2, 4) in out and ("a/store.ts", "function", 4, 7) in out


def test_imports_resolve(repository):
    out = {(r.file_path, r.specifier, r.imported, r.local, r.resolved) for r in repository.imports.collect()}
    assert ("a/total.ts", "./store", "load", "load", "a/store.ts") in out and ("a/total.ts", "./store", "Row", "R", "a/store.ts") in out
    assert ("a/total.ts", "node:fs", "default", "fs", None) in out and ("a/total.ts", "zod", "*", "z", None) in out
    assert ("b/show.ts", "../a/total", "total", "total", "a/total.ts") in out
    degree = {r.node: r.in_degree for r in repository.in_degree.collect()}
    assert degree == {"a/total.ts": 1, "a/store.ts": 1, "b/show.ts": 1, "b/show.test.ts": 0}


def test_relation_rules(repository):
    f, c = repository.functions, repository.calls
    assert {(r.owner, r.target, r.file_path) for r in c.collect()} == {("a/store.ts", "load", "a/total.ts"), ("a/store.ts", "read", "a/store.ts"), ("a/store.ts", "load", "a/store.ts"), ("a/total.ts", "total", "b/show.ts")}
    assert {r.name for r in relation_rules.unused_exported_helper(f, c).collect()} == {"unused", "show"}
    assert [(r.name, r.caller_file) for r in relation_rules.single_caller_exported_helper(f, c).collect()] == [("total", "b/show.ts")]
    assert relation_rules.data_clump(f).count() == 0
    members = relation_rules.members_of(repository.texts)
    twins = relation_rules.convergent_twin_types(members).collect()
    assert len(twins) == 1 and twins[0].shared == 3
    deps = modules.manifest_dependencies(repository.files.sparkSession.createDataFrame([("package.json", json.dumps({"devDependencies": {"zod": "1"}}))], "file_path string, source string"))
    assert relation_rules.phantom_package_import(repository.imports, deps).count() == 0
    assert [r.name for r in relation_rules.dev_dependency_runtime_leak(repository.imports, deps).collect()] == ["zod"]
    assert {(r.specifier, r.used) for r in relation_rules.import_use_skew(repository.imports, repository.files).where("file_path = 'a/total.ts'").collect()} == {("./store", 2), ("node:fs", 0), ("zod", 0)}


def test_pattern_rules_hit_and_abstain(spark):
    cases = {
        "swallowed-error": ("try { a(); } catch (e) {}", "try { a(); } catch (e) { report(e); }"),
        "hand-rolled-deep-clone": ("x = JSON.parse(JSON.stringify(y))", "x = structuredClone(y)"),
        "assertion-free-test": ("test('a', () => { run(); })", "test('a', () => { expect(run()).toBe(1); })"),
        "orphaned-timer": ("setInterval(f, 5)", "const t = setInterval(f, 5); clearInterval(t)"),
        "log-and-propagate": ("try {} catch (e) { console.error(e); throw e; }", "try {} catch (e) { throw e; }"),
        "load-bearing-async": ("async function f() { return 1; }", "async function f() { return await g(); }"),
        "weak-crypto-primitive": ("createHash('md5')", "createHash('sha256')"),
        "overloaded-boolean-return": ("return false; return true; return false;", "return true;"),
    }
    rows = [("f", f"{n}{k}", "function", t) for n, pair in cases.items() for k, t in enumerate(pair)]
    found = {(r.id, r.rule_id) for r in pattern_rules.pattern_evidence(spark.createDataFrame(rows, "file_path string, id string, kind string, text string")).collect()}
    for name in cases:
        assert (f"{name}0", f"quill/{name}") in found and (f"{name}1", f"quill/{name}") not in found


def test_audit_review_and_cache(spark, repository, tmp_path):
    related = ("quill/unused-exported-helper", "quill/convergent-twin-types", "quill/import-use-skew", "quill/import-time-side-effect")
    defaults = [r for r in api.default_rules() if r[0] in related or r[0] in {p.rule_id for p in pattern_rules.PATTERN_RULES}]
    rules = spark.createDataFrame([*defaults, ("own/extra", "function", "security", "extra")], "rule_id string, scope string, category string, message string")
    report = api.audit(repository, rules)
    j = report.judgments.collect()
    assert {"quill/swallowed-error", "quill/bare-json-parse", "own/extra", *related[:3]} <= {r.rule_id for r in j} and all(0 <= r.probability <= 1 for r in j)
    total = report.summary().first()
    candidates = repository.candidates.groupBy("kind").count().collect()
    per_kind = {r.kind: r["count"] for r in candidates} | {"module": repository.files.count()}
    n_rules = rules.groupBy("scope").count().collect()
    assert total.judgments + total.abstentions == sum(per_kind.get(r.scope, 0) * r["count"] for r in n_rules) and total.complete and total.unscored == total.judgments
    assert report.text().count() == 5 and report.annotations().count() == total.judgments
    report.write(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "judgments")).count() == total.judgments
    by_file = spark.read.json(str(tmp_path / "out" / "totals")).agg(F.sum("evaluated"), F.sum("abstained")).first()
    assert tuple(by_file) == (total.judgments, total.abstentions)
    assert all(r.sentence.endswith("coverage complete") for r in report.coverage_text().collect())
    few = rules.where("rule_id = 'own/extra' or rule_id = 'quill/swallowed-error'")  # rules that are not asked are not computed
    capped = api.audit(repository, few, most=2).coverage.agg(F.sum("covered"), F.sum("omitted")).first()
    assert tuple(capped) == (2, sum(per_kind.values()) - 2)
    changes = src.changed_files(repository.files.withColumn("source", F.regexp_replace("source", r"JSON\.parse\(rows\)", "rows")), repository.files)
    touched = api.review(repository, changes, few).judgments.select("file_path", "start").distinct().collect()
    assert {tuple(r) for r in touched} <= {("a/total.ts", 16), ("a/total.ts", 1)} and ("a/total.ts", 16) in {tuple(r) for r in touched}
    cached = api.audit(repository, few, scorer=lambda pdf: pd.Series(0.5, pdf.index), cache=report.judgments.select("digest", "probability"))
    assert cached.judgments.where("probability = 0.5").count() == 0 and cached.judgments.count() == sum(r.rule_id in ("own/extra", "quill/swallowed-error") for r in j)


def test_evaluator_halves_and_marks(spark):
    rows = spark.createDataFrame([(k, "a") for k in range(10)], "n long, batch string")

    def score(pdf):
        if len(pdf) > 3:
            raise ValueError("token limit reached")
        if (pdf.n == 9).any():
            raise ValueError("broken   answer")
        return pdf.n.map(lambda n: {0: float("nan"), 1: 1.5}.get(n, n / 10)).drop(pdf.index[pdf.n == 2])

    out = {r.n: (r.probability, r.error) for r in review.evaluate(rows.coalesce(1), score, "n long, batch string, probability double, error string").collect()}
    assert len(out) == 10 and out[4] == (0.4, None) and out[9][1] == "broken answer"
    assert all(out[n][1] == "missing or invalid answer" for n in (0, 1, 2))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 8)), max_size=12), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 8)), max_size=6))
def test_overlap_matches_plain(spark, a, b):
    s = spark.createDataFrame([(k, "f", x, x + n) for k, (x, n) in enumerate(a)], "id long, f string, start_line long, end_line long")
    r = spark.createDataFrame([("f", x, x + n) for x, n in b], "f string, start long, end long")
    out = {x.id for x in spans.overlapping(s, r, "f").collect()}
    assert out == {k for k, (x, n) in enumerate(a) if any(x <= y + m and x + n >= y for y, m in b)}


def test_batches_respect_limits(spark):
    rows = spark.createDataFrame([(k, "f", 10 if k != 5 else 500) for k in range(60)], "k long, file_path string, size long")
    out = review.batches(rows, "file_path", ["k"], "size", most=24, characters=100).orderBy("k").collect()
    groups = pd.DataFrame([r.asDict() for r in out]).groupby("batch")["size"]
    assert [r.batch for r in out] == sorted(r.batch for r in out) and all(len(g) <= 24 and (g.sum() <= 100 or len(g) == 1) for _, g in groups)


def test_change_rules(spark, repository):
    old = [("a/total.ts", A.replace("sum + value.amount", "sum")), ("a/store.ts", STORE), ("b/show.ts", OTHER.replace("total(rows)", "total(rows) + gone(1)") + "export function gone(x) {\n  return x;\n}\n")]
    before = api.Repository(src.ordered(spark.createDataFrame(old, "file_path string, source string")))
    wide = relation_rules.wide_fan_in_edit(before.functions, repository.functions, repository.calls).collect()
    assert [(r.name, r.callers) for r in wide] == [("total", 1)]
    assert {(r.name, r.change) for r in relation_rules.breaking_export_reshape(before.functions, repository.functions).collect()} == {("gone", "removed")}
    lines = src.changed_lines(src.changed_files(before.files, repository.files))
    ranges = {(r.file_path, r.start, r.end) for r in src.changed_ranges(lines).collect()}
    assert ("a/total.ts", 11, 11) in ranges and ("b/show.test.ts", 1, 3) in ranges
    assert relation_rules.shotgun_change(lines).count() == 0  # no name stands on changed lines of two files
    shared = spark.createDataFrame([("a", "load(total)"), ("b", "total = 1"), ("b", "total"), ("c", "of")], "file_path string, line string")
    assert [tuple(r) for r in relation_rules.shotgun_change(shared).collect()] == [("total", 2)]


def test_review_of_a_change_asks_about_modules_and_the_change(spark, repository):
    rules = spark.createDataFrame([r for r in api.default_rules() if r[1] in ("module", "change")], "rule_id string, scope string, category string, message string")
    old = [("a/total.ts", A.replace("sum + value.amount", "sum")), ("a/store.ts", STORE), ("b/show.ts", OTHER + "export let gone = 1;\nexport function away(x) {\n  return x;\n}\n")]
    changes = src.changed_files(src.ordered(spark.createDataFrame(old, "file_path string, source string")), repository.files)
    report = api.review(repository, changes, rules)
    found = {(r.rule_id, r.kind, r.file_path) for r in report.judgments.collect()}
    assert {("quill/wide-fan-in-edit", "change", "a/total.ts"), ("quill/breaking-export-reshape", "change", "a/total.ts")} <= found
    assert {k for _, k, _ in found} >= {"change", "module"} and ("quill/self-authored-exam", "change", "a/total.ts") not in found
    asked = {r.kind: (r.candidates, r.omitted) for r in report.coverage.collect()}
    assert asked["change"] == (1, 0) and asked["module"] == (3, 0)


def test_cycles_and_areas(spark):
    edges = spark.createDataFrame([("a/x", "b/y"), ("b/y", "c/z"), ("c/z", "a/x"), ("d/w", "a/x")], "source string, target string")
    changed = spark.createDataFrame([("a/x",), ("d/w",)], "node string")
    assert [tuple(r) for r in relation_rules.import_cycle_tangle(edges, changed).collect()] == [("a/x", 3)]
    before = spark.createDataFrame([("b/y", "a/x")], "source string, target string")
    after = spark.createDataFrame([("b/y", "a/x"), ("a/q", "b/y"), ("a/q", "c/z"), ("a/q", "d/w")], "source string, target string")
    assert [tuple(r) for r in relation_rules.direction_reversing_edge(after, before).collect()] == [("a/q", "b/y")]
    assert [tuple(r) for r in relation_rules.efferent_coupling_burst(after, before).collect()] == [("a/q", 3)]


def test_far_away_tests(spark):
    rows = [(f"m{k}/a{k}.ts",) for k in range(6)] + [(f"m{k}/a{k}.test.ts",) for k in range(6)] + [("tests/far.test.ts",)]
    assert [r.file_path for r in relation_rules.far_away_test(spark.createDataFrame(rows, "file_path string")).collect()] == ["tests/far.test.ts"]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.ts").write_text("let a;\r\nlet b;\r")
    (tmp_path / "package.json").write_text("{}")
    (tmp_path / "readme.md").write_text("no")
    out = {r.file_path: r.source for r in src.project_files(spark, str(tmp_path)).collect()}
    assert out == {"a/x.ts": "let a;\nlet b;\n", "package.json": "{}"}
    with pytest.raises(ValueError, match="scope"):
        src.check_rule("own/x", {"scope": "nothing", "message": "m"})
    names = spark.createDataFrame([("functoin",), ("module",)], "name string")
    assert [tuple(r) for r in src.suggest(names, list(src.SCOPES)).collect()] == [("functoin", "function")]


def test_text_functions(spark):
    row = spark.createDataFrame([("ab\ncd\nef", "parseHTTPRow_2x", "src/core/api/x.ts")], "s string, n string, p string")
    out = row.select(T.line_at(F.col("s"), F.lit(4)).alias("l"), T.column_at(F.col("s"), F.lit(4)).alias("c"), T.name_tokens(F.col("n")).alias("t"), T.layer_of(F.col("p"), ["api", "core"]).alias("y"), T.top_directory(F.col("p")).alias("d")).first()
    assert (out.l, out.c, out.y, out.d) == (2, 2, "core", "src") and out.t == ["parse", "httprow", "2x"]
    assert modules.normal_path(F.lit("a")) is not None
    assert row.select(modules.normal_path(F.lit("a/./b/../c"))).first()[0] == "a/c"


def test_graph_and_similarity(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert {(r.node, r.least) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("d", None)], "o string, i long")
    assert [tuple(r) for r in similarity.shared_items(items, "o", "i", 2).collect()] == [("a", "b", 2, 1.0)]


def test_stream(spark, tmp_path):
    rows = [("a.ts", "function f() {\n  eval(x);\n}\n"), ("a.ts", "function f() {\n  eval(x);\n}\n")]
    spark.createDataFrame(rows, "file_path string, source string").withColumn("seen", F.lit("2026-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    q = incremental.start(incremental.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.rule_id for r in out.where("rule_id = 'quill/dynamic-code-execution'").collect()] == ["quill/dynamic-code-execution"]
