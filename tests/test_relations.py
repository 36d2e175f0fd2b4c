"""Relational rules one by one: a case that each finds, and one that it leaves alone."""

import random

from quillspan import api
from quillspan.operators import call_rules as CR
from quillspan.operators import modules as M
from quillspan.operators import relation_rules as RR
from quillspan.operators import similarity as S
from quillspan.sources import files as src

FUNCTIONS = "file_path string, name string, parameters array<string>, exported boolean, text string"


def functions(spark, *rows):
    return spark.createDataFrame([(f, n, p, True, t) for f, n, p, t in rows], FUNCTIONS)


def lines(spark, *rows):
    return spark.createDataFrame(rows, "file_path string, line string")


def found(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_barrel_wide_reexport(spark):
    rows = lines(spark, ("a/index.ts", "export * from './x/one';"), ("a/index.ts", "  export * as y from './y/two'"), ("a/index.ts", "export { b } from './b';"), ("a/other.ts", "export * from './x/one';"))
    assert found(RR.barrel_wide_reexport(rows)) == [("a/index.ts", 2, 2)]
    assert found(RR.barrel_wide_reexport(rows.where("file_path = 'a/other.ts'"))) == []


def test_change_stranded_code(spark):
    calls = lambda *rows: spark.createDataFrame(rows, "owner string, target string")
    after = functions(spark, ("a.ts", "left", [], ""), ("a.ts", "kept", [], ""), ("a.ts", "never", [], ""))
    before = calls(("a.ts", "left"), ("a.ts", "kept"), ("a.ts", "gone"))
    assert found(RR.change_stranded_code(before, calls(("a.ts", "kept")), after)) == [("a.ts", "left")]
    assert found(RR.change_stranded_code(before, calls(("a.ts", "kept")), after, calls(("a.ts", "left")))) == []


def test_clone_and_tweak_sibling(spark):
    f = functions(spark, ("a.ts", "one", [], "a b c d e"), ("a.ts", "two", [], "a b c d f"), ("a.ts", "three", [], "v w x y z"), ("b.ts", "far", [], "a b c d e"))
    assert found(RR.clone_and_tweak_sibling(f)) == [("a.ts", "one", "two", 0.667), ("a.ts", "two", "one", 0.667)]


def test_context_homonym_type(spark):
    rows = [("Order", "a", "id"), ("Order", "a", "sum"), ("Order", "b", "sum"), ("Order", "c", "rank"), ("Order", "d", "sum"), ("Same", "a", "x"), ("Same", "b", "x"), ("Lone", "a", "q")]
    members = spark.createDataFrame(rows, "type_name string, file_path string, member string")
    assert found(RR.context_homonym_type(members)) == [("Order", "a", "c", 2), ("Order", "b", "c", 2), ("Order", "c", "a", 2), ("Order", "d", "c", 2)]


def test_duplicate_module_role(spark):
    files = spark.createDataFrame([("a/orderStore.ts",), ("a/order_cache.ts",), ("a/user.ts",), ("b/orderStore.ts",)], "file_path string")
    assert found(RR.duplicate_module_role(files.where("file_path = 'a/orderStore.ts'"), files)) == [("a/orderStore.ts", "a/order_cache.ts", 1)]
    assert found(RR.duplicate_module_role(files.where("file_path = 'a/user.ts'"), files)) == []


def test_duplicated_logic(spark):
    body = "const total = a + b + c;\nreportTotal(total, a);\nreturn total * factor;"
    f = functions(spark, ("a.ts", "one", [], body), ("b.ts", "two", [], body.replace(" + ", "+")), ("c.ts", "three", [], body.replace("factor", "other")))
    assert found(RR.duplicated_logic(f), "left", "right", "shared") == [("a.ts#one", "b.ts#two", 3)]


def test_heterogeneous_primitive_callers(spark):
    rows = [("o", "t", "user.id, 1"), ("o", "t", "order.key"), ("o", "t", "name"), ("o", "u", "id"), ("o", "u", "a.id"), ("o", "u", "'x'"), ("o", "u", "")]
    calls = spark.createDataFrame(rows, "owner string, target string, arguments string")
    assert found(RR.heterogeneous_primitive_callers(calls)) == [("o", "t", 3)]


def test_punned_name(spark):
    f = functions(spark, ("a.ts", "load", ["a"], ""), ("b.ts", "load", ["b"], ""), ("a.ts", "save", ["a"], ""), ("b.ts", "save", ["a"], ""), ("a.ts", "two", ["a"], ""), ("a.ts", "two", ["b"], ""))
    assert found(RR.punned_name(f)) == [("load", 2, 2)]


def test_single_use_dependency(spark):
    deps = lambda *names: spark.createDataFrame([("package.json", n) for n in names], "file_path string, name string")
    imports = spark.createDataFrame([("a.ts", "zod"), ("a.ts", "zod/v4"), ("b.ts", "@x/y/z"), ("c.ts", "@x/y"), ("d.ts", "./zod")], "file_path string, specifier string")
    assert found(RR.single_use_dependency(deps("old"), deps("old", "zod", "@x/y", "idle"), imports)) == [("package.json", "@x/y", 2), ("package.json", "idle", 0), ("package.json", "zod", 1)]
    assert found(RR.single_use_dependency(deps("old"), deps("old"), imports)) == []


def test_sync_async_sibling_ambiguity(spark):
    f = functions(spark, ("a.ts", "read", [], "function read() {}"), ("a.ts", "readAsync", [], "export async function readAsync() {}"), ("a.ts", "put", [], "async function put() {}"), ("b.ts", "putSync", [], "function putSync() {}"))
    assert found(RR.sync_async_sibling_ambiguity(f)) == [("a.ts", "read", ["read", "readAsync"])]


def test_synonym_vocabulary(spark):
    f = functions(spark, *[("a.ts", n, [], "") for n in ("getUser", "fetchUser", "loadUser", "getOrder", "setOrder", "User")], ("b.ts", "readUser", [], ""))
    assert found(RR.synonym_vocabulary(f)) == [("a.ts", "User", ["fetch", "get", "load"])]


def test_transitive_plumbing(spark):
    only = lambda n: ("a.ts", n, ["ctx"], f"function {n}(ctx) {{\n  return next(1, ctx);\n}}")
    f = functions(spark, only("a"), only("b"), only("c"), ("a.ts", "d", ["ctx"], "function d(ctx) {\n  ctx.log();\n  next(ctx);\n}"), ("a.ts", "e", ["id"], "function e(id) {\n  next(id);\n}"))
    assert found(RR.transitive_plumbing(f)) == [("a.ts", n, "ctx", 3) for n in "abc"]


def test_jaccard_pairs_against_all_pairs(spark):
    r = random.Random(1)
    sets = {(g, k): set(r.sample(range(12), r.randint(1, 8))) for g in (1, 2, None) for k in range(25)}
    rows = [(g, k, v) for (g, k), s in sets.items() for v in s] + [(1, None, 3), (1, 3, None)]
    for least in (0.3, 0.5, 1.0):
        got = {(x.g, x.left, x.right, x.jaccard) for x in S.jaccard_pairs(spark.createDataFrame(rows, "g long, o long, i long"), "g", "o", "i", least).collect()}
        both = lambda a, b: len(a & b) / len(a | b)
        assert got == {(g, a, b, round(both(sets[g, a], sets[g, b]), 3)) for g in (1, 2, None) for a in range(25) for b in range(a + 1, 25) if both(sets[g, a], sets[g, b]) >= least}


def test_equal_functions_are_judged_by_their_own_comments(spark):
    """Two functions with one text: the comment before the first says nothing of the second."""
    body = "export function legacyLoad(x) {\n  const y = x;\n  return y;\n}\n"
    files = {"a.ts": "/** @deprecated */\n" + body + "const gap = 1;\n" * 60 + body, "b.ts": "export function load(x) {\n  const y = x;\n  return y;\n}\n"}
    tree = api.Repository(src.ordered(spark.createDataFrame(list(files.items()), "file_path string, source string")))
    assert found(CR.unmarked_abandoned_compat_layer(tree.functions, tree.calls, tree.files), "name", "successor") == [("legacyLoad", "load")]
    own = {(r.start_line, r._before[-12:]) for r in CR._before(tree.functions, tree.files).collect()}
    assert own == {(2, "precated */\n"), (66, "st gap = 1;\n"), (1, "")}


def test_a_habit_of_one_function(spark):
    kept = "".join(f"export function k{k}(a) {{\n  const b = a === {k};\n  return b;\n}}\n" for k in range(3))
    odd = "export function odd(a) {\n  var b = a == 1;\n  return b;\n}\n"
    tree = api.Repository(src.ordered(spark.createDataFrame([("a.ts", kept + odd), ("b.ts", odd)], "file_path string, source string")))
    got = {(r.file_path, r.name): [d.split(":")[0] for d in r.divergences] for r in CR.convention_breaking_addition(tree.functions, tree.files).collect()}
    assert got == {("a.ts", "odd"): ["equality", "binding"]}


def test_first_callers_and_their_number(spark):
    rows = [(o, k) for o in ("a", None) for k in range(7)] + [("b", 1)]
    got = found(M.first_callers(spark.createDataFrame(rows, "o string, k long"), ["o"], ["k"], 2).selectExpr("coalesce(o, '-') as o", "k", "position", "total"))
    assert got == [("-", 0, 1, 7), ("-", 1, 2, 7), ("a", 0, 1, 7), ("a", 1, 2, 7), ("b", 1, 1, 1)]
