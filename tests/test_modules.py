"""Facts and rules about modules and changes, each with a case that it reports and one that it leaves alone."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import module_facts as MF
from quillspan.operators import module_rules as MR
from quillspan.operators import modules, relation_rules, similarity, spans
from quillspan.sources import files as src

EDGES = "source string, target string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def tree(spark):
    files = {
        "a/index.ts": "export { load, save as store } from './load';\nexport * from './types';\nexport * as more from './more';\n",
        "a/load.ts": "export function load() {}\nexport const save = 1;\nexport default load;\nexport let limit = 3;\n",
        "a/types.ts": "export interface Row {}\nexport type Id = string;\nexport class Table {}\n",
        "b/use.ts": "import { load } from '../a/load';\nimport './effect';\nfetch('x');\n  setTimeout(f, 1);\n",
        "b/use.test.ts": "import { it } from 'vitest';\nimport { load } from './use';\n",
        "b/check.ts": "it('works', () => {});\n",
    }
    return src.ordered(spark.createDataFrame(list(files.items()), "file_path string, source string"))


def test_exports_and_specifiers(tree):
    assert rows(MF.exports(tree), "file_path", "name", "kind") == [
        ("a/index.ts", "*", "wildcard"), ("a/index.ts", "load", "list"), ("a/index.ts", "more", "wildcard"), ("a/index.ts", "store", "list"),
        ("a/load.ts", "default", "default"), ("a/load.ts", "limit", "let"), ("a/load.ts", "load", "function"), ("a/load.ts", "save", "const"),
        ("a/types.ts", "Id", "type"), ("a/types.ts", "Row", "interface"), ("a/types.ts", "Table", "class"),
    ]
    assert rows(MF.reexports(tree), "specifier", "name") == [("./load", "load"), ("./load", "store"), ("./more", "more"), ("./types", "*")]
    assert rows(MF.specifiers(tree).where("file_path = 'b/use.ts'"), "specifier") == [("../a/load",), ("./effect",)]
    assert rows(MF.test_files(tree), "file_path") == [("b/check.ts",), ("b/use.test.ts",)]
    assert MF.placement_norm(tree).first().is_norm and not MF.barrel_norm(tree).first().is_norm


def test_importers_and_module_rows(spark, tree):
    imports = modules.resolve(modules.module_imports(tree), tree)
    assert [(r.owner, r.file_path, r.symbols) for r in MF.importers(imports).orderBy("owner").collect()] == [("a/load.ts", "b/use.ts", ["load"]), ("b/use.ts", "b/use.test.ts", ["load"])]
    e = spark.createDataFrame([(f"s{k:02d}", "t") for k in range(45)] + [("x", "u")], EDGES)
    found = MF.edges_in(e).groupBy("target").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.max("truncated").alias("cut"))
    assert rows(found, "target", "n", "total", "cut") == [("t", 40, 45, True), ("u", 1, 1, False)]
    assert MF.module_rows(tree, e).count() == 0  # too few files
    many = src.ordered(spark.createDataFrame([(f"m/f{k}.ts", "export const a = 1;\n") for k in range(10)] + [("n/alone.ts", "")], "file_path string, source string"))
    edges = spark.createDataFrame([("m/f1.ts", "m/f0.ts"), ("n/alone.ts", "m/f0.ts")], EDGES)
    new = spark.createDataFrame([("n/alone.ts",), ("m/f3.ts",)], "file_path string")
    facts = {r.file_path: r for r in MF.module_rows(many, edges, new).collect()}
    assert "n/alone.ts" not in facts and (facts["m/f0.ts"].importers, facts["m/f0.ts"].areas, facts["m/f0.ts"].exports) == (2, 2, ["a"])
    calls = spark.createDataFrame([("b/use.ts", "o", "t"), ("b/check.ts", "o", "t")], "file_path string, owner string, target string")
    assert rows(MF.callers_by_test(calls, MF.test_files(tree)), "target", "production", "test") == [("t", 1, 1)]


def exported(spark, *pairs):
    return spark.createDataFrame([(f, n, k) for f, names in pairs for n, k in names], "file_path string, name string, kind string")


def test_export_rules(spark):
    before = exported(spark, ("lib/x.ts", [("a", "const"), ("b", "const")]), ("lib/y.ts", [("a", "const")]), ("k/utils.ts", [("parseDate", "function"), ("sendMail", "function"), ("readFile", "function")]))
    after = exported(spark, ("lib/x.ts", [("a", "const")]), ("lib/y.ts", [("a", "const"), ("c", "let")]), ("k/utils.ts", [("parseDate", "function"), ("sendMail", "function"), ("readFile", "function"), ("drawChart", "function"), ("writeFile", "function")]))
    edges = spark.createDataFrame([(s, t) for t in ("lib/x.ts", "lib/y.ts") for s in ("p/1.ts", "q/2.test.ts")], EDGES)
    assert rows(MR.cross_area_export_break(before, after, edges), "file_path", "removed", "areas", "runtime") == [("lib/x.ts", ["b"], 2, 1)]
    assert rows(MR.stable_surface_widening(before, after, edges), "file_path", "added", "importers") == [("lib/y.ts", ["c"], 2)]
    assert rows(MR.mutable_surface_expansion(before, after, edges), "file_path", "bindings", "importers") == [("lib/y.ts", ["c"], 2)]
    assert rows(MR.utils_grab_bag_growth(before, after), "file_path", "subjects", "fresh") == [("k/utils.ts", 3, ["chart"])]
    uses = spark.createDataFrame([("p/1.ts", "drawChart"), ("q/2.ts", "parseDate"), ("p/1.ts", "sendMail")], "file_path string, imported string").withColumn("resolved", F.lit("k/utils.ts"))
    assert rows(MR.utility_module_grab_bag(before, after, uses), "file_path", "name", "apart_from") == [("k/utils.ts", "drawChart", ["parseDate"])]
    three = spark.createDataFrame([(f"p/{k}.ts", t) for k in range(3) for t in ("k/utils.ts", "lib/z.ts")], EDGES)
    kinds = after.unionByName(exported(spark, ("lib/z.ts", [("A", "interface"), ("b", "const")])))
    assert rows(MR.concrete_stable_module(kinds, three), "file_path", "concrete", "importers") == [("k/utils.ts", 5, 3)]
    files = spark.createDataFrame([("lib/x.ts",), ("own/x.ts",), ("oth/x.ts",)], "file_path string")
    twins = after.unionByName(exported(spark, ("own/x.ts", [("z", "const")]), ("oth/x.ts", [("a", "const"), ("z", "const")])))
    assert rows(MR.same_stem_divergent_role(files, twins), "file_path", "twin") == [("lib/x.ts", "own/x.ts"), ("own/x.ts", "lib/x.ts")]


def test_edge_rules(spark):
    fresh = spark.createDataFrame([("b/n.ts", "a/load.ts"), ("b/n.ts", "shared/k.ts"), ("c/o.ts", "shared/k.ts"), ("b/n.ts", "c/fixtures/f.ts"), ("b/n.test.ts", "c/fixtures/f.ts"), ("s/core.ts", "t/new.ts"), ("a/in.ts", "a/load.ts")], EDGES)
    old = spark.createDataFrame([("c/a.ts", "a/index.ts"), ("c/b.ts", "shared/k.ts"), ("d/x.ts", "s/core.ts"), ("e/x.ts", "s/core.ts"), ("f/x.ts", "s/core.ts")], EDGES)
    edges = old.unionByName(fresh)
    handed = spark.createDataFrame([("a/index.ts", "a/load.ts")], "barrel string, target string")
    assert rows(MR.barrel_bypass(fresh, edges, handed), "file_path", "target", "via_barrel", "direct") == [("b/n.ts", "a/load.ts", 1, 1)]
    assert rows(MR.cross_context_test_reach(fresh), "file_path", "target") == [("b/n.ts", "c/fixtures/f.ts")]
    assert rows(MR.shared_kernel_new_consumer(fresh, edges), "file_path", "target", "areas", "importers") == [("b/n.ts", "shared/k.ts", 1, 1)]
    assert rows(MR.stable_to_volatile_edge(fresh, edges), "file_path", "target", "importers") == [("s/core.ts", "t/new.ts", 3)]
    tests = spark.createDataFrame([("n/new.test.ts", "n/new.ts"), ("n/old.test.ts", "n/mixed.ts"), ("n/new.test.ts", "n/mixed.ts"), ("n/main.ts", "n/new.ts")], EDGES)
    assert rows(MR.self_authored_exam(spark.createDataFrame([("n/new.ts",), ("n/new.test.ts",), ("n/mixed.ts",)], "file_path string"), tests), "file_path", "tests") == [("n/new.ts", ["n/new.test.ts"])]
    files = spark.createDataFrame([("b/n.ts",), ("a/load.ts",), ("shared/k.ts",), ("c/o.ts",), ("c/fixtures/f.ts",)], "file_path string")
    owners = spark.createDataFrame([("CODEOWNERS", "* @all # rest\n/a/ @x\nb/ @y @z\n*.test.ts @t\n/c/**/f.ts @y\n")], "file_path string, source string")
    own = MR.owners_of(files, owners)
    assert rows(own, "file_path", "owners") == [("a/load.ts", ["@x"]), ("b/n.ts", ["@y", "@z"]), ("c/fixtures/f.ts", ["@y"]), ("c/o.ts", ["@all"]), ("shared/k.ts", ["@all"])]
    assert rows(MR.team_boundary_crossing(fresh, edges, own), "file_path", "target", "precedent") == [("b/n.ts", "a/load.ts", 0), ("b/n.ts", "shared/k.ts", 0)]


def test_text_and_import_rules(spark, tree):
    e = spark.createDataFrame([("a/x.ts", "b/use.ts")], EDGES)
    assert rows(MR.import_time_side_effect(tree, e), "file_path", "effects", "importers") == [("b/use.ts", ["fetch('x');"], 1)]
    files = spark.createDataFrame([("a/b/index.ts",), ("a/b/c/d.ts",)], "file_path string")
    imports = spark.createDataFrame([("a/b/c/d.ts", "../../z"), ("a/b/c/d.ts", "../y"), ("a/b/c/d.ts", "zod")], "file_path string, specifier string")
    assert rows(MR.skipped_level_import(imports, files, imports), "specifier", "climb", "barrel") == [("../../z", 2, "a/b/index.ts")]
    deps = spark.createDataFrame([("zod",), ("yup",), ("pino",)], "name string")
    assert rows(MR.second_shelf_dependency(imports, deps), "name", "job", "incumbents") == [("zod", "schema", ["yup"])]


def test_candidates_of_modules_and_changes(spark, tree):
    assert MF.module_candidates(tree).select("file_path").distinct().count() == 6
    changes = spark.createDataFrame([("b.ts", "x\ny", "x"), ("a.ts", "n", None)], "file_path string, source string, old_source string")
    ranges = src.changed_ranges(src.changed_lines(changes))
    assert rows(MF.change_candidate(changes, ranges), "file_path", "start_line", "end_line") == [("b.ts", 2, 2)]
    assert MF.change_candidate(changes.limit(0), ranges.limit(0)).count() == 0


def test_no_item_or_length_is_capped(spark):
    owners = spark.createDataFrame([(k, i) for k in range(65) for i in ("p", "q")], "o long, i string")
    assert similarity.shared_items(owners, "o", "i", 2).count() == 65 * 64 // 2
    wide = spark.createDataFrame([(k, f"i{j:02d}") for k in range(3) for j in range(13)], "o long, i string")
    assert similarity.clumps(wide, "o", "i", 3, 3).count() == 13 * 12 * 11 // 6
    ring = spark.createDataFrame([(str(k), str((k + 1) % 9)) for k in range(9)] + [("in", "0"), ("0", "out")], EDGES)
    changed = spark.createDataFrame([("4",), ("in",), ("out",)], "node string")
    assert rows(relation_rules.import_cycle_tangle(ring, changed), "origin", "length") == [("4", 9)]


def test_blocks_end_where_their_depth_closes(spark):
    source = "function a() {\n  if (x) { y(); }\n  function b() {\n    z(); }}\nclass C {}\nfunction open() {\n"
    found = spans.candidates(spark.createDataFrame([("f", source)], "file_path string, source string"))
    assert rows(found, "kind", "start_line", "end_line") == [("abstraction", 5, 5), ("function", 1, 4), ("function", 3, 4)]
