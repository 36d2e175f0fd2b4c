"""Shapes of functions, their near relations, and the rules that compare functions by them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspan import api
from quillspan.functions.text import code_lines, code_only, split_top
from quillspan.operators import call_rules as CR
from quillspan.operators import review as R
from quillspan.operators import shape as S
from quillspan.sources import files as src

TREE = {
    "pay/fees.ts": """import { tax } from './tax';
export function feeOf(order: Order, rate: number): number {
  const base = order.amount * rate;
  if (base > 'cap') {
    return limitOf(base);
  }
  for (const extra of order.extras) {
    base2(extra);
  }
  return base;
}
export function limitOf(value: number): number {
  return value;
}
""",
    "pay/tax.ts": """export function tax(input: Order, percent: number): number {
  let total = 0;
  input.lines.forEach((line) => {
    total += line.price;
  });
  total = total * percent;
  return Math.round(total);
}
""",
    "zoo/animals.ts": """export function herdOf(zoo, keeper) {
  const pen = zoo.pens.get(keeper);
  // a pen { may be missing
  if (!pen) {
    throw new Error("no pen }");
  } else {
    keeper.visit(pen);
  }
  for (const one of pen.animals) one.feed(`now
 {`);
  return pen;
}
export function nothing() {}
""",
}


@pytest.fixture(scope="module")
def tree(spark):
    return api.Repository(src.ordered(spark.createDataFrame(list(TREE.items()), "file_path string, source string")))


def shapes(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    return [r.s for r in df.select("k", S.shape_of(F.col("text")).alias("s")).orderBy("k").collect()]


def test_kinds_of_statements(spark):
    assert shapes(
        spark, "const f = (a) => a + 1;", "const g = (a) => {\n  throw a;\n}", "function q() {}", "function h() { const a = 1; return a; }",
        "async function m(\n  a,\n  b,\n) {\n  try {\n    await a();\n  } catch (e) {\n    b();\n  }\n  switch (a) {\n    case 1: break;\n  }\n  foo(\n    1,\n  )\n    .then(b);\n}", "", None,
    ) == ["P", "X", "", "VR", "TSE", "", ""]


def test_strings_and_comments_hold_no_code(spark):
    texts = ["a('{') // {\nb(\"it's }\") /* { \n */ + `x ${\n'}'} {`", '"' + "x" * 200_000 + '"' + "/*" + "* z" * 100_000 + "*/", "'open\nb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(code_only(F.col("t"))).collect()]
    assert got == ["a('') \nb(\"\")  + ``", '""', "'open\nb"]
    kept = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(code_lines(F.col("t"))).collect()]
    assert kept == ["a() \nb() \n + \n", "", "'open\nb"]


def test_parts_of_a_list(spark):
    got = spark.range(1).select(split_top(F.lit("a, f(1, g(2, 3)), {x: [1, 2], y}, 'p, q'")), split_top(F.lit("  "))).first()
    assert list(got) == [["a", "f(1, g(2, 3))", "{x: [1, 2], y}", "'p, q'"], []]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _row(row, i, x, b)
    return row[-1]


def _row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def test_shapes_with_a_common_stretch_meet(spark):
    """Every near pair with WINDOW + RUN - 1 letters in common in a row is found, and none beyond the bound."""
    r = random.Random(5)
    made = {"".join(r.choice("EVIR") for _ in range(r.randint(3, 14))) for _ in range(120)}
    made |= {s[:k] + "X" + s[k:] for s in list(made)[:60] for k in (0, len(s))}
    found = {(x.left, x.right): x.distance for x in S.near_shapes(spark.createDataFrame([(s,) for s in made for _ in range(2)], "shape string")).collect()}
    stretch = S.WINDOW + S.RUN - 1
    for a, b in itertools.combinations(sorted(made), 2):
        near = edits(a, b) <= max(len(a), len(b)) // S.NEAR
        common = any(a[i : i + stretch] in b for i in range(len(a) - stretch + 1))
        assert not (near and common) or found.get((a, b)) == edits(a, b)
        assert near or (a, b) not in found


def test_a_shape_of_all_functions_meets_few(spark):
    """Functions of one shape are compared with the first PARTNERS of it, not with each other."""
    rows = [(f"f{k:03d}.ts", f"fn{k}", "VIRE", [], [], [], None, []) for k in range(300)]
    found = spark.createDataFrame(rows, "file_path string, name string, shape string, members array<string>, literals array<string>, tokens array<string>, signature string, users array<string>")
    none = spark.createDataFrame([], "source string, target string")
    pairs = S.lookalikes(found, none).collect()
    assert len(pairs) == 300 * S.PARTNERS - S.PARTNERS and {p.alike for p in pairs} == {300}


def test_lookalikes_that_have_nothing_in_common(tree):
    out = S.coincidental_similarity(tree.functions, tree.calls, tree.edges)
    got = {(r.name, r.other): r for r in out.collect()}
    pair = got[("feeOf", "herdOf")]
    assert pair.same_order and pair.distance == 0 and "feed" in pair.other_members and pair.alike == 2 and not pair.same_directory
    assert ("nothing", "herdOf") not in got and ("limitOf", "feeOf") not in got
    assert S.coincidental_similarity(tree.functions.limit(0), tree.calls, tree.edges).collect() == []


def test_one_task_in_other_words(tree):
    out = [tuple(r) for r in S.paraphrased_sibling_logic(tree.functions, tree.calls, tree.edges).select("name", "other", "signature", "shared_members").collect()]
    assert sorted(out) == [("feeOf", "tax", "order,number|number", []), ("tax", "feeOf", "order,number|number", [])]


def test_packing_does_not_hold_a_group(spark):
    """Batches of a group that spans many Arrow batches, against a plain fold."""
    r = random.Random(2)
    rows = [(k % 3 if k % 7 else None, k, r.randint(0, 900)) for k in range(25_000)]
    got = R.batches(spark.createDataFrame(rows, "g long, k long, n long"), "g", ["k"], "n", 24, 8000).collect()
    expected = {}
    for g in (None, 0, 1, 2):
        batch, held, used = 0, 0, 0
        for _, k, n in [x for x in rows if x[0] == g]:
            if held and (held == 24 or used + n > 8000):
                batch, held, used = batch + 1, 0, 0
            held, used = held + 1, used + n
            expected[k] = batch
    assert {x.k: x.batch for x in got} == expected


def test_preamble_after_blank_lines_and_comments(spark):
    texts = [("a.ts", f"h{k}", ["q"], True, "export function h(q) {\n" + "\n" * k + "  // who asks\n  if (!q) throw q;\n  go();\n}") for k in (0, 7)]
    functions = spark.createDataFrame(texts, "file_path string, name string, parameters array<string>, exported boolean, text string")
    assert sorted(r.name for r in CR.repeated_handler_preamble(functions).collect()) == ["h0", "h7"]
