"""Line diffs, kinds of hunks, and rules over functions before and after a change."""

import random

import pytest

from quillspan import api
from quillspan.operators import change_rules as CH
from quillspan.sources import files as src
from quillspan.sources.diff import common_lines, hunks_of, line_hunks

CHANGES = "file_path string, source string, old_source string"


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_common_lines_are_a_longest_subsequence(seed):
    r = random.Random(seed)
    old = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 30))]
    new = [x for x in old if r.random() < 0.8] if seed % 2 else [r.choice("abce") for _ in range(r.randint(0, 30))]
    r.shuffle(new) if seed % 3 == 0 else None
    pairs = common_lines(old, new)
    assert len(pairs) == longest(old, new) and all(old[i] == new[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    again, at = [], 0
    for h in hunks_of(old, new):
        again += new[at : at + h["new_at"] - 1 - at] + h["new_lines"]
        at = h["new_at"] - 1 + len(h["new_lines"])
    assert again + new[at:] == new


def lines(*groups):
    return "\n".join(x for g in groups for x in g)


HEAD, BLOCK, TAIL = ["import a", "", "const z = 1;"], ["function moved() {", "  const q = open();", "  q.close();", "}"], [f"keep({k});" for k in range(6)]


def test_a_moved_block_is_a_change(spark):
    rows = [("m.ts", lines(HEAD, TAIL, BLOCK), lines(HEAD, BLOCK, TAIL)), ("new.ts", "x", None), ("gone.ts", None, "y"), ("same.ts", "s", "s"), ("empty.ts", "", "a\nb")]
    changes = spark.createDataFrame(rows, CHANGES)
    hunks = line_hunks(changes)
    got = {(r.file_path, r.hunk): (r.old_at, r.old_lines, r.new_at, r.new_lines) for r in hunks.collect()}
    assert got[("m.ts", 0)] == (4, BLOCK, 4, []) and got[("m.ts", 1)] == (14, [], 10, BLOCK)
    assert got[("new.ts", 0)] == (1, [], 1, ["x"]) and got[("gone.ts", 0)] == (1, ["y"], 1, []) and got[("empty.ts", 0)] == (1, ["a", "b"], 1, [""])
    assert not any(f == "same.ts" for f, _ in got)
    assert [tuple(r) for r in CH.moved_blocks(hunks).collect()] == [("m.ts", 1, "m.ts", 0, 4)]
    assert sorted(r.line_number for r in src.changed_lines(changes).where("file_path = 'm.ts'").collect()) == [10, 11, 12, 13]
    assert line_hunks(changes.limit(0)).collect() == []


OLD = """export function total(order) {
  let sum = 0;
  for (const line of order.lines) {
    sum += line.price;
  }
  return sum;
}
export function label(order) {
  return order.name;
}
"""
NEW = """export function total(basket) {
  let sum = 0;
  for (const line of basket.lines) {
    sum += line.price;
  }

  return sum;
}
export function label(order) {
  return order.name.trim() || fallback(order);
}
"""


def test_kinds_of_hunks(spark):
    changes = spark.createDataFrame([("a.ts", NEW, OLD), ("b.ts", lines(HEAD, TAIL, BLOCK), lines(HEAD, BLOCK, TAIL)), ("c.ts", "x", None)], CHANGES)
    hunks = line_hunks(changes)
    kinds = {(r.file_path, r.start): r.kind for r in CH.hunk_kinds(hunks, changes).collect()}
    assert kinds == {("a.ts", 1): "renamed", ("a.ts", 3): "renamed", ("a.ts", 6): "blank", ("a.ts", 10): "real", ("b.ts", 10): "moved", ("c.ts", 1): "added"}
    found = {r.file_path: tuple(r)[1:] for r in CH.entangled_mechanical_change(hunks, changes).collect()}
    assert found == {"a.ts": (3, 1, 3, 1, 0, True), "b.ts": (1, 0, 4, 0, 1, False)}
    real = spark.createDataFrame([("a.ts", "const b = 2;\n", "const a = () => 1;\n")], CHANGES)
    assert CH.entangled_mechanical_change(line_hunks(real), real).collect() == []


def repository(spark, rows):
    return api.Repository(src.ordered(spark.createDataFrame(rows, "file_path string, source string")))


LONG = """export function handle(order) {
  if (order.paid) {
    for (const line of order.lines) {
      if (line.open) {
        ship(line.item);
        notify(line.owner);
      }
    }
  }
  return order;
}
export function oldName(value) {
  const doubled = value * two;
  return doubled + offset;
}
"""
SPLIT = """export function handle(order) {
  if (order.paid) shipAll(order);
  return order;
}
function shipAll(order) {
  for (const line of order.lines) {
    if (line.open) {
      ship(line.item);
      notify(line.owner);
    }
  }
}
export function unrelated(x) {
  const other = compute(x);
  return other;
}
"""
MOVED = """export function newName(value) {
  const doubled = value * two;
  return doubled + offset;
}
"""


def test_a_split_function_is_moved_complexity(spark):
    before, after = repository(spark, [("a.ts", LONG), ("b.ts", "x")]), repository(spark, [("a.ts", SPLIT), ("b.ts", MOVED)])
    same = CH.matched_functions(CH._measured(before.functions), CH._measured(after.functions))
    assert sorted(map(tuple, same.collect())) == [("a.ts", "handle", "a.ts", "handle"), ("a.ts", "oldName", "b.ts", "newName")]
    (row,) = CH.complexity_displacement(before.functions, after.functions).collect()
    assert (row.file_path, row.name, row.before, row.after, [m.to for m in row.moved_to]) == ("a.ts", "handle", 12, 0, ["shipAll"])
    assert row.after_in_all == 6
    assert CH.complexity_displacement(after.functions, after.functions).collect() == []


APART = """export function price(a) {
  return fee(a) + 1;
}
function fee(a) {
  return a;
}
export function title(b) {
  return b;
}
export function untouched(c) {
  return c;
}
"""


def test_hunks_for_different_reasons(spark):
    now = APART.replace("+ 1", "+ 2").replace("return a;", "return a * 2;").replace("return b;", "return b.t;")
    users = [("u.ts", "import { price } from './m';\nexport function u(a) {\n  price(a);\n}\n"), ("v.ts", "import { title } from './m';\nexport function v(a) {\n  title(a);\n}\n")]
    tree = repository(spark, [("m.ts", now), *users])
    changes = spark.createDataFrame([("m.ts", now, APART)], CHANGES)
    spans = tree.functions.join(tree.texts.select("file_path", "id", "end_line"), ["file_path", "id"])
    (row,) = CH.divergent_change(line_hunks(changes), spans, tree.calls).collect()
    assert (row.file_path, row.groups, row.functions, row.hunks) == ("m.ts", 2, [["fee", "price"], ["title"]], 3)
    one = repository(spark, [("m.ts", now), users[0], ("v.ts", users[1][1] + users[0][1].replace("function u", "function w"))])
    assert CH.divergent_change(line_hunks(changes), spans, one.calls).collect() == []
