"""Sets of values that hold one another, and values that are written down again."""

import random

import pytest

from quillspan import api
from quillspan.operators import enumerations as EN
from quillspan.operators import similarity as S
from quillspan.sources import files as src

TREE = {
    "a/state.ts": """export type State = 'open' | 'paid' | "void"; // | 'no'
export enum Level { Low = 'low', High, Mid = "mid" }
""",
    "b/state.ts": """export type Stage =
  | 'open'
  | 'paid'
  | 'sent'
  | 'void';
export const LEVELS: string[] = ['low', 'mid', 'High'];
const ONE = ['x'];
""",
    "c/all.ts": "const EVERY = new Set<string>(['open', 'paid', " + ", ".join(f"'v{k}'" for k in range(300)) + "]);\nexport type Pair = 'open' | 'paid';\n",
    "config/env.ts": "export const url = process.env.URL;\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    return api.Repository(src.ordered(spark.createDataFrame(list(TREE.items()), "file_path string, source string")))


def test_sets_of_values(tree):
    got = {}
    for r in EN.value_sets(tree.files).collect():
        got.setdefault((r.name, r.kind), set()).add(r.value)
    assert len(got.pop(("EVERY", "list"))) == 302
    assert got == {
        ("State", "union"): {"open", "paid", "void"}, ("Level", "enum"): {"low", "High", "mid"}, ("Stage", "union"): {"open", "paid", "sent", "void"},
        ("LEVELS", "list"): {"low", "mid", "High"}, ("Pair", "union"): {"open", "paid"},
    }


def test_a_set_inside_one_of_a_hundred_times_its_size(tree):
    rows = [(r.type_name, r.other, r.only_here, r.one_holds_the_other) for r in EN.parallel_enumerations(EN.value_sets(tree.files)).collect()]
    got = {r[0]: r[1:] for r in rows}
    assert got["State"] == ("Stage", [], True) and got["Stage"] == ("State", ["sent"], True) and got["Pair"] == ("State", [], True)
    assert got["EVERY"][0] == "Pair" and "Level" not in got and "LEVELS" not in got


def test_containment_against_all_pairs(spark):
    r = random.Random(9)
    sets = {k: frozenset(r.sample(range(9), r.randint(1, 7))) for k in range(60)} | {99: frozenset(range(2000)), 98: frozenset([0])}
    rows = [(k, v) for k, s in sets.items() for v in s] * 2 + [(None, 1), (5, None)]
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    for least in (1, 2, 4):
        found = [tuple(x) for x in S.contained_sets(spark.createDataFrame(rows, "o long, i long"), "o", "i", least).collect()]
        expected = {(first[a], first[b], len(a), len(b)) for a in first for b in first if len(a) >= least and a < b}
        assert set(found) == expected and len(found) == len(expected) and any(x[1] == 99 for x in found)


def test_values_written_again(tree, spark):
    lines = spark.createDataFrame([("x.ts", "if (s === 'open' || s === 'void') {"), ("x.ts", "t = 'sent'"), ("y.ts", "one = 'open'"), ("b/state.ts", "  | 'open' | 'sent'")], "file_path string, line string")
    edges = spark.createDataFrame([("x.ts", "b/state.ts")], "source string, target string")
    assert [tuple(r) for r in EN.string_duplicated_enumeration(lines, tree.files, edges).collect()] == [("x.ts", "b/state.ts", "Stage", 3, True)]


def test_reads_past_the_configuration(tree, spark):
    lines = spark.createDataFrame([("x.ts", "const u = process.env.URL ?? process.env['KEY'];"), ("old.ts", "process.env.OLD"), ("config/more.ts", "process.env.MORE"), ("x.test.ts", "process.env.T")], "file_path string, line string")
    before = spark.createDataFrame([("old.ts", "a = process.env.OLD;")], "file_path string, source string")
    edges = spark.createDataFrame([("x.ts", "config/env.ts")], "source string, target string")
    after = tree.files.select("file_path", "source").unionByName(before)
    got = sorted(map(tuple, EN.duplicate_config_source(lines, before, after, edges).collect()))
    assert got == [("x.ts", "KEY", "config/env.ts", False, True, 1), ("x.ts", "URL", "config/env.ts", True, True, 1)]
    assert EN.duplicate_config_source(lines, before, before, edges).collect() == []
