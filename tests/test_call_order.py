"""Orders between calls and parameters that are only handed on."""

import pytest

from quillspan import api
from quillspan.operators import call_order as CO
from quillspan.sources import files as src

TREE = {
    "db/pool.ts": """let pool;
let size = 0;
export function openPool(url) {
  pool = url;
}
export function query(sql) {
  if (!pool) throw new Error('closed');
  return pool.run(sql);
}
export function grow(n) {
  size = n;
}
export function runOnce(url, sql) {
  openPool(url);
  return query(sql);
}
""",
    "app/a.ts": """import { openPool, query } from '../db/pool';
export function startA(url) {
  openPool(url);
  query(url);
}
""",
    "app/b.ts": """import { openPool, query as ask, grow } from '../db/pool';
export function startB(url) {
  grow(2);
  openPool(url);
  ask(url);
  openPool(url);
}
export function lateB(url) {
  ask(url);
  openPool(url);
}
""",
    "app/c.ts": """import { query } from '../db/pool';
export function onlyC(url) {
  query(url);
}
""",
    "ui/page.tsx": """import { Panel } from './panel';
export function Page({ user, theme: look = 'x' }) {
  return <Panel user={user} look={look} title="a" />;
}
""",
    "ui/panel.tsx": """import { Card } from './card';
export function Panel({ user, look, title }: Props) {
  show(look);
  return <div><Card owner={user} look={look} /></div>;
}
""",
    "ui/card.tsx": """import { badge } from './badge';
export function Card({ owner, look }) {
  badge(1, owner);
}
""",
    "ui/badge.ts": """export function badge(n, who) {
  return who.name + n;
}
export function loopA(x) {
  loopB(x);
}
export function loopB(x) {
  loopA(x);
}
""",
}


@pytest.fixture(scope="module")
def tree(spark):
    return api.Repository(src.ordered(spark.createDataFrame(list(TREE.items()), "file_path string, source string")))


def test_writer_before_reader(tree):
    found = {r.name: r for r in CO.cross_module_call_order(tree.files, tree.functions, tree.calls).collect()}
    assert set(found) == {"startA", "startB"}
    a = found["startA"]
    assert (a.module, a.binding, a.first, a.second) == ("db/pool.ts", "pool", "openPool", "query")
    assert (a.before, a.after, a.without, a.example) == (3, 1, 1, "app/b.ts#lateB") and not a.convention and a.guarded
    assert (a.combined, a.combined_entries) == ("runOnce", 1)


def test_order_support_counts_each_caller_once(spark):
    calls = spark.createDataFrame([(c, t, p) for c, ts in {"w": "ab", "x": "aab", "y": "ba", "z": "b", "v": "a"}.items() for p, t in enumerate(ts)], "caller string, target string, position int")
    asked = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "c")], "first string, second string")
    got = {(r.first, r.second): (r.before, r.after, r.without, r.example) for r in CO.order_support(calls, asked).collect()}
    assert got == {("a", "b"): (2, 1, 1, "y"), ("b", "a"): (1, 2, 1, "v")}
    assert CO.order_support(calls.limit(0), asked).collect() == []


def test_a_prop_through_three_layers(tree):
    """user goes through Page, Panel and Card to badge, which reads it; look is read on the way; a circle has no origin."""
    found = [tuple(r) for r in CO.drilled_prop(tree.functions, tree.calls, tree.imports).collect()]
    assert found == [("ui/page.tsx", "Page", "user", 3, ["Page", "Panel", "Card", "badge"])]
    assert CO.drilled_prop(tree.functions, tree.calls, tree.imports, layers=4).collect() == []


def test_slots_of_parameters(tree):
    got = {(r.name, r.slot, r.parameter) for r in CO.slots(tree.functions).collect()}
    assert {("Page", "0.user", "user"), ("Page", "0.theme", "look"), ("badge", "1", "who"), ("Panel", "0.title", "title")} <= got


def test_paths_keep_one_way_and_end_in_circles(spark):
    steps = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d"), ("q", "q")], "source string, target string")
    got = {(r.origin, r.node): r.path for r in CO.first_paths(steps).collect()}
    assert got == {("a", "a"): ["a"], ("a", "b"): ["a", "b"], ("a", "c"): ["a", "c"], ("a", "d"): ["a", "b", "d"], ("a", "e"): ["a", "b", "d", "e"]}
    assert {k for k in ((r.origin, r.node) for r in CO.first_paths(steps, 1).collect())} == {("a", "a"), ("a", "b"), ("a", "c")}
