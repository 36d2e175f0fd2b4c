"""Rules over functions and calls: what each finds in a small tree, and what it leaves alone."""

import pytest

from quillspan import api
from quillspan.operators import call_rules as CR
from quillspan.operators import relation_evidence as RE
from quillspan.sources import files as src

TREE = {
    "app/order.ts": """import { find } from '../store/orders';
import { gate } from '../guard/access';
import { price } from '../lib/price';
import { charge } from '../lib/pay';
let cache;
export function connectCache(c) {
  cache = c;
}
export function readCache(id) {
  return cache.get(id);
}
export function place(id) {
  const a = find(id);
  return price(a);
}
export function first(id) {
  return second(id);
}
function second(id) {
  return third(id);
}
function third(id) {
  return fourth(id);
}
function fourth(id) {
  const n = id + 1;
  return n;
}
function round(id) {
  return trip(id);
}
function trip(id) {
  return round(id);
}
""",
    "store/orders.ts": """export function find(id) {
  const row = id;
  return row;
}
export async function fetchOrder(id) {
  const row = id;
  return row;
}
export async function fetchOrders(ids) {
  const rows = ids;
  return rows;
}
""",
    "guard/access.ts": """import { find } from '../store/orders';
export function gate(user, id) {
  if (!user) throw new Error('denied');
  const row = find(id);
  return row;
}
""",
    "lib/price.ts": """import { tariff } from './tariff';
export function price(a) {
  return tariff(a);
}
""",
    "lib/tariff.ts": """export function tariff(a) {
  const t = a;
  return t;
}
""",
    "lib/pay.ts": """import { fetchOrder } from '../store/orders';
import { post } from './net';
const seen = new Map();
const small = new Map();
export async function charge(order, force) {
  log.push(order);
  if (!order.id) {
    throw new Error('no id');
  }
  for (let i = 0; i < 3; i++) {
    try { await post(order); } catch (e) { }
  }
  return order;
}
export async function loadAll(ids) {
  const out = [];
  for (const id of ids) {
    const o = await fetchOrder(id);
    out.push(o);
  }
  return out;
}
export function note(order) {
  seen.set(order.id, order);
  metrics.increment('pay.noted');
  metrics.increment('pay.seen');
}
export function keep(order) {
  small.set(order.id, order);
  if (small.size > 9) small.clear();
}
export function quiet(order) {
  if (order.state === 'void') { return null; }
  return order;
}
export async function settle(order) {
  await db.save(order);
  await db.update(order);
}
export function legacyQuiet(order) {
  const x = order;
  return x;
}
""",
    "lib/refund.ts": """import { post } from './net';
import { mode } from './mode';
import { charge } from './pay';
import { readCache } from '../app/order';
export async function refund(o) {
  if (o.state === 'void') { return null; }
  for (;;) {
    try { await post(o); } catch (e) { }
  }
}
export function useA(o) {
  charge(o, true);
  readCache(o);
  return mode(o, 'a');
}
""",
    "lib/more.ts": """import { mode } from './mode';
import { connectCache, readCache } from '../app/order';
import { tick } from './tick';
export function useB(o) {
  connectCache(o);
  readCache(o);
  tick();
  return mode(o, 'b');
}
""",
    "lib/timer.ts": """import { tick } from './tick';
setInterval(tick, 1000);
const watched = ['pay.seen'];
""",
    "lib/tick.ts": """let count = 0;
export function tick() {
  count += 1;
}
""",
    "lib/mode.ts": """/** Two ways. */
export function mode(o, kind) {
  if (kind === 'a') { const x = o; return x; }
  const y = o;
  return y;
}
""",
    "lib/net.ts": """export async function post(o) {
  const r = await send(o);
  return r;
}
""",
    "lib/codec.ts": """export function encodeRow(r) {
  const out = { id: r, total: r };
  return out;
}
export function decodeRow(r) {
  const id = r.id;
  const tax = r.tax;
  return id;
}
export function copy(from, to) {
  const n = same(from, from);
  return n;
}
export function isSame(rowLeft, rowRight) {
  const n = rowLeft;
  return n;
}
export function handleA(req) {
  if (!req.user) throw new Error('who');
  const a = req;
  return a;
}
export function handleB(req) {
  if (!req.user) throw new Error('who');
  const b = req;
  return b;
}
export function handleC(req) {
  var c = req;
  return c;
}
""",
}


@pytest.fixture(scope="module")
def tree(spark):
    return api.Repository(src.ordered(spark.createDataFrame(list(TREE.items()), "file_path string, source string")))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_long_chain_is_told_as_cut(spark):
    hop = lambda k: (f"h{k}", "a.ts", f"function h{k}(x) {{\n  return h{k + 1}(x);\n}}")
    end = ("h12", "a.ts", "function h12(x) {\n  const y = x;\n  return y;\n}")
    ring = [(f"r{k}", "b.ts", f"function r{k}(x) {{\n  return r{(k + 1) % 4}(x);\n}}") for k in range(4)]
    functions = spark.createDataFrame([*map(hop, range(12)), end, *ring], "name string, file_path string, text string")
    calls = functions.selectExpr("file_path", "name as caller", r"regexp_extract(text, 'return (\\w+)\\(', 1) as target", "file_path as owner").where("target <> ''")
    found = {r["name"]: (list(r["chain"]), r["cut"]) for r in CR.hollow_delegation_chain(functions, calls).collect()}
    assert sorted(found) == sorted(f"h{k}" for k in range(10))
    assert all(chain == [f"h{j}" for j in range(k + 1, min(k + 8, 12) + 1)] and cut == (12 - k > 8) for k in range(10) for chain, cut in [found[f"h{k}"]])


def test_chains_and_layers(tree):
    f, c = tree.functions, tree.calls
    assert rows(CR.hollow_delegation_chain(f, c), "name", "chain") == [("first", ["second", "third", "fourth"])]
    assert rows(CR.deep_delegation_chain(f, c), "name", "via", "end_file", "end") == [("place", "price", "lib/tariff.ts", "tariff")]
    assert rows(CR.layer_skipping_call(c, tree.edges, tree.files), "name", "called", "middle") == [("place", "find", "guard/access.ts"), ("place", "find", "lib/pay.ts"), ("refund", "post", "lib/pay.ts")]
    assert [(n, len(x)) for n, x in rows(CR.mixed_responsibilities(f, tree.imports), "name", "collaborators")] == [("place", 2), ("useA", 3), ("useB", 3)]
    assert rows(CR.chatty_interface(f, c), "name", "target", "batch") == [("loadAll", "fetchOrder", "fetchOrders")]


def test_statements_of_one_function(tree):
    f = tree.functions
    assert rows(CR.divergent_inverses(f), "name", "inverse", "writer_only", "reader_only") == [("encodeRow", "decodeRow", ["total"], ["tax"])]
    assert rows(CR.implicit_atomicity(f), "name", "operations", "signals") == [("settle", ["db.save", "db.update"], [])]
    assert rows(CR.pre_gate_side_effect(f), "name", "effects", "gate_line") == [("charge", ["log.push(order);"], 2)]
    assert rows(CR.sibling_identifier_swap(f), "name", "findings", "unused_twins") == [("copy", ["e(from, from)"], []), ("isSame", [], ["rowRight"])]


def test_siblings(tree):
    f = tree.functions
    contract = rows(CR.inconsistent_error_contract(f).where("file_path = 'lib/pay.ts'"), "name", "style", "members")
    assert contract == [("charge", "null", ["quiet"]), ("quiet", "throws", ["charge"])]
    assert rows(CR.repeated_handler_preamble(f), "name", "repetitions") == [("handleA", 2), ("handleB", 2)]
    assert rows(CR.scattered_policy(f), "file_path", "name", "files") == [("lib/pay.ts", "quiet", 2), ("lib/refund.ts", "refund", 2)]
    assert rows(CR.convention_breaking_addition(f, tree.files).where("file_path = 'lib/codec.ts'"), "name") == [("handleC",)]
    assert rows(CR.retry_storm_shape(f, tree.imports), "name", "dependency", "files") == [("charge", "lib/net.ts", 2), ("refund", "lib/net.ts", 2)]


def test_shared_state(tree):
    f, c, files = tree.functions, tree.calls, tree.files
    assert rows(CR.temporal_call_coupling(files, f, c), "name", "binding", "writers", "callers", "alone") == [("readCache", "cache", ["connectCache"], 2, 1)]
    assert rows(CR.hidden_initialization_order(files, f, c), "name", "writer", "callers", "writer_callers") == [("readCache", "connectCache", 2, 1)]
    assert rows(CR.reentrant_entry(files, f, c, tree.imports), "name", "bindings", "callers", "registrations") == [("tick", ["count"], 1, 1)]
    assert rows(CR.unbounded_accumulation(files, f), "name", "container") == [("note", "seen")]


def test_callers(tree):
    f, c, files = tree.functions, tree.calls, tree.files
    assert rows(CR.unmarked_abandoned_compat_layer(f, c, files), "name", "successor") == [("legacyQuiet", "quiet")]
    contract = {r.name: (r.documented, r.throws, r.caller_files, r.opaque_calls) for r in CR.undocumented_contract(f, c, files).collect()}
    assert contract["charge"] == (False, ["Error"], 1, 1) and contract["mode"][0] is True
    assert rows(CR.unconsumed_telemetry(f, files), "name", "event") == [("note", "pay.noted")]
    assert [(n, p, [tuple(a) for a in x]) for n, p, x in rows(CR.variant_partitioned_helper(f, c), "name", "parameter", "arms")] == [("mode", "kind", [("a", 1), ("b", 1)])]


def test_rules_reach_a_report(spark, tree):
    names = list(RE.call_evidence(tree))
    rules = spark.createDataFrame([r for r in api.default_rules() if r[0] in {RE.rule_id(n) for n in names}], "rule_id string, scope string, category string, message string")
    assert rules.count() == len(names)
    told = {r.rule_id.split("/")[1] for r in api.audit(tree, rules).judgments.select("rule_id").distinct().collect()}
    assert told == set(names)


def test_empty_relations_abstain(spark, tree):
    empty = api.Repository(tree.files.limit(0))
    for name, make in RE.call_evidence(empty).items():
        assert make().count() == 0, name
