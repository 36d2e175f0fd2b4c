"""Identifiers by place, references of functions, units of a tree and what reaches over their borders."""

import pytest
from pyspark.sql import functions as F

from quillspan import api
from quillspan.operators import references as RF
from quillspan.operators import relation_rules as RR
from quillspan.operators import units as UN
from quillspan.sources import files as src

TREE = {
    "package.json": '{"name": "root", "devDependencies": {"jest": "1"}}',
    "svc/pay/package.json": '{"name": "@x/pay", "dependencies": {"zod": "3", "ky": "1"}}',
    "svc/mail/package.json": '{"name": "@x/mail"}',
    "svc/broken/package.json": "[1]",
    "svc/pay/index.ts": "export { charge } from './src/charge';\n",
    "svc/pay/src/charge.ts": """import { z } from 'zod';
import ky from 'ky';
import {
  send,
  queue as enqueue,
} from '../../mail/src/send';
import * as tools from './tools';
export function charge(order) {
  // send(order) is no call, "send" is no name
  orders.map(send);
  tools.round(order, 1);
  return enqueue(order);
}
export const idle = (a) => a;
function alone(x) { return x; }
const handlers = { alone };
""",
    "svc/pay/src/tools.ts": "import { z } from 'zod';\nexport function round(n, k) {\n  return n;\n}\nexport function never(n) {\n  return n;\n}\n",
    "svc/mail/src/send.ts": "export function send(m) {\n  return m;\n}\nexport function queue(m) {\n  return m;\n}\n",
    "svc/mail/src/use.ts": "import { charge } from '@x/pay';\nimport { test } from 'jest';\nimport { idle } from '@x/pay/src/charge';\nexport const run = (m) => charge(m);\n",
    "svc/broken/a.ts": "import { send } from '../mail/src/send';\nimport own from 'broken';\nsend(1);\n",
}


def tree_of(spark, rows):
    return api.Repository(src.ordered(spark.createDataFrame(list(rows.items()), "file_path string, source string")))


@pytest.fixture(scope="module")
def tree(spark):
    return tree_of(spark, TREE)


def test_identifiers_by_kind(tree):
    got = {(r.name, r.line_number): r.kind for r in tree.postings.where("file_path = 'svc/pay/src/charge.ts'").collect()}
    assert got[("charge", 8)] == "declared" and got[("send", 10)] == "value" and got[("map", 10)] == "member" and got[("enqueue", 12)] == "called" and got[("alone", 16)] == "value"
    assert not any(line in (1, 2, 3, 4, 5, 6, 7, 9) for _, line in got)


def test_functions_named_as_values(tree):
    got = {(r.owner, r.target, r.file_path, r.line_number, r.kind) for r in RF.function_references(tree.functions, tree.imports, tree.postings).collect()}
    charge, send = "svc/pay/src/charge.ts", "svc/mail/src/send.ts"
    assert got == {(send, "send", charge, 10, "value"), (send, "queue", charge, 12, "called"), (charge, "alone", charge, 16, "value"), (send, "send", "svc/broken/a.ts", 3, "called")}
    first = RF.first_references(RF.function_references(tree.functions, tree.imports, tree.postings), 1).where("target = 'send'").collect()
    assert [(r.file_path, r.total) for r in first] == [("svc/broken/a.ts", 2)]


def test_a_callback_is_used(tree):
    unused = lambda *more: {r.name for r in RR.unused_exported_helper(tree.functions, tree.calls, *more).collect()}
    assert "send" in unused() and "send" not in unused(tree.references) and {"never", "idle"} <= unused(tree.references)


def test_calls_through_a_namespace(tree):
    got = {(r.caller, r.owner, r.target, r.arguments) for r in tree.calls.where("target = 'round'").collect()}
    assert got == {("charge", "svc/pay/src/tools.ts", "round", "order, 1")}


def test_nearest_unit(spark):
    paths = spark.createDataFrame([("a/b/c/f.ts",), ("a/b/g.ts",), ("ab/h.ts",), ("top.ts",), ("a/b/c/f.ts",)], "path string")
    near = lambda *dirs: {r.path: r.unit for r in UN.nearest(paths, spark.createDataFrame([(d,) for d in dirs], "unit string")).collect()}
    assert near("a", "a/b/c", "") == {"a/b/c/f.ts": "a/b/c", "a/b/g.ts": "a", "ab/h.ts": "", "top.ts": ""}
    assert near("a", "a/b/c/f.ts") == {"a/b/c/f.ts": "a", "a/b/g.ts": "a"} and near() == {}


def test_facts_of_the_nearest_manifest(tree):
    got = {(r.file_path, r.package): (r.unit, r.section, r.siblings, r.n_siblings) for r in UN.manifest_facts(tree.files, tree.imports).collect()}
    assert got == {
        ("svc/pay/src/charge.ts", "zod"): ("svc/pay", "dependencies", ["svc/pay/src/tools.ts"], 1), ("svc/pay/src/tools.ts", "zod"): ("svc/pay", "dependencies", ["svc/pay/src/charge.ts"], 1),
        ("svc/pay/src/charge.ts", "ky"): ("svc/pay", "dependencies", [], 0), ("svc/mail/src/use.ts", "@x/pay"): ("svc/mail", None, [], 0), ("svc/mail/src/use.ts", "jest"): ("svc/mail", None, [], 0),
        ("svc/broken/a.ts", "broken"): ("", None, [], 0),
    }


def test_reach_into_another_unit(tree):
    edges = tree.edges.select("source", "target").distinct()
    got = {tuple(r) for r in UN.cross_service_source_reach(edges, tree.imports, tree.files).collect()}
    assert got == {
        ("svc/pay/src/charge.ts", "svc/mail/src/send.ts", "svc/pay", "svc/mail", "relative", False), ("svc/broken/a.ts", "svc/mail/src/send.ts", "", "svc/mail", "relative", False),
        ("svc/mail/src/use.ts", "@x/pay", "svc/mail", "svc/pay", "workspace-package", True), ("svc/mail/src/use.ts", "@x/pay/src/charge", "svc/mail", "svc/pay", "workspace-package", False),
    }
    one = tree.files.where(~F.col("file_path").isin("svc/mail/package.json", "package.json"))
    assert UN.cross_service_source_reach(edges, tree.imports, one).collect() == []


def test_a_host_that_nobody_knows(spark):
    old = {"a.ts": "call('https://old.io/x');\n", "lib/http.ts": "export const get = (u) => fetch(u);\n", "b.ts": "import { get } from './lib/http';\nget(1);\n", "c.ts": "import { get } from './lib/http';\n"}
    new = old | {"a.ts": old["a.ts"] + "fetch('https://New.io:8080/x', { signal });\nconst u = 'http://localhost/';\n", "b.ts": old["b.ts"] + "const v = 'https://old.io/';\nfetch(v);\n", "c.ts": old["c.ts"] + "axios('https://other.io');\n"}
    before, after = tree_of(spark, old), tree_of(spark, new)
    got = {r.file_path: (r.host, r.care, r.uses_wrapper) for r in UN.unwrapped_service_edge(before.files, after.files, after.imports).collect()}
    assert got == {"a.ts": ("new.io:8080", ["signal"], False), "c.ts": ("other.io", [], True)}
