"""Circles in directed graphs and parts of classes."""

import math
import random
from collections import defaultdict

import pytest

from quillspan import api
from quillspan.operators import classes as CL
from quillspan.operators import similarity as S
from quillspan.operators import graph as G
from quillspan.operators import relation_rules as RR
from quillspan.sources import files as src

TREE = {
    "svc/report.ts": """export class Report extends Base {
  private rows = [];
  title = "a {";
  static made = 0;
  constructor(a, b) {
    this.rows = a;
    this.title = b;
    this.cache = {};
  }
  static of(a) {
    return new Report(a);
  }
  add(row) {
    if (row) {
      this.rows.push(row);
    }
  }
  get total(): number {
    return this.rows.length;
  }
  async rename(title: string): Promise<void> {
    this.title = title;
  }
  print() {
    return this.shown();
  }
  private shown() {
    return `${this.title}`;
  }
}
""",
    "svc/tight.ts": """class Tight {
  a() {
    return this.x;
  }
  b() {
    return this.x + this.a();
  }
  c() {
    this.b();
  }
}
""",
    "use/one.ts": """import { Report } from '../svc/report';
const r: Report = Report.of(1);
r.add(2);
r.add(3);
""",
    "use/two.ts": """import { Report } from '../svc/report';
export const f = (r: Report) => r.rename('x').then(() => r.print());
""",
    "use/two.test.ts": "import { Report } from '../svc/report';\nnew Report().add(1).print();\n",
    "use/other.ts": "list.add(1); list.print();\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    return api.Repository(src.ordered(spark.createDataFrame(list(TREE.items()), "file_path string, source string")))


def test_methods_of_classes(tree):
    got = {(r.type_name, r.method): (r.static, r.hidden, r.text.count("\n")) for r in CL.methods_of(tree.texts).collect()}
    assert got == {
        ("Report", "constructor"): (False, False, 4), ("Report", "of"): (True, False, 2), ("Report", "add"): (False, False, 4), ("Report", "total"): (False, False, 2),
        ("Report", "rename"): (False, False, 2), ("Report", "print"): (False, False, 2), ("Report", "shown"): (False, True, 2),
        ("Tight", "a"): (False, False, 2), ("Tight", "b"): (False, False, 2), ("Tight", "c"): (False, False, 2),
    }


def test_classes_that_fall_apart(tree):
    methods = CL.methods_of(tree.texts)
    (row,) = CL.low_cohesion_class(methods).collect()
    assert (row.type_name, row.n_parts, row.n_methods) == ("Report", 2, 5)
    assert [(p.n, p.methods) for p in row.parts] == [(3, ["print", "rename", "shown"]), (2, ["add", "total"])]
    assert CL.low_cohesion_class(methods.limit(0)).collect() == []


def test_clients_that_share_no_method(tree):
    (row,) = CL.partitioned_fat_interface(CL.methods_of(tree.texts), tree.files).collect()
    assert (row.type_name, row.n_parts, row.parts, row.n_clients) == ("Report", 2, [["add", "of"], ["print", "rename"]], 2)


def test_parts_stay_inside_their_owner(spark):
    r = random.Random(3)
    rows = list({(r.randrange(6), r.randrange(8), r.choice([None, *range(12)])) for _ in range(120)})
    got = {(x.owner, x.item): x.part for x in S.parts(spark.createDataFrame(rows, "owner long, item long, feature long"), ["owner"], "item", "feature").collect()}
    expected = {}
    for owner in range(6):
        mine = [(i, f) for o, i, f in rows if o == owner]
        label = {i: i for i, _ in mine}
        for _ in mine:
            by = defaultdict(list)
            for i, f in mine:
                if f is not None:
                    by[f].append(label[i])
            for i, f in mine:
                if f is not None:
                    label[i] = min(label[i], *by[f])
        expected |= {(owner, i): p for i, p in label.items()}
    assert got == expected


def reached(edges):
    out = defaultdict(set)
    for s, t in edges:
        out[s].add(t)
    all_ = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            for n in out[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        all_[s] = seen
    return all_


@pytest.mark.parametrize("density", [40, 70, 130])
def test_components_against_reachability(spark, density):
    r = random.Random(density)
    edges = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(density)] + [("self", "self")]
    got = defaultdict(set)
    for x in G.strong_components(spark.createDataFrame(edges, "source string, target string")).collect():
        got[x.root].add(x.node)
    reach = reached(edges)
    expected = {frozenset(t for t in reach[s] if s in reach[t]) for s in reach if s in reach[s]}
    assert {frozenset(v) for v in got.values()} == expected
    assert all(root in nodes for root, nodes in got.items())


def test_no_circle(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(60)], "source long, target long")
    assert G.strong_components(path).collect() == [] and G.strong_components(path.limit(0)).collect() == []


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    """10,000 files in one ring, against their order: rounds grow with the logarithm, rows with the edges."""
    n, rounds, stored = 10_000, [], G.stored
    monkeypatch.setattr(G, "stored", lambda df: rounds.append(1) or stored(df))
    edges = spark.createDataFrame([((k + 1) % n, k) for k in range(n)], "source long, target long")
    changed = spark.createDataFrame([(k,) for k in (0, 77, n - 1)], "node long")
    assert sorted(map(tuple, RR.import_cycle_tangle(edges, changed).collect())) == [(0, n), (77, n), (n - 1, n)]
    assert len(rounds) < 4 * math.log2(n)
