"""Classes against what they inherit, types against what they are built on, edges into foreign state and second gateways."""

import pytest
from pyspark.sql import functions as F

from quillspan import api
from quillspan.operators import classes as CL
from quillspan.operators import units as UN
from quillspan.sources import files as src

TREE = {
    "core/store.ts": """export class Store<T> {
  get(id) {
    return this.rows[id];
  }
  put(id, row) {
    this.rows[id] = row;
  }
  clear() {}
}
export class Frozen extends Store<string> implements Closeable, Named<T> {
  put(id, row): void {
    // never
    throw new Error("frozen }");
  }
  clear() {}
  close(now) {
    this.x = now;
  }
}
""",
    "core/more.ts": """import { Store as Base } from './store';
import { Row } from '../wip/row';
import { Id } from './ids';
export class Plain extends Base implements Closeable {
  put(id, row) {
    return super.put(id, row);
  }
  close() {
    return 1;
  }
}
export class Third implements Closeable {
  close(now) { return now; }
}
export interface Shape {
  row: Row;
  id: Id;
}
""",
    "core/ids.ts": "export type Id = string;\n",
    "wip/row.ts": "export type Row = {};\nexport let count = 0;\nexport const cache = {};\nexport function setCount(n) {\n  count = n;\n}\n",
    "use/a.ts": "import { Plain } from '../core/more';\nimport { count, cache, setCount as put } from '../wip/row';\nimport axios from 'axios';\nput(1);\nconst local = 1;\ncache.x['y'] = 2;\ncache.list.push(3);\nif (count == 2 || count >= 3) local;\nconst f = (count) => 1;\n",
    "use/b.ts": "import { Plain } from '../core/more';\nimport { Id } from '../core/ids';\nimport * as row from '../wip/row';\nrow.count++;\n",
    "use/c.ts": "import { send } from '../net/http';\nimport { Id } from '../core/ids';\n",
    "net/http.ts": "import axios from 'axios/lib';\nexport const send = axios;\n",
    "net/http.test.ts": "import axios from 'axios';\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    return api.Repository(src.ordered(spark.createDataFrame(list(TREE.items()), "file_path string, source string")))


def test_inheritance_that_is_refused(tree):
    heritage, methods = CL.heritage_of(tree.texts), CL.methods_of(tree.texts)
    assert {(r.type_name, r.base, r.face) for r in heritage.collect()} == {("Store", None, None), ("Frozen", "Store", "Closeable"), ("Frozen", "Store", "Named"), ("Plain", "Base", "Closeable"), ("Third", None, "Closeable")}
    assert [tuple(r) for r in CL.refused_inheritance(heritage, methods, tree.imports).collect()] == [("core/store.ts", "Frozen", "core/store.ts", "Store", 3, 2, ["put"])]


def test_siblings_that_differ(tree):
    got = [tuple(r) for r in CL.divergent_sibling_interfaces(CL.heritage_of(tree.texts), CL.methods_of(tree.texts)).collect()]
    assert got == [("core/more.ts", "Plain", "Closeable", "close", 0, 1, 3)]


def test_types_built_on_less_stable_ones(tree):
    got = [tuple(r) for r in CL.stability_inversion(tree.texts, tree.imports, tree.edges).collect()]
    assert sorted(got) == [("core/more.ts", "Plain", "core/store.ts", "Base", 2, 1, False), ("core/more.ts", "Shape", "wip/row.ts", "Row", 2, 3, True)]


def test_writes_to_new_imports(tree):
    edges = tree.edges.select("source", "target").distinct()
    got = {(r.file_path, r.local): (r.target, r.writes, r.mutable, r.offers_setter) for r in UN.new_foreign_state_write_edge(edges, tree.imports, tree.files).collect()}
    assert got == {("use/a.ts", "cache"): ("wip/row.ts", ["cache.list.push(", "cache.x[] ="], False, True), ("use/b.ts", "row"): ("wip/row.ts", ["row.count++"], True, True)}
    assert UN.new_foreign_state_write_edge(edges.limit(0), tree.imports, tree.files).collect() == []


def test_a_second_gateway(tree):
    new = tree.imports.where(F.col("file_path") == "use/a.ts")
    got = [(r.file_path, r.dependency, [tuple(g) for g in r.gateways], r.one_edge_away) for r in UN.twin_gateway_emergence(new, tree.imports, tree.edges).collect()]
    assert got == [("use/a.ts", "axios", [("net/http.ts", 1)], True)]
    own = tree.imports.where(F.col("file_path") == "net/http.ts")
    assert [r.gateways[0].gateway for r in UN.twin_gateway_emergence(own, tree.imports, tree.edges).collect()] == ["use/a.ts"]
