"""The Merkle manifest against a plain tree, over odd rows, several fans and both ways to join the nodes."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspan.llm import manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def tree(bottom, fan):
    """Root and the path of each leaf, as (left, right) of each level."""
    paths, at = [[] for _ in bottom], list(range(len(bottom)))
    level = bottom
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for path, k in zip(paths, at, strict=True):
            run, own = runs[k // fan], k % fan
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        at = [k // fan for k in at]
        level = [h(*run) for run in runs]
    return level[0], paths


def plain(rows, fan):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: x[:3])
        built[lang] = tree([x[2] for x in groups[lang]], fan)
    root, tops = tree([built[lang][0] for lang in langs], fan) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (_, _, own, r), path in zip(groups[lang], built[lang][1], strict=True):
            path = path + top
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            acc = leaf(r, r.text.translate(LOWER) if r.text is not None else None) if changed else own
            for left, right in path:
                acc = h(left, acc, right)
            out.append((r.doc_id, own, built[lang][0], root, h(*[left + right for left, right in path]), acc, acc == root))
    return Counter(out)


def found(docs, fan):
    out = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, fan)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = manifest.fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), folded.alias("folded"), (folded == F.col("root")).alias("verified"))
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize(("fan", "few"), [(8, None), (2, 0), (2, 5), (3, 1000)])
def test_odd_rows(spark, docs, monkeypatch, fan, few):
    if few is not None:
        monkeypatch.setattr(manifest, "BROADCAST_ROWS", few)
    assert found(docs, fan) == plain(docs.collect(), fan)


def test_one_language_and_many(spark):
    rows = [(k, f"Text {k}", f"l{k % 70:02d}" if k % 3 else "all", "s", k) for k in range(600)] + [(9, "é Z", "é", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    expected = plain(docs.collect(), 8)
    assert found(docs, 8) == expected and {x[-1] for x in expected} == {True, False}


def test_lone_leaf_and_empty_table(spark, none):
    one = spark.createDataFrame([(3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = found(one, 8)
    own = h("1:3", "-", "-", "-", "-")
    assert row == (3, own, own, own, h(), own, True)
    assert found(none, 8) == Counter()


def test_equal_rows_spread_and_prove_their_places(spark):
    rows = [(None, "Same", "x", "s", 4)] * 300 + [(5, "Other", "x", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(docs, 8) == plain(docs.collect(), 8)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    out = manifest.op13_merkle_manifest(spark, "/root/testdata/sf0.01")
    expected = db.execute(manifest.ORACLE_SQL)
    assert [c[0] for c in expected.description] == out.columns
    assert Counter(map(tuple, out.collect())) == Counter(expected.fetchall())
