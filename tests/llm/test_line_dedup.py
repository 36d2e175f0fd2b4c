"""Line dedup against counting all lines, and its store under insertions and deletions."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillspan.llm import line_dedup
from quillspan.llm.common import new_folder
from quillspan.llm.line_dedup import CuckooFilter, LineStore

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WHITE).translate(LOWER)


def plain(texts, counted, min_docs, min_chars=1):
    n = Counter(k for t in counted for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def texts(seed, n):
    r = random.Random(seed)
    common = ["Subscribe now", "  ÄÖ accept cookies\t", "", "x", " kept ", "é"]
    return [None if r.random() < 0.05 else "\n".join(r.choice(common).upper() if r.random() < 0.3 else r.choice([*common, f"line {r.randrange(8)}"]) for _ in range(r.randrange(0, 8))) for _ in range(n)]


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + k, t, k) for k, t in enumerate(rows)], "doc_id long, text string, k1 long").repartition(3)


def digests(docs, store, **more):
    return {r.doc_id: tuple(r)[1:] for r in line_dedup.digests(docs, store, **more).collect()}


@pytest.mark.parametrize("sent", [line_dedup.SENT_BYTES, 0])
def test_odd_rows(spark, docs, sent):
    store = LineStore(spark, new_folder(spark, "lines"), min_docs=2)
    store.insert(docs)
    rows = docs.collect()
    expected = plain([r.text for r in rows], [r.text for r in rows], 2)
    found = line_dedup.digests(docs, store, sent_bytes=sent).collect()
    assert Counter(map(tuple, found)) == Counter((r.doc_id, *e) for r, e in zip(rows, expected, strict=True))
    cut = line_dedup.cut_lines(docs, store, sent_bytes=sent)
    assert cut.schema == docs.schema
    kept = Counter((r.doc_id, e[2]) for r, e in zip(rows, expected, strict=True))
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect()) == kept


def test_empty_table(spark, none):
    store = LineStore(spark, new_folder(spark, "lines"))
    store.insert(none)
    assert line_dedup.digests(none, store).collect() == [] and line_dedup.cut_lines(none, store, sent_bytes=-1).collect() == []


def test_insertions_and_deletions(spark):
    """A store cut into shards of a few keys answers as a fresh count of what it holds, after every step."""
    a, b, c = texts(1, 60), texts(2, 50), texts(3, 40)
    store = LineStore(spark, new_folder(spark, "lines"), min_docs=7, shard_keys=4)
    fa, fb, fc = (frame(spark, x) for x in (a, b, c))
    everything = frame(spark, a + b + c)
    answers = []
    for step, held in ((lambda: store.insert(fa), a), (lambda: store.insert(fb), a + b), (lambda: store.insert(fc), a + b + c), (lambda: store.delete(fb), a + c), (lambda: store.delete(fc), a)):
        step()
        expected = dict(enumerate(plain(a + b + c, held, 7)))
        assert digests(everything, store) == expected == digests(everything, store, sent_bytes=0)
        answers.append(expected)
    assert answers[0] == answers[-1] != answers[2] and store.version() == 5
    counts = {(r.k1, r.k2): r.n for r in store.counts().collect()}
    assert sorted(counts.values()) == sorted(Counter(k for t in a for k in {key(x) for x in (t or "").split("\n")} if k).values())


def test_deleting_what_was_never_inserted(spark):
    store = LineStore(spark, new_folder(spark, "lines"), min_docs=2)
    store.insert(frame(spark, ["one\ntwo", "one"]))
    with pytest.raises(ValueError, match="never inserted"):
        store.delete(frame(spark, ["three"]))
    assert store.version() == 1 and store.counts().count() == 2
    store.delete(frame(spark, ["one"]))
    assert {x[1] for x in digests(frame(spark, ["one\ntwo"]), store).values()} == {0}


def test_a_shard_in_many_groups(spark, monkeypatch):
    """Past the bound of a broadcast, a line of all documents is looked up in as many groups as its count asks for."""
    rows = [f"common\nown {k}" for k in range(90)] + ["common\nshared"] * 30
    store = LineStore(spark, new_folder(spark, "lines"))
    docs = frame(spark, rows)
    store.insert(docs)
    names = ("h1", "h2", "drops")
    keyed = docs.selectExpr("xxhash64(text) as h1", "xxhash64(1L, text) as h2", "text")
    small = line_dedup.text_drops(keyed, store.filters(), 1, 1, "text", names, group_rows=10)
    found = {(r.h1, r.h2): len(r.drops) for r in small.collect()}
    assert len(found) == 91 and sorted(found.values()) == [1] * 90 + [2]


def test_filter_keeps_what_it_holds():
    r = np.random.default_rng(4)
    keys = r.integers(-(1 << 63), (1 << 63) - 1, 5000)
    held = CuckooFilter.of(keys)
    assert held.has(keys).all() and held.slots.size < 4 * len(keys)
    others = r.integers(-(1 << 63), (1 << 63) - 1, 200_000)
    assert held.has(others).mean() < 0.001
    for k in keys[:2500]:
        held.remove(int(k))
    assert held.has(keys[2500:]).all() and held.has(keys[:2500]).mean() < 0.01
    with pytest.raises(KeyError):
        CuckooFilter.of(keys[:1]).remove(int(keys[1]))


def test_exceptions_make_the_filter_exact(spark, monkeypatch):
    """With fingerprints of four values nearly all rare keys look frequent; the answers stay exact."""
    places = CuckooFilter.places

    def coarse(self, keys):
        return places(self, (keys.astype(np.uint64) & np.uint64(0x0003FFFFFFFFFFFF)).astype(np.int64))

    monkeypatch.setattr(CuckooFilter, "places", coarse)
    keys = np.arange(1, 40, dtype=np.int64) * 7919
    held = CuckooFilter.of(keys[:20])
    assert held.has(keys[:20]).all()
    wrong = keys[20:][held.has(keys[20:])]
    assert len(wrong)
    shard = line_dedup.Shard(held.slots.tobytes(), np.stack([wrong, wrong], axis=1).tobytes())
    both = np.stack([keys, keys], axis=1)
    assert shard.frequent(both).tolist() == [True] * 20 + [False] * 19


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    found = line_dedup.op11_line_dedup(spark, "/root/testdata/sf0.01")
    expected = db.execute(line_dedup.ORACLE_SQL)
    assert [c[0] for c in expected.description] == found.columns
    assert Counter(map(tuple, found.collect())) == Counter(expected.fetchall())
