"""The duels of the mix and the statistics of the classifier against plain versions of them."""

import math
import re
import struct
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import mixing, quality_classifier, token_files
from quillspan.llm.bpe import default_tokenizer
from quillspan.llm.common import new_folder
from tests.llm.test_operators import base_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(*values):
    """Spark's xxhash64 over (kind, value); nulls leave the hash as it is."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack({"i": "<i", "l": "<q"}[kind], v), h)
    return h - (1 << 64) if h >> 63 else h


def draw(doc, seed):
    return spark_hash(("i", seed), ("l", doc["id"]), ("i", doc["tie"]), ("l", doc["size"])) % (1 << 52) / float(1 << 52)


def sure(p):
    return 0.0 if p < mixing.SURE else 1.0 if p > 1 - mixing.SURE else p


def fold(docs, seed):
    out, on = [], docs[0]
    for doc in docs[1:]:
        if on["p"] in (0.0, 1.0):
            out.append(on)
            on = doc
            continue
        up, down = min((1 - on["p"]) * on["size"], doc["p"] * doc["size"]), min(on["p"] * on["size"], (1 - doc["p"]) * doc["size"])
        t = up if draw(doc, seed) * (up + down) < down else -down
        a, b = on | {"p": sure(on["p"] + t / on["size"])}, doc | {"p": sure(doc["p"] - t / doc["size"])}
        gone, on = (a, b) if a["p"] in (0.0, 1.0) else (b, a)
        out.append(gone)
    return out, on


def plain_mix(rows, goals, seed):
    """(doc_id, tie, source) -> copies; goals are source -> (target, source_size, documents)."""
    most = max(n for *_, n in goals.values())
    depth = max(1, math.ceil(math.log(max(most, 2), mixing.FAN)))
    copies = {}
    for source, (target, size, n) in goals.items():
        ratio = target / size if size else 0.0
        ratio = float(round(ratio)) if abs(ratio - round(ratio)) < mixing.SURE else ratio
        whole, p = math.floor(ratio), ratio - math.floor(ratio)
        mine = [{"id": i, "tie": tie, "size": words, "p": p} for i, tie, s, words in rows if s == source]
        for d in mine:
            if not d["size"] or not p:
                copies[d["id"], d["tie"], source] = whole if d["size"] else 0
        groups = defaultdict(list)
        for d in mine:
            if d["size"] and p:
                groups[spark_hash(("i", seed + 1), ("l", d["id"]), ("i", d["tie"]), ("l", d["size"])) % math.ceil(n / mixing.FAN)].append(d)
        done = []
        for level in range(depth + 1):
            above = defaultdict(list)
            for bucket, docs in groups.items():
                docs.sort(key=lambda d: (-d["size"], draw(d, seed + 2 + level), (d["id"] is not None, d["id"] or 0), d["tie"]))
                out, on = fold(docs, seed + 100 + level)
                done += out
                above[bucket // mixing.FAN].append(on)
            groups = above
        done += [d | {"p": 1.0 if draw(d, seed + 99) < d["p"] else 0.0} for docs in groups.values() for d in docs]
        for d in done:
            copies[d["id"], d["tie"], source] = whole + int(d["p"])
    return copies


def test_mix_against_plain_duels(spark):
    """What each document is taken for, duel by duel, over groups, levels, ties and null ids."""
    r = np.random.default_rng(11)
    names = ["a", "b", "c", None]
    rows = [(k, " ".join(f"w{r.integers(9)}" for _ in range(int(r.integers(0, 30)))), names[min(int(r.exponential(0.8)), 3)]) for k in range(700)]
    rows += [(None, f"x{k} y", "a") for k in range(5)] + [(3, f"p{k} q r", "b") for k in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(table).collect()
    goals, docs = {}, []
    for o in out:
        goals[o.source] = (o.target, o.source_size, goals.get(o.source, (0, 0, 0))[2] + 1)
        docs.append((o.doc_id, o.tie, o.source, o.size))
    expected = plain_mix(docs, goals, 10)
    assert {(o.doc_id, o.tie, o.source): o.copies for o in out} == expected and len(expected) == len(rows)
    assert len({c for c in expected.values()}) > 2


def test_statistics_against_a_plain_version(spark, docs):
    """Every statistic of every odd row, counted by hand."""
    per = lambda x, y: 1000.0 * x / max(y, 1)
    n = lambda pattern, text: sum(map(len, re.findall(pattern, text)))
    found = sorted((x.doc_id is not None, x.doc_id or 0, list(x.features)) for x in quality_classifier.statistics(docs).collect())
    expected = []
    for row in docs.collect():
        text = row.text or ""
        words, chars, symbols, twins, repeats = base_counts(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        capitals = sum(c.isupper() and len(c) == 1 for c in text)
        rate = lambda x, y: 1000 * x // y if y else 0
        values = [
            math.log1p(words), chars / max(words, 1), math.log1p(per(symbols, chars)), math.log1p(rate(twins, len(lines))), math.log1p(per(repeats, words)), math.log1p(rate(capitals, chars)),
            math.log1p(per(n("[!?]", text), chars)), math.log1p(per(n("[|]", text), chars)), math.log1p(per(n("[0-9]", text), chars)), math.log1p(per(n("[.,;:]", text), chars)),
        ]
        expected.append((row.doc_id is not None, row.doc_id or 0, values))
    assert len(found) == len(expected)
    for a, b in zip(found, sorted(expected), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2], b[2], rtol=1e-12, atol=0)


def test_rows_of_one_doc_id_keep_their_places(spark, tmp_path):
    """Null and repeated ids: two runs over differently dealt rows give every text the same start."""
    rows = [(None, f"text {k % 40}") for k in range(120)] + [(5, f"other {k}") for k in range(60)] + [(6, None), (6, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    runs = []
    for parts in (1, 7):
        folder = new_folder(spark, "tokens")
        out = token_files.read(token_files.write(table.repartition(parts, F.rand(parts)), folder, default_tokenizer()), folder)
        runs.append(sorted(((x.start, x.doc_id or -1, x.n_tokens, x.ids_crc32) for x in out.collect())))
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
