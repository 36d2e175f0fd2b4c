"""Each operator against a plain version of its contract, on rows with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import ann, bpe, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, substring_dedup, token_files, warc
from quillspan.llm.common import join_dimension, new_folder, open_store
from quillspan.llm.components import components
from quillspan.llm.license_texts import LICENSES
from quillspan.llm.suffix_sort import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def multiset(rows):
    return Counter(map(tuple, rows))


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    out = quality_rules.quality_rules(docs).select("doc_id", *quality_rules.COUNTS, "base_failed").collect()
    expected = []
    for r in docs.collect():
        c = base_counts(r.text)
        expected.append((r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert multiset(out) == multiset(expected)


def test_quality_sketch_quartiles_and_merge(spark):
    r = np.random.default_rng(1)
    values = r.integers(0, 3000, 4000).tolist()
    rows = spark.createDataFrame([("en", "s", int(v)) for v in values], "lang string, source string, v long")
    one = rows.select("lang", "source", F.lit("symbols").alias("rate"), quality_rules.bucket(F.col("v")).alias("bucket")).groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))
    twice = quality_rules.merge(one, one)
    high = quality_rules.thresholds(one).first()["_q_high_symbols"]
    assert high == quality_rules.thresholds(twice).first()["_q_high_symbols"]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    exact = q3 + quality_rules.REACH * (q3 - q1)
    assert abs(high - exact) < 0.05 * exact


def test_quality_fence_follows_its_group(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(60)), "en", "plain", 0) for k in range(40)]
    rows += [(100, " ".join(f"#w{j}" for j in range(60)), "en", "plain", 0)]
    rows += [(200 + k, " ".join(f"#w{j}" for j in range(60)), "en", "marked", 0) for k in range(40)]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert 100 not in kept and {200 + k for k in range(40)} <= kept and set(range(40)) <= kept


def test_quality_verdicts_against_a_plain_version(spark):
    """The quantiles of a group are read from sorted values instead of sketches."""
    r = np.random.default_rng(8)
    rows = []
    for k in range(260):
        word = lambda: "".join("abcdefgh"[x] for x in r.integers(0, 8, int(r.integers(2, 8 if k % 9 else 16))))
        text = " ".join(word().capitalize() if r.random() < (0.02 if k % 7 else 0.5) else word() for _ in range(int(r.integers(40, 120))))
        rows.append((k, text + " #" * int(r.integers(0, 30)) * (k % 5 == 0), "en" if k % 3 else "de", ("a", "b", "b", "b", "c")[k % 5] if k > 6 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    values = {x.doc_id: x for x in quality_rules.measure(docs).collect()}
    group = {i: (lang, source) for i, _, lang, source in rows}
    cut = lambda v: v - v % (1 << max(0, v.bit_length() - 7))

    def quartiles(rate, members):
        v = sorted(cut(values[i][f"_q_{rate}"]) for i in members)
        return v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1], len(v)

    def kept(i):
        if values[i].base_failed:
            return False
        lang, source = group[i]
        good = [j for j in values if not values[j].base_failed]
        levels = [[j for j in good if group[j] == group[i]], [j for j in good if group[j][0] == lang], [j for j in good if group[j][1] == source], good]
        level = next(k for k, m in enumerate(levels) if len(m) >= quality_rules.MIN_GROUP or k == 3)
        for rate in quality_rules.RATES:
            q1, q3, _ = quartiles(rate, levels[level])
            spread = q3 - q1
            if level == 0:
                peers = [quartiles(rate, [j for j in good if group[j] == g]) for g in {group[j] for j in levels[1]}]
                spread = max(spread, sum((high - low) * n for low, high, n in peers) // sum(n for *_, n in peers))
            reach = max(quality_rules.REACH * spread, quality_rules.SLACK[rate])
            v = values[i][f"_q_{rate}"]
            if v > q3 + reach or rate in quality_rules.BOTH_SIDES and v < q1 - reach:
                return False
        return True

    out = {x.doc_id: x.kept for x in quality_rules.quality_rules(docs).collect()}
    assert out == {i: kept(i) for i in values} and 0 < sum(out.values()) < len(out)


def test_quality_small_groups_meet_a_fence(spark):
    """Groups of fewer than MIN_GROUP documents are judged by their language, then their source, then all rows."""
    plain, marked = " ".join(f"w{j}" for j in range(60)), " ".join(f"#w{j}" for j in range(60))
    rows = [(k, plain, "en", "a") for k in range(40)] + [(100 + k, marked, "de", "b") for k in range(40)]
    rows += [(200, marked, "en", "rare"), (201, plain, "en", "rare"), (202, marked, "de", "rare"), (203, marked, "en", None)]
    rows += [(300, marked, "xx", "a"), (301, plain, "xx", "a"), (302, marked, None, "b"), (303, marked, None, "a")]
    rows += [(400, "#" * 2000 + marked, "xx", "rare"), (401, plain, None, None)]
    kept = {r.doc_id for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if r.kept}
    assert kept == {*range(40), *range(100, 140), 201, 202, 301, 302, 401}
    few = [(k, plain, f"l{k}", f"s{k}") for k in range(6)] + [(6, plain, None, None), (7, marked, "en", "a")]
    out = quality_rules.quality_rules(spark.createDataFrame(few, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in out if not r.kept} == {7}


def test_quality_keeps_columns(docs, none):
    assert quality_rules.keep_good(docs).dtypes == docs.dtypes
    assert not multiset(quality_rules.keep_good(docs).collect()) - multiset(docs.collect())
    assert quality_rules.keep_good(none).count() == quality_rules.quality_rules(none).count() == 0


def test_classifier(spark, docs, none):
    r = np.random.default_rng(0)
    good = [(k, " ".join("abcdefgh"[: r.integers(2, 8)] + str(j) for j in range(80))) for k in range(200)]
    bad = [(1000 + k, "!! ".join("ABCDEFGH"[: r.integers(2, 8)] for _ in range(80))) for k in range(100)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(table, labels).collect()
    assert all(x.predicted == (x.doc_id < 1000) for x in out if x.held_out) and any(x.held_out for x in out)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    odd = quality_classifier.classify(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 for x in odd)
    assert quality_classifier.classify(none, labels).count() == 0
    assert {x.score for x in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_discriminant_matches_numpy(spark):
    r = np.random.default_rng(3)
    k = len(quality_classifier.FEATURES)
    x = np.concatenate([r.normal(0, 1, (80, k)), r.normal(1, 2, (60, k))])
    y = [0] * 80 + [1] * 60
    rows = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y, strict=True)], "features array<double>, label int")
    got = np.array([row[0] for row in rows.select(quality_classifier.score(F.col("features"), quality_classifier.fit(rows))).collect()])
    covs = [np.cov(x[np.array(y) == c].T, bias=True) for c in (0, 1)]
    pooled = (80 * covs[0] + 60 * covs[1]) / 140
    log = []
    for c in (0, 1):
        s = (1 - quality_classifier.POOLED - quality_classifier.DIAGONAL) * covs[c] + quality_classifier.POOLED * pooled + quality_classifier.DIAGONAL * np.diag(np.diag(covs[c])) + quality_classifier.RIDGE * np.eye(k)
        d = x - x[np.array(y) == c].mean(axis=0)
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    expected = 1 / (1 + np.exp(-(log[1] - log[0] + np.log(60 / 80))))
    assert np.allclose(got, expected, atol=1e-9)


def test_bpe_round_trip(docs, none):
    from tokenizers import Tokenizer

    spec = bpe.default_tokenizer()
    library = Tokenizer.from_str(spec)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected, texts = [], []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        texts.append((r.doc_id, r.text or ""))
    assert multiset(bpe.round_trip(docs, spec).collect()) == multiset(expected)
    encoded = bpe.encode(docs, spec)
    assert multiset(bpe.decode(encoded, spec).collect()) == multiset(texts)
    assert bpe.round_trip(none, spec).count() == 0


ENCODER = {}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \t\n\r\x0b\x1c\x85\xa0 　ab1Zéß²½½日😀'!st<|>_")) , max_size=14))
def test_words_encode_as_texts_do(text):
    if not ENCODER:
        from tokenizers import Tokenizer

        spec = bpe.default_tokenizer()
        ENCODER.update(own=bpe.Encoder(spec), library=Tokenizer.from_str(spec), pieces=bpe.pieces(spec))
    for t in (text, text + "<|endoftext|>" + text):
        ids = np.frombuffer(ENCODER["own"].text(t), "<u2")
        assert ids.tolist() == ENCODER["library"].encode(t, add_special_tokens=False).ids
        assert bpe.decode_ids(ids, ENCODER["pieces"]).decode() == t


def test_warc(spark, none):
    html = ["<p>" + "x" * 200, "short", None, "", "<p>" + "x" * 200, "<b>" + "é" * 90, "short", "<p>" + "x" * 200]
    ids = [5, 2, 3, 4, 1, 6, 7, 1]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://a/{i}\n", h, "x") for i, h in zip(ids, html, strict=True)] + [(None, None, html[0], None)], "page_id long, url string, html string, digest string")
    folder = new_folder(spark, "warc-test")
    index = warc.write(pages, folder)
    out = warc.read(index, folder)
    first = {"<p>" + "x" * 200: 1}
    expected = []
    for i, h in [*zip(ids, html, strict=True), (None, html[0])]:
        data = (h or "").encode()
        to = first.get(h) if h in first and i != first[h] else None
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    assert multiset(out.collect()) == multiset(expected)
    row = index.where("page_id = 6").first()
    assert warc.read_record(folder, row.bundle, row.frame, row.offset, row.length)["payload"].decode() == html[5]
    empty = spark.createDataFrame([], pages.schema)
    assert warc.read(warc.write(empty, folder), folder).count() == 0


def test_warc_frames_and_bundles_close_and_the_stored_index_finds_their_records(spark):
    html = {i: f"<p>{i} " + "ä€x" * (50 + 37 * (i % 90)) for i in range(400)} | {400: "long " * 60_000, 401: "long " * 60_000}
    pages = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in html.items()], "page_id long, url string, html string").coalesce(2)
    folder = new_folder(spark, "warc-bundles")
    warc.write(pages.where("page_id < 300"), folder, frame_bytes=4096, bundle_frames=5)
    warc.write(pages.where("page_id >= 300"), folder, frame_bytes=4096, bundle_frames=5)
    index = warc.index_of(spark, folder)
    places = index.collect()
    assert sorted(r.page_id for r in places) == sorted(html)
    assert len({r.bundle for r in places}) > 10 and max(r.frame for r in places) == 4 and max(r.offset for r in places) > 0
    for r in places:
        if r.page_id % 40 == 0:
            found = warc.read_record(folder, r.bundle, r.frame, r.offset, r.length)
            assert found["headers"]["warc-record-id"] == f"<urn:page:{r.page_id}>" and found["payload"].decode() == html[r.page_id]
    kinds = {i: (n, d, k, to) for i, n, d, k, to in warc.read(index, folder).collect()}
    assert kinds[401][2:] == ("revisit", 400) and all(v[2] == "response" for i, v in kinds.items() if i != 401)
    assert all(kinds[i][:2] == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for i, h in html.items())


def test_warc_bundle_is_seekable_and_one_stream(tmp_path):
    import io

    import zstandard

    store, root = open_store(f"file://{tmp_path}")
    writer = warc.BundleWriter(store, f"{root}/b.warc.zst")
    data = [bytes([k]) * 100_000 for k in range(9)]
    places = [writer.add(d) for d in data]
    writer.close()
    reader = warc.BundleReader(store, f"{root}/b.warc.zst")
    assert len(reader.frames) == 3
    assert all(reader.frame(f)[o : o + n] == d for (f, o, n), d in zip(places, data, strict=True))
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "b.warc.zst").read_bytes()), read_across_frames=True)
    assert stream.read() == b"".join(data)


def plain_links(rows, n=4, percent=85):
    """doc_id -> (n_shingles, component)."""
    sets, parent = {}, {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        parent[r.doc_id] = r.doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join_odd_rows(docs, none):
    out = jaccard_join.link(docs).collect()
    expected = plain_links([r for r in docs.collect() if r.doc_id is not None])
    assert len(out) == docs.count()
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in out if r.doc_id is not None)
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert jaccard_join.link(none).count() == 0
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.dtypes == docs.dtypes and {2}.isdisjoint({r.doc_id for r in kept.collect()})


def test_jaccard_join_families(spark):
    """Chains and families of near copies of many sizes, with passages that dissimilar texts share."""
    r = np.random.default_rng(5)
    texts, passage = [], [f"p{k}" for k in range(40)]
    for size in (4, 6, 7, 9, 11, 13, 15, 18, 22, 30, 45, 70, 130, 300):
        for _ in range(3):
            words = [f"w{x}" for x in r.integers(0, 10**6, size)]
            for _ in range(6):
                texts.append(" ".join(words))
                words = list(words)
                at = int(r.integers(0, len(words)))
                words[at : at + 1] = [[], ["new"], [words[at], "more"]][int(r.integers(0, 3))]
    texts += [" ".join([*passage, *[f"q{x}" for x in r.integers(0, 10**6, 12)]]) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = plain_links(rows.collect())
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.link(rows).collect()} == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10**6))
def test_similar_sets_pass_every_filter(common, left, right, seed):
    r = np.random.default_rng(seed)
    x = np.unique(r.integers(0, 2**63, common + left + right).astype(np.uint64))
    r.shuffle(x)
    a, b = np.sort(x[: common + left]), np.sort(np.concatenate([x[:common], x[common + left :]]))
    rarity = {e: k for k, e in enumerate(r.permutation(x).tolist())}
    for percent in (60, 80, 85):
        if jaccard_join.similar(a, b, percent):
            tested = [set(s[: jaccard_join.sampled(len(s), percent)].tolist()) for s in (a, b)]
            assert len(tested[0] & tested[1]) >= max(jaccard_join.shared_at_least(len(s), percent) for s in (a, b))
            rare = [set(sorted(s.tolist(), key=rarity.get)[: jaccard_join.lacking(len(s), percent) + 1]) for s in (a, b)]
            assert rare[0] & rare[1]
            if max(len(a), len(b)) <= jaccard_join.most_light(percent):
                assert np.intersect1d(jaccard_join.subset_hashes(a, percent), jaccard_join.subset_hashes(b, percent)).size


def test_jaccard_join_of_other_lengths_and_thresholds(spark):
    r = np.random.default_rng(6)
    texts = []
    for size in (6, 9, 14, 25, 49, 50, 52, 90, 200):
        words = [f"w{x}" for x in r.integers(0, 10**6, size)]
        for _ in range(6):
            texts.append(" ".join(words))
            words = list(words)
            words[int(r.integers(0, len(words)))] = f"n{r.integers(0, 10**6)}"
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, percent in ((5, 80), (3, 60)):
        sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in map(str.split, texts)]
        least = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((least[a], least[b]))
                    least = [x if c == y else c for c in least]
        out = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.link(rows, n, percent).collect()}
        assert out == {k: (len(sets[k]), least[k]) for k in range(len(sets))}


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (200, 200)] + [(300, k) for k in range(301, 340)]
    out = {x.node: x.least for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys(range(300, 340), 300)}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    order = suffix_array(symbols)
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    for r, n in enumerate(common_prefixes(symbols, order)):
        if r:
            a, b = symbols[order[r - 1] :], symbols[order[r] :]
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or min(len(a), len(b)) == n


def plain_dedup(texts, window=400):
    """Of each text: n_bytes, n_removed, n_spans, digest and text of what is left."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[p : p + window] for d in data for p in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - window + 1):
            if n[d[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        left = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
    return out


def dedup_cases(docs):
    from tests.llm.conftest import prose

    long, other = prose(20, 200), prose(21, 200)
    return docs.select("doc_id", "text").where("doc_id is null or doc_id <> 9").unionByName(
        docs.sparkSession.createDataFrame(
            [(30, long + other), (31, other + long), (32, "x" + long[:450] + "y" + long[300:800]), (33, long[100:520] + long[90:505]), (34, "ab" * 900), (35, "ab" * 201 + "c"), (36, long[:399]), (37, other[:410] + long[700:1105])],
            "doc_id long, text string",
        )
    )


def test_substring_dedup(docs, none):
    rows = dedup_cases(docs).collect()
    table = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    expected = multiset((r.doc_id, *x) for r, x in zip(rows, plain_dedup([r.text for r in rows]), strict=True))
    assert multiset(substring_dedup.digests(table).collect()) == expected
    most = substring_dedup.MOST
    substring_dedup.MOST = 1
    try:
        assert multiset(substring_dedup.digests(table).collect()) == expected
    finally:
        substring_dedup.MOST = most
    assert substring_dedup.digests(none).count() == 0
    cut = substring_dedup.cut(docs)
    assert cut.dtypes == docs.dtypes
    assert all(r.n_chars == len(r.text) for r in cut.where("text is not null").collect())


def test_passages_of_fifty_words_are_cut(spark):
    from tests.llm.conftest import prose

    passage = prose(50, 52)
    texts = [prose(51 + k, 80) + " " + passage + " " + prose(61 + k, 80) for k in range(4)] + [prose(71, 150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"_w_spans": F.lit(1), "_W1": F.lit("x")})
    assert len(passage) > substring_dedup.CUT_WINDOW
    left = {r.doc_id: r.text for r in substring_dedup.cut(docs).collect()}
    assert left == dict(enumerate(x[4] for x in plain_dedup(texts, substring_dedup.CUT_WINDOW))) and passage not in "".join(left.values())


def test_op6_tells_passages_below_its_window(docs, tmp_path):
    from tests.llm.conftest import prose

    passage = prose(50, 52)
    assert substring_dedup.CUT_WINDOW < len(passage.encode()) < substring_dedup.WINDOW
    texts = [prose(51 + k, 80) + " " + passage + " " + prose(61 + k, 80) for k in range(3)] + [prose(71, 150)]
    spark = docs.sparkSession
    more = spark.createDataFrame([(50 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = dedup_cases(docs).unionByName(more).collect()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    given = [r.text for r in rows]
    both = zip(plain_dedup(given), plain_dedup(given, substring_dedup.CUT_WINDOW), strict=True)
    expected = multiset((r.doc_id, *x, *y[1:3]) for r, (x, y) in zip(rows, both, strict=True))
    found = substring_dedup.op6_substring_dedup(spark, str(tmp_path)).collect()
    assert multiset(found) == expected
    assert [(r.n_removed, r.n_passages) for r in sorted(found, key=lambda r: r.doc_id or 0) if (r.doc_id or 0) >= 50] == [(0, 1)] * 3 + [(0, 0)]


def test_texts_hashed_end_to_end_have_the_runs_of_each_alone():
    r = np.random.default_rng(3)
    texts = ["".join(chr(97 + x) for x in r.integers(0, 20, n)).encode() for n in (0, 399, 400, 401, 3000, 1)] + [b"ab" * 600, b"la " * 300, b""]
    alone = [(k, *run) for k, text in enumerate(texts) for run in substring_dedup.runs(text)]
    line, piece = substring_dedup.LINE, substring_dedup.PIECE
    try:
        for substring_dedup.LINE, substring_dedup.PIECE in ((line, piece), (900, piece)):
            assert [run for x in substring_dedup.runs_of(texts) for run in zip(*[c.tolist() for c in x], strict=True)] == alone
    finally:
        substring_dedup.LINE, substring_dedup.PIECE = line, piece


def test_runs_do_not_depend_on_pieces():
    text = ("".join(chr(97 + x) for x in np.random.default_rng(2).integers(0, 20, 3000)) + "ab" * 600).encode()
    whole = substring_dedup.runs(text)
    piece, substring_dedup.PIECE = substring_dedup.PIECE, 500
    try:
        parts = substring_dedup.runs(text)
    finally:
        substring_dedup.PIECE = piece
    at = lambda runs: {p: f for f, _, lo, hi, _ in runs for p in range(lo, hi + 1)}
    assert at(whole) == at(parts) and set(at(whole)) == set(range(len(text) - 399))


def test_license_scan(spark, docs, none):
    known = license_scan.known_licenses(spark)
    mit = LICENSES["MIT"]
    rows = [(1, mit.replace("<year> <holders>", "2020 Someone")), (2, mit.upper().replace("SUBLICENSE", "Sublicence").replace(",", " ;")), (3, mit + " more"), (4, None), (5, ""), (6, LICENSES["ISC"].replace("\n", "\r\n"))]
    out = {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert out == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "ISC"}
    assert license_scan.scan(docs, known).count() == docs.count() and license_scan.scan(none, known).count() == 0


def test_license_scan_names_and_sentences(spark):
    """Lines that name a holder go; wrapped sentences that begin with the word stay."""
    lines = ["Copyright Jane Doe", "# Copyright The Quill Authors", "Copyright by Liu", "Copyright Holder may not sell", "Copyright Law applies", "copyright license to copy"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, t string")
    left = {r.id: r.c for r in df.select("id", license_scan.canonical(F.concat(F.lit("a\n"), "t", F.lit("\nb"))).alias("c")).collect()}
    assert left == {0: "a b", 1: "a b", 2: "a b", 3: "a copyright holder may not sell b", 4: "a copyright law applies b", 5: "a copyright license to copy b"}


def test_license_scan_stored_table(spark, tmp_path):
    text = "Any use is fine.\n" * 3
    stored = spark.createDataFrame([("Z-own", text), ("A-own", text), ("Null", None)], "license_id string, text string")
    stored.write.parquet(str(tmp_path / "known"))
    known = license_scan.known_licenses(spark, str(tmp_path / "known"))
    docs = spark.createDataFrame([(1, text.upper()), (2, LICENSES["ISC"]), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in license_scan.scan(docs, known).collect()} == {1: "A-own", 2: "ISC", 3: None}
    digests = stored.limit(3).where("text is not null").select("license_id", license_scan.digest(F.col("text")).alias("canonical_sha256"))
    assert {r.doc_id: r.license_id for r in license_scan.scan(docs, digests).collect()} == {1: "A-own", 2: None, 3: None}


@pytest.mark.parametrize("name, license_id", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")])
def test_license_scan_long_texts(spark, name, license_id):
    file = Path("/usr/share/common-licenses") / name
    if not file.exists():
        pytest.skip("no licence texts on this machine")
    text = file.read_text(encoding="utf-8")
    rows = [(1, text), (2, "Copyright Jane Doe\n" + text), (3, text + "and more")]
    out = {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.known_licenses(spark)).collect()}
    assert out == {1: license_id, 2: license_id, 3: None}


def test_license_scan_sql_agrees(spark, tmp_path):
    texts = ["Copyright Jane\r\n" + LICENSES["MIT"], "x\rCopyright Jane\u2028y", "\u0130 Copyright \u00c9va\nz", LICENSES["ISC"].lower(), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in license_scan.scan(docs, license_scan.known_licenses(spark)).collect()}
    assert got == set(con.execute(license_scan.ORACLE_SQL).fetchall())


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    spec = bpe.default_tokenizer()
    library = Tokenizer.from_str(spec)
    folder = new_folder(spark, "tokens-test")
    manifest = token_files.write(docs, folder, spec, length=64, shard_ids=5000)
    out = token_files.read(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    start = 0
    for r in out:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r.doc_id]]
        start += r.n_tokens
    store, _ = open_store(folder)
    for shard in manifest.collect():
        f = token_files.TokenFile(f"{shard.path}.arrow")
        read = np.concatenate([t[m.to_numpy(zero_copy_only=False)] for t, m in (f[k] for k in range(len(f)))])
        assert len(read) == shard.n_tokens and all(len(f[k][0]) == 64 for k in range(len(f)))
        assert (read == np.concatenate([x for _, x in token_files.read_shard(store, shard.path)])).all()
    assert token_files.read(token_files.write(none, folder, spec), folder).count() == 0


def test_nearest_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 24)) * r.uniform(0.5, 2, (3000, 1))
    x[100:140] = x[100]
    rows = [(k, v.astype(np.float32).tolist(), k) for k, v in enumerate(x)]
    odd = [(9000, None, 0), (9020, [0.0] * 24, 0), (9040, [float("nan")] * 24, 0), (9060, [None, *[1.0] * 23], 0), (9080, [1.0], 0), (None, [1.0] * 24, 0), rows[7], (9100, [float("inf")] * 24, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    out = ann.nearest(table).collect()
    exact = np.array([v for _, v, _ in rows], np.float64)
    hits, by_query = 0, defaultdict(list)
    for o in sorted(out, key=lambda o: (o.query_id, o["rank"])):
        by_query[o.query_id].append(o)
    assert set(by_query) == set(range(0, 3000, 20))
    for q, found in by_query.items():
        score = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        assert [o["rank"] for o in found] == list(range(1, 21)) and all(abs(o.score - score[o.vec_id]) < 1e-9 for o in found)
        assert [(-o.score, o.vec_id) for o in found] == sorted((-o.score, o.vec_id) for o in found)
        hits += len({o.vec_id for o in found} & set(order))
    assert hits >= 0.9 * 20 * len(by_query)
    few = ann.nearest(table.where("vec_id in (0, 1, 2, 20)")).collect()
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.6, 0.8]), (21, [0.0, 1.0])], "vec_id long, embedding array<double>")
    near = Counter((o.query_id, o["rank"], o.vec_id, round(o.score, 6)) for o in ann.nearest(twice).collect())
    assert near == Counter([(20, 1, 20, 1.0), (20, 2, 20, 0.6), (20, 3, 21, 0.0)] * 2 + [(20, 1, 21, 0.8), (20, 2, 20, 0.6), (20, 3, 20, 0.6)])
    assert len(few) == 6 and ann.nearest(table.limit(0)).count() == 0


def test_every_code_within_the_radius():
    r = np.random.default_rng(8)
    block = r.integers(0, 2**16, (20_000, 4)).astype(np.uint16)
    block[:50] = block[0] ^ np.uint16(1) ** np.arange(50, dtype=np.uint16)[:, None]
    index = ann.MultiIndex(block)
    for code in (block[0], block[777]):
        far = np.bitwise_count(block ^ code).sum(axis=1)
        near = index.near(code, 30)
        radius = np.sort(far)[29]
        assert set(near.tolist()) == set(np.flatnonzero(far <= radius).tolist())


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark, docs, none):
    r = np.random.default_rng(6)
    names = ["a", "b", "c", "d", None]
    rows = [(k, " ".join(["w"] * int(r.integers(0, 60))), names[min(int(r.exponential(1.2)), 4)]) for k in range(3000)] + [(1, "w w", "a")] * 400
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(table).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target, taken = plain_targets(sizes), Counter()
    for o in out:
        taken[o.source] += o.taken
        assert abs(o.target - target[o.source]) < 1e-6 and o.source_size == sizes[o.source] and o.taken == o.copies * o.size <= 3 * o.size
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert multiset(out) == multiset(mixing.mix(table).collect())
    odd = mixing.take_copies(docs)
    assert odd.dtypes == docs.dtypes and len(mixing.mix(docs).collect()) == docs.count()
    copies = Counter()
    for o in mixing.mix(docs).collect():
        copies[o.doc_id] += o.copies
    assert Counter(x.doc_id for x in odd.collect()) == +copies
    assert mixing.mix(none).count() == 0


def test_mix_of_one_source_keeps_all(spark):
    table = spark.createDataFrame([(k, "w " * k, None) for k in range(50)], "doc_id long, text string, source string")
    assert all(o.copies == 1 for o in mixing.mix(table).collect() if o.size)


def test_dimension_join_beyond_the_broadcast_bound(spark):
    facts = spark.createDataFrame([(k, "hot" if k % 3 == 0 else None if k % 3 == 1 else str(k)) for k in range(300)], "id long, key string")
    dim = spark.createDataFrame([("hot", 1), (None, 2), ("5", 3)], "key string, value int")
    wide = join_dimension(facts, dim, ["key"], spread=F.col("id"), rows=10**9).orderBy("id").collect()
    assert wide == join_dimension(facts, dim, ["key"]).orderBy("id").collect() and len(wide) == 300
