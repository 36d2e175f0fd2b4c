import hashlib
from collections import Counter

import corpus_pipeline
from quillspan.llm import registry
from quillspan.llm.bpe import default_tokenizer
from quillspan.llm.mixing import mix
from quillspan.llm.quality_rules import quality_rules
from quillspan.llm.substring_dedup import CUT_WINDOW
from tests.llm.conftest import prose
from tests.llm.test_operators import plain_dedup, plain_links


def test_every_operator_has_a_query():
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in registry.QUERIES}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_stages_on_odd_rows(spark, docs, none):
    for start in (docs, none):
        d = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, "")
            assert d.dtypes == start.dtypes
            d = d.checkpoint()
        corpus_pipeline.STAGES[-1][1](spark, start, "").count()


def test_near_copies_by_five_words_and_four_fifths(spark):
    """Of 50 words one differs: 41 of 51 five-word runs are shared (0.804), 43 of 51 four-word runs (0.843)."""
    words = [f"w{k}" for k in range(50)]
    far = [f"v{k}" for k in range(48)]  # 39 of 49 runs: 0.796
    texts = [" ".join(x) for x in (words, [*words[:25], "new", *words[26:]], far, [*far[:25], "new", *far[26:]])]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_copies_stage(spark, docs, "").collect()} == {0, 2, 3}


def test_one_row_of_each_repeated_text_reaches_the_last_stage(spark):
    """Rows that repeat under one doc_id, under none, under both, or as near copies, beside rows without words."""
    texts = [prose(100 + k, 120) for k in range(7)]
    near = texts[4].replace(texts[4].split()[60], "changed", 1)
    rows = [(1, texts[0], "a"), (1, texts[0], "a"), (2, texts[1], "a"), (None, texts[1], "a"), (None, texts[2], "a"), (None, texts[2], "b"), (3, texts[3], "a"), (3, texts[3], "b")]
    rows += [(None, texts[4], "a"), (5, near, "a"), (-(2**62), texts[5], "a"), (2**62, texts[5], "a"), (None, texts[5], "a"), (6, texts[6], "a")]
    odd = [(None, None, "a"), (None, None, "a"), (None, " ", "a"), (7, "", "a"), (8, "", "a"), (8, "", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows + odd], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies_stage(spark, docs, "").collect())
    expected = [(1, texts[0]), (2, texts[1]), (None, texts[2]), (3, texts[3]), (5, near), (-(2**62), texts[5]), (6, texts[6])]
    assert kept == Counter([*expected, (None, None), (None, None), (None, " "), (7, ""), (8, "")])
    clean = docs.where("length(text) > 400")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        clean = stage(spark, clean, "").checkpoint()
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(expected)


def test_run_against_a_plain_version(spark, tmp_path):
    """Each stage of run() is redone in plain Python on what the stage before kept."""
    from tokenizers import Tokenizer

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    source.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    rows = [r for r in docs.collect() if r.doc_id in good]
    links = plain_links(rows, corpus_pipeline.NEAR_NGRAM, corpus_pipeline.NEAR_PERCENT)
    rows = [r for r in rows if links[r.doc_id][1] == r.doc_id]
    lefts = [x[4] for x in plain_dedup([r.text for r in rows], CUT_WINDOW)]
    texts = {r.doc_id: x for r, x in zip(rows, lefts, strict=True) if x == r.text or x.strip()}
    left = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.source) for r in rows if r.doc_id in texts], "doc_id long, text string, source string")
    library = Tokenizer.from_str(default_tokenizer())
    expected = Counter()
    for m in mix(left).collect():
        ids = library.encode(texts[m.doc_id], add_special_tokens=False).ids
        row = (m.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[m.doc_id].encode()).hexdigest())
        expected[row] += m.copies
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == +expected
