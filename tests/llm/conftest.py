import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, k1 long, ids string, size int, target string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, copies, and columns whose names clash."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(2, 90)
    texts = [
        (1, base), (2, base), (3, near), (4, ""), (5, None), (6, "  \n\t "), (7, "one two"), (8, "One  TWO"), (9, prose(3, 30_000)),
        (10, prose(4, 80) + " " + passage + " " + prose(5, 80)), (11, passage + prose(6, 70)), (12, "la " * 400), (13, prose(7, 60) + "<|endoftext|>'s 　\x1c x"),
        (14, "a\nb\na\n" + prose(8, 60)), (None, prose(9, 60)), (None, base), (16, prose(10, 55)), (16, prose(10, 55)), (17, "é" * 500), (18, "#*$ !!" * 60),
    ]
    langs, sources = ["en", None, "fr"], ["a", "b", None, "a"]
    return [(i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), k, None, k, "x", k, None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
