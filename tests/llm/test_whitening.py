"""Whitening against exact integer sums and one eigendecomposition over all rows."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillspan.llm import whitening
from quillspan.llm.whitening import Moments, squared_deviations

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n long, v string, component int"


def plain(rows, components):
    """vec_id -> (deviation, whitened up to sign), n, explained; rows are (vec_id, list of floats)."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    away = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:components]
    white = (np.array(away, float) / n) @ vectors[:, order] / np.sqrt(values[order])
    return [sum(c * c for c in a) for a in away], white, values[order] / np.trace(v)


def test_query_against_exact_sums(spark):
    found = whitening.op12_embedding_whitening(spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    deviations, white, explained = plain(rows, 8)
    at = {vec_id: k for k, (vec_id, _) in enumerate(rows)}
    assert len(found) == 8 * len(rows) and {r.n for r in found} == {len(rows)}
    assert all(r.deviation == deviations[at[r.vec_id]] == int(r.deviation_decimal) for r in found)
    mine = np.zeros_like(white)
    for r in found:
        mine[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * sign, white, rtol=0, atol=1e-7)
    by_component = {r.component: r.explained for r in found}
    assert np.allclose([by_component[k + 1] for k in range(8)], explained, rtol=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(8)).max() < 1e-9


def frame(spark, vectors):
    return spark.createDataFrame([(vec_id, v, k, k, None, k) for k, (vec_id, v) in enumerate(vectors)], SCHEMA).repartition(5)


def test_odd_vectors_take_no_part(spark):
    r = np.random.default_rng(3)
    good = [(k, r.normal(size=3).tolist()) for k in range(30)] + [(None, [1.0, 2.0, 3.0]), (4, [0.5, 0.0, -1.0]), (4, [0.5, 0.0, -1.0])]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0])]
    found = whitening.whiten(frame(spark, good + odd)).collect()
    assert {x.n for x in found} == {33} and {x.component for x in found} == {1, 2, 3}
    assert Counter(x.vec_id for x in found) == Counter(vec_id for vec_id, _ in good for _ in range(3))
    float32 = [(i, [float(np.float32(c)) for c in v]) for i, v in good]
    deviations, _, explained = plain(float32, 3)
    assert Counter(int(x.deviation) for x in found if x.component == 1) == Counter(deviations)
    assert abs(sum(explained) - 1) < 1e-9 and found[0].identity_error < 1e-9


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_gives_no_rows(spark, vectors):
    out = whitening.whiten(frame(spark, vectors))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_flat_dimension_has_no_component(spark):
    found = whitening.whiten(frame(spark, [(k, [float(k), 7.0, float(k % 3)]) for k in range(12)])).collect()
    assert {x.component for x in found} == {1, 2} and found[0].identity_error < 1e-9


def test_merging_does_not_depend_on_how_rows_are_cut():
    r = np.random.default_rng(5)
    rows = np.floor(r.normal(5e6, 300, (500, 6))).astype(np.int64)
    whole = Moments.of(rows)
    parts = [Moments.of(p) for p in np.split(rows, [1, 2, 90, 400])]
    while len(parts) > 1:
        parts = [parts[i].merged(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    one = parts[0]
    assert one.n == 500 and one.total == whole.total == rows.sum(axis=0).tolist()
    assert np.allclose(one.scatter, whole.scatter, rtol=1e-10) and np.allclose(one.mean, whole.mean, rtol=1e-14)
    exact = np.cov(rows.T.astype(float), bias=True) * 500
    assert np.allclose(one.scatter, exact, rtol=1e-9, atol=1e-3)


def test_deviations_beyond_a_long_stay_exact():
    rows = np.array([[1 << 50, -(1 << 50)], [3, 5]], np.int64)
    total = rows.astype(object).sum(axis=0).tolist()
    expected = [sum((2 * int(c) - s) ** 2 for c, s in zip(row, total, strict=True)) for row in rows]
    assert squared_deviations(rows, 2, total) == expected and max(expected) > 1 << 64
