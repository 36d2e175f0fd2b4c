"""Requests, scopes and artifacts on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import requests as Q


def test_compact_evidence(spark):
    whole = json.dumps({"function": {"name": "f", "source": "s", "moduleSource": "m" * 20_000, "truncated": True}, "configuration": {"moduleSource": "other"}, "abstraction": 3, "list": [{"source": "stays"}], "none": None}, separators=(",", ":"))
    rows = [(1, whole), (2, None), (3, "{}"), (4, "no json")]
    out = {r.id: r for r in Q.compact_evidence(spark.createDataFrame(rows, "id int, evidence string")).withColumn("cut", Q.is_truncated(F.col("evidence"))).collect()}
    assert json.loads(out[1].evidence) == {"function": {"name": "f", "truncated": True}, "configuration": {}, "abstraction": 3, "list": [{"source": "stays"}], "none": None}
    assert out[1].module_source == "other" and out[1].cut
    assert out[2].evidence is None and out[4].evidence is None and out[3].evidence == "{}" and not out[2].cut


def test_requests_share_candidates(spark):
    rows = [("a", 0, 1, "x", "r1", None, '{"n":1}'), ("a", 0, 2, "y", "r1", "near", None), ("a", 0, 3, "x", "r2", None, '{"n":2}'), ("b", 0, 1, "x", "r1", None, None)]
    named = Q.questions_of(spark.createDataFrame(rows, "file_path string, batch int, position int, candidate_id string, rule_id string, nearby_source string, evidence string"))
    out = {r.file_path: r for r in Q.requests(named).collect()}
    assert [(c.candidate_index, c.candidate_id, [tuple(e) for e in c.evidence]) for c in out["a"].candidates] == [(0, "x", [("r1", '{"n":1}'), ("r2", '{"n":2}')]), (1, "y", [])]
    assert [tuple(q) for q in out["a"].questions] == [
        ("q0", "r1", "candidates[0]", "candidates[0].source", 'candidates[0].evidence["r1"]'),
        ("q1", "r1", "candidates[1]", "candidates[1].nearbySource", None),
        ("q2", "r2", "candidates[0]", "candidates[0].source", 'candidates[0].evidence["r2"]'),
    ]
    assert len(out["b"].candidates) == 1
    assert Q.requests(named.limit(0)).count() == 0


def test_scope_files(spark):
    files = spark.createDataFrame([(f"f{i}", i) for i in range(9)], "file_path string, file_order int")
    owners = spark.createDataFrame([("f8",), ("f0",)], "owner string")
    related = spark.createDataFrame([("f8", "f7"), ("f8", "f5"), ("f8", "gone"), ("f3", "f4")], "owner string, file_path string")
    out = Q.scope_files(owners, files, related, most=4)
    order = {o: [r.file_path for r in out.where(F.col("owner") == o).orderBy("position").collect()] for o in ("f8", "f0")}
    assert order == {"f8": ["f8", "f5", "f7", "f0"], "f0": ["f0", "f1", "f2", "f3"]} and out.where("not bounded").count() == 0


@pytest.mark.parametrize("path", ["/etc/x", "a/../b", "", None])
def test_artifact_name_stays_inside(spark, path):
    with pytest.raises(Exception, match="outside the output folder"):
        spark.createDataFrame([(path,)], "p string").select(Q.artifact_name(F.col("p"))).collect()


def test_artifact_totals(spark):
    judged = spark.createDataFrame([("a.ts",), ("a.ts",)], "file_path string")
    abstained = spark.createDataFrame([("a.ts", 2), ("b..ts", 1)], "file_path string, count long")
    assert sorted(map(tuple, Q.artifact_totals(judged, abstained).collect())) == [("a.ts", "a.ts.json", 2, 2), ("b..ts", "b..ts.json", 0, 1)]
