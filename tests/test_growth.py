"""Steps whose rows, memory or shuffled bytes grew faster than what they read."""

import random
from collections import Counter
from itertools import combinations

from quillspan import session
from quillspan.operators import call_order, call_rules, references, shape, similarity
from quillspan.operators import relation_rules as RR
from tests.test_shape import edits


def plan(df):
    return df._jdf.queryExecution().toString()


def test_parts_link_only_items_that_share_a_feature(spark, monkeypatch):
    links = []
    monkeypatch.setattr(similarity, "components", lambda rows, of=similarity.components: links.extend(rows.collect()) or of(rows))
    rows = [(k, i, f"own{i}") for k in (1, None) for i in range(50)] + [(1, 7, "both"), (1, 3, "both"), (None, 9, "other"), (2, 9, None)]
    got = {(x.k, x.i): x.part for x in similarity.parts(spark.createDataFrame(rows, "k long, i long, f string"), ["k"], "i", "f").collect()}
    assert len(links) == 1
    assert got == {**{(k, i): i for k in (1, None) for i in range(50)}, (1, 7): 3, (2, 9): 9}


def test_sets_with_common_items_meet_by_pairs(spark):
    rows = [(o, o % 3) for o in range(600)] + [(o, 10 + o % 7) for o in range(600)] + [(o, 100 + o // 2 + 1000 * k) for o in range(600) for k in range(2)]
    df = spark.createDataFrame(rows, "o long, i long")
    assert similarity.meeting_pairs(similarity._ordered(df.distinct()), 3).count() < 6000  # by single items each of seven groups of 86 and more meets whole
    sets = {}
    for o, i in rows:
        sets.setdefault(o, set()).add(i)
    for least in (1, 2, 3):
        got = {(x.left, x.right): x.shared for x in similarity.shared_items(df, "o", "i", least).collect()}
        assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}


def test_large_sets_meet_small_and_large_ones(spark):
    n = similarity.PAIRED + 6
    sets = {"a": set(range(n)), "b": set(range(n - 3, 2 * n)), "c": {1, 2, n - 1, n + 5}, "d": {n - 2, n - 1, n}}
    rows = [(o, i) for o, s in sets.items() for i in s]
    got = {(x.left, x.right): x.shared for x in similarity.shared_items(spark.createDataFrame(rows, "o string, i long"), "o", "i", 3).collect()}
    assert got == {("a", "b"): 3, ("a", "c"): 3, ("b", "d"): 3}


def test_twin_types_of_common_members_meet_by_pairs(spark):
    rows = [(o, x.n, x.i) for o in range(300) for x in [type("X", (), {"n": k, "i": i}) for k, i in ((150, o % 2), (300, 9), (1, 1000 + o))]]
    ordered = spark.createDataFrame(rows, "o long, n long, i long").selectExpr("o", "struct(n, i) e").groupBy("o").agg(similarity.F.sort_array(similarity.F.collect_list("e")).alias("x"))
    assert similarity.meeting_pairs(ordered, 3).count() == 0  # of three items each the two rarest decide: no two sets have both
    members = spark.createDataFrame([("f", "T", "a"), ("f", "T", "b"), ("f", "T", "c"), ("g", "U", "a"), ("g", "U", "b"), ("g", "U", "c"), ("g", "V", "a"), ("h", "T", "b")], "file_path string, type_name string, member string")
    assert [tuple(x) for x in RR.convergent_twin_types(members).collect()] == [("f#T", "g#U", 3, 1.0)]


def test_statements_are_compared_by_digests(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(RR, "shared_items", lambda rows, *more, of=similarity.shared_items: seen.extend(rows.collect()) or of(rows, *more))
    body = "\n".join(f"const value{k} = other{k} * {k}" + " + more" * 50 for k in range(4))
    made = spark.createDataFrame([("a", "f", body), ("b", "g", body.replace(" ", "  ")), ("c", "h", body[:500])], "file_path string, name string, text string")
    assert [tuple(x) for x in RR.duplicated_logic(made).collect()] == [("a#f", "b#g", 4, 1.0)]
    assert {len(x.statement) for x in seen} == {16}


def test_clumps_are_made_in_partitions_that_grow_with_the_owners(spark, monkeypatch):
    monkeypatch.setattr(session, "DEALT_ROWS", 10)
    assert session.dealt(spark.range(200), "id").rdd.getNumPartitions() == 21
    rows = spark.createDataFrame([(o, i) for o in range(60) for i in (o % 2, 5, 7 + o % 3)], "o long, i long")
    found = similarity.clumps(rows, "o", "i", 2, 20)
    assert "REPARTITION_BY_NUM" in plan(found)
    assert {tuple(x) for x in found.collect()} == {(0, 5, 30), (1, 5, 30), (5, 7, 20), (5, 8, 20), (5, 9, 20)}


def test_groups_of_three_are_listed_without_joins_where_owners_are_narrow(spark):
    narrow = [(o, i) for o in range(9) for i in range(o, o + 4)]
    wide = [(20 + o, i) for o in range(2) for i in range(similarity.WHOLE + 1)]
    df = spark.createDataFrame(narrow, "o long, i long")
    assert "Join" not in plan(similarity.clumps(df, "o", "i", 3, 2)).split("== Physical Plan ==")[-1]
    for size in (3, 4):
        for rows in (narrow, narrow + wide):
            sets = {}
            for o, i in rows:
                sets.setdefault(o, []).append(i)
            want = Counter(c for s in sets.values() for c in combinations(sorted(s), size))
            got = {tuple(x)[:-1]: x.owners for x in similarity.clumps(spark.createDataFrame(rows, "o long, i long"), "o", "i", size, 2).collect()}
            assert got == {c: n for c, n in want.items() if n >= 2}


def test_orders_of_calls_are_folded_in_partitions_that_grow_with_the_calls(spark, monkeypatch):
    monkeypatch.setattr(session, "DEALT_ROWS", 10)
    calls = spark.createDataFrame([(c, t, (c * t) % 3) for c in range(30) for t in (1, 2)], "caller long, target long, position long")
    found = call_order.order_support(calls, spark.createDataFrame([(1, 2)], "first long, second long"))
    assert "REPARTITION_BY_NUM" in plan(found)
    assert [tuple(x)[2:5] for x in found.collect()] == [(10, 20, 0)]


def test_skipped_intermediaries_travel_as_lists(spark, monkeypatch):
    monkeypatch.setattr(call_rules, "LISTED", 3)
    edges = [(0, k) for k in range(1, 12)] + [(k, k + 1) for k in range(1, 11)] + [(5, k) for k in range(6, 12)] + [(4, 4), (0, 0)]
    df = spark.createDataFrame(edges, "source long, target long")
    found = call_rules.skipped_intermediaries(df, df)
    assert "array_intersect" in plan(found)
    all_of = {e for e in edges if e[0] != e[1]}
    assert sorted((x.source, x.target, x.middle) for x in found.collect()) == sorted((s, t, m) for s, t in all_of for a, m in all_of if a == s and m != t and (m, t) in all_of)


def test_sources_are_blanked_once(spark):
    files = spark.createDataFrame([("a", 'import {b} from "c"\nconst d = b("e") // f\ng(d)'), ("b", "no imports here"), ("c", None)], "file_path string, source string")
    posted = references.postings(files)
    assert plan(posted).split("== Physical Plan ==")[-1].count("regexp_extract_all") <= 3  # strings, imports, sites: each once
    assert sorted((x.name, x.line_number) for x in posted.where("file_path = 'a'").collect()) == [("b", 2), ("d", 2), ("d", 3), ("g", 3)]
    assert posted.where("file_path = 'b'").count() == 3 and posted.where("file_path = 'c'").count() == 0


def test_siblings_of_equal_tokens_are_one_while_pairs_are_looked_for(spark, monkeypatch):
    seen = set()
    monkeypatch.setattr(RR, "jaccard_pairs", lambda rows, *more, of=similarity.jaccard_pairs: seen.update(x.name for x in rows.collect()) or of(rows, *more))
    texts = {"a": "x y z", "b": "z y x x", "c": "x y z w", "d": "p q", "e": "z x y", "f": "w x y z v"}
    rows = [(g, n, t) for g in ("one", None) for n, t in texts.items()]
    found = RR.clone_and_tweak_sibling(spark.createDataFrame(rows, "file_path string, name string, text string")).collect()
    want = {"a": ("b", 1.0), "b": ("a", 1.0), "e": ("a", 1.0), "c": ("f", 0.8), "f": ("c", 0.8)}
    assert {(x.file_path, x.name): (x.sibling, x.jaccard) for x in found} == {(g, n): w for g in ("one", None) for n, w in want.items()}
    assert seen == {"a", "c", "d", "f"}


def test_sketches_lose_no_pair(spark):
    sets = {o: {(o * 37 + k * k) % 90 for k in range(20 + o % 30)} for o in range(80)}
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(x.left, x.right) for x in similarity.jaccard_pairs(spark.createDataFrame([(1, o, i) for o, s in sets.items() for i in s], "g long, o long, i long"), "g", "o", "i", least).collect()}
        assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def shuffled_rows(spark, act):
    """What `act` gives, and how many rows were shuffled for it."""
    jvm, sc = spark._jvm, spark.sparkContext
    none = jvm.java.util.ArrayList
    stages = lambda: sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(jvm.double, 0), none())
    rows = lambda: sum(x.shuffleWriteRecords() for x in (lambda all: [all.apply(k) for k in range(all.size())])(stages()))
    before = rows()
    return act(), rows() - before


def test_siblings_are_told_apart_before_anything_is_shuffled(spark):
    r = random.Random(5)
    texts = {f"f{k:03}": set(r.sample(range(60), 30)) for k in range(300)} | {"same": set(range(100, 130)), "tweaked": set(range(101, 131))}
    df = spark.createDataFrame([("a", n, " ".join(map(str, s))) for n, s in texts.items()], "file_path string, name string, text string")
    found, rows = shuffled_rows(spark, RR.clone_and_tweak_sibling(df).collect)
    near = lambda a, b: round(len(texts[a] & texts[b]) / len(texts[a] | texts[b]), 3)
    want = {a: min((-near(a, b), b) for b in texts if b != a) for a in texts}
    assert {(x.name, x.sibling, x.jaccard) for x in found} == {(a, b, -j) for a, (j, b) in want.items() if j <= -0.5}
    assert rows < 8 * len(texts)  # the pairs that have a token in common are over 40,000


def test_jaccard_is_rounded_as_in_sql(spark):
    text = lambda a, b: " ".join(map(str, range(a, b)))
    rows = [("f", "a", text(0, 300)), ("f", "b", text(99, 400)), ("g", "c", text(0, 9)), ("g", "d", text(0, 16))]
    found = RR.clone_and_tweak_sibling(spark.createDataFrame(rows, "file_path string, name string, text string")).collect()
    assert sorted((x.name, x.jaccard) for x in found) == [("a", 0.502), ("b", 0.502), ("c", 0.563), ("d", 0.563)]


def test_sets_are_compared_in_blocks_of_a_group_and_small_groups_together(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("SMALL", 5)):
        monkeypatch.setattr(similarity, name, value)
    r = random.Random(7)
    sets = {(g, o): set(r.sample(range(300), 300)[: r.choice((1, 2, 3, 5, 8, 120, 200, 299, 300))]) | {g or 0} for g, count in ((1, 60), (2, 30), (3, 5), (4, 3), (None, 4), (5, 1)) for o in range(count)}
    rows = spark.createDataFrame([(g, o, i) for (g, o), s in sets.items() for i in s], "g long, o long, i long")
    for least in (0.3, 0.5, 0.9):
        got = [(x.g, x.left, x.right) for x in similarity.jaccard_pairs(rows, "g", "o", "i", least).collect()]
        assert sorted(got, key=str) == sorted(((g, a, b) for g, a in sets for h, b in sets if g == h and a < b and len(sets[g, a] & sets[g, b]) / len(sets[g, a] | sets[g, b]) >= least), key=str)


def test_few_wide_owners_do_not_make_pairs_of_all(spark):
    sets = {o: {(o * 5 + k * k) % 11 for k in range(4)} for o in range(300)} | {1000: set(range(similarity.WHOLE + 1))}
    found = similarity.clumps(spark.createDataFrame([(o, i) for o, s in sets.items() for i in s], "o long, i long"), "o", "i", 3, 3)
    assert "Join" not in plan(found).split("== Physical Plan ==")[-1]
    want = Counter(c for s in sets.values() for c in combinations(sorted(s), 3))
    assert {tuple(x)[:-1]: x.owners for x in found.collect()} == {c: n for c, n in want.items() if n >= 3}


def test_parameters_of_functions_are_grouped_as_they_are(spark):
    rows = [("a", "f", ["x", "y", "z", None, "x"]), ("a", "f", ["w", "y"]), ("b", "g", ["z", "y", "x", "w"]), ("b", "h", ["w", "x", "y"]), ("b", "i", None), ("b", "j", ["x"]), ("c", None, ["y", "z", "x", "q"])]
    got = [tuple(x) for x in RR.data_clump(spark.createDataFrame(rows, "file_path string, name string, parameters array<string>")).collect()]
    assert sorted(got) == [("w", "x", "y", 3), ("x", "y", "z", 3)]


def test_edges_of_cycles_are_made_once(spark):
    steps = spark.createDataFrame([(1, k, n) for k, n in enumerate([1, 2, 3, 1, 9])] + [(2, 0, 4), (2, 1, 5), (2, 2, 4)], "walk long, at long, node long")
    ahead = similarity.F.lead("node").over(similarity.W.partitionBy("walk").orderBy("at"))
    inside, sizes = RR.cycle_components(steps.select(similarity.F.col("node").alias("source"), ahead.alias("target")).where("target is not null"))
    assert "Window" not in plan(inside)
    assert sorted(map(tuple, sizes.drop("root").collect())) == [(2, 2), (3, 3)]
    assert {(x.source, x.target) for x in inside.collect()} == {(1, 2), (2, 3), (3, 1), (4, 5), (5, 4)}


def test_contained_sets_are_gathered_once_and_compared_whole(spark):
    sets = {o: {(o * 7 + k * k) % 13 for k in range(1 + o % 6)} for o in range(60)} | {100: set(range(similarity.PAIRED + 3)), 101: set(range(3, 9))}
    rows = [(o, i) for o, s in sets.items() for i in s] + [(0, None), (None, 1)] + [(3, i) for i in sets[3]]
    found = similarity.contained_sets(spark.createDataFrame(rows, "o long, i long"), "o", "i", 1)
    assert "sha2" not in plan(found) and "array_except" in plan(found)
    first = {}
    for o in sorted(sets):
        first.setdefault(frozenset(sets[o]), o)
    want = {(a, b, len(s), len(t)) for s, a in first.items() for t, b in first.items() if s < t}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_shapes_that_meet_are_sorted_out_where_they_meet(spark):
    r = random.Random(4)
    made = {"".join(r.choice("zzzabcdZ{|é") for _ in range(r.choice((3, 4, 5, 8, 9, 15, 16, 35, 36, 60)))) for _ in range(150)} | {"aaaa", "aaaab", "a" * 40, "a" * 50, "b" * 40}
    for s in sorted(made):
        for part in (6, 4):
            at = [r.randrange(len(s)) for _ in range(len(s) // part)]
            made |= {"".join("" if i in at else c for i, c in enumerate(s)), "".join("zq" if i in at else c for i, c in enumerate(s)), "".join("q" if i in at else c for i, c in enumerate(s))}
    rows = spark.createDataFrame([(s,) for s in sorted(made)], "shape string")
    found = shape.near_shapes(rows)
    joins = [x for x in plan(found).split("== Physical Plan ==")[-1].splitlines() if "Join" in x]
    assert len(joins) == 1 and "levenshtein" in joins[0] and "REPARTITION_BY_NUM" in plan(found)  # pairs that are not near leave no task
    picks = {}
    for x in shape.winnowed(rows).collect():
        picks.setdefault(x.gram, []).append(x.shape)
    met = {p for shapes in picks.values() for p in combinations(sorted(shapes, key=str.encode), 2)}
    near = {(a, b): edits(a, b) for a, b in met if abs(len(a) - len(b)) * 4 <= max(len(a), len(b))}
    want = {(a, b, n) for (a, b), n in near.items() if n <= max(len(a), len(b)) // 4}
    assert {tuple(x) for x in found.collect()} == want and max(len(a) for a, _, _ in want) > 36 and len(want) < len(met)
