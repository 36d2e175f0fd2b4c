"""Rules about modules over the driver's tables: parts and suppliers stand in for files, lines of orders for imports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import module_rules as MR
from quillspan.operators import modules as M
from quillspan.plans.queries import _t, query

#: Imports shipped before this day are the tree before a change, all are the tree after it.
IMPORTED = "1998-06-01"
#: Exports shipped before this day are those before a change, the others those after it.
EXPORTED = "1997-04-01"


def _path_sql(key: str) -> str:
    return f"'a' || {key} % 4 || CASE {key} % 6 WHEN 0 THEN '/shared/f' WHEN 1 THEN '/internal/f' WHEN 2 THEN '/__tests__/f' ELSE '/src/f' END || {key} || '.ts'"


def _path(key: str) -> Column:
    k = F.col(key)
    folder = F.when(k % 6 == 0, "/shared/f").when(k % 6 == 1, "/internal/f").when(k % 6 == 2, "/__tests__/f").otherwise("/src/f")
    return F.concat(F.lit("a"), (k % 4).cast("string"), folder, k.cast("string"), F.lit(".ts"))


_IMPORTS = f"""i AS (SELECT {_path_sql("l_suppkey")} AS source, {_path_sql("l_partkey")} AS target, l_shipdate AS day FROM lineitem WHERE l_quantity > 35),
e AS (SELECT DISTINCT source, target FROM i), n AS (SELECT source, target FROM i EXCEPT SELECT source, target FROM i WHERE day < DATE '{IMPORTED}'),
g AS (SELECT target AS t, count(*) AS importers, count(DISTINCT split_part(source, '/', 1)) AS areas, count(*) FILTER (source NOT LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\') AS runtime FROM e WHERE source <> target GROUP BY 1)"""


def _imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All edges, and those that the tree before lacks."""
    rows = _t(spark, sf_dir, "lineitem").where("l_quantity > 35").select(_path("l_suppkey").alias("source"), _path("l_partkey").alias("target"), F.col("l_shipdate").alias("day"))
    edges = rows.select("source", "target").distinct()
    return edges, M.new_edges(edges, rows.where(F.col("day") < F.lit(IMPORTED)).select("source", "target").distinct(), ["source", "target"])


_EXPORTS = f"""x AS (SELECT DISTINCT {_path_sql("l_partkey")} AS f, 'n' || l_linenumber AS name, CASE WHEN l_quantity > 49 THEN 'interface' WHEN l_quantity > 25 THEN 'function' ELSE 'let' END AS kind, l_shipdate < DATE '{EXPORTED}' AS old FROM lineitem),
b AS (SELECT f, list(DISTINCT name) AS b FROM x WHERE old GROUP BY 1), a AS (SELECT f, list(DISTINCT name) AS a FROM x WHERE NOT old GROUP BY 1),
c AS (SELECT f, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ',') AS added, array_to_string(list_sort(list_filter(b, lambda v: NOT list_contains(a, v))), ',') AS removed FROM a JOIN b USING (f))"""


def _exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Exports before and after a change."""
    kind = F.when(F.col("l_quantity") > 49, "interface").when(F.col("l_quantity") > 25, "function").otherwise("let")
    name = F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))
    rows = _t(spark, sf_dir, "lineitem").select(_path("l_partkey").alias("file_path"), name.alias("name"), kind.alias("kind"), (F.col("l_shipdate") < F.lit(EXPORTED)).alias("old")).distinct()
    return rows.where("old").drop("old"), rows.where("not old").drop("old")


def _joined(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.array_join(n, ",") for n in names})


@query(f"WITH {_IMPORTS}, {_EXPORTS} SELECT f AS file_path, removed, areas, runtime FROM c JOIN g ON f = t WHERE removed <> '' AND areas >= 2")
def rule_cross_area_export_break(spark, sf_dir):
    return _joined(MR.cross_area_export_break(*_exports(spark, sf_dir), _imports(spark, sf_dir)[0]), "removed")


@query(f"WITH {_IMPORTS}, {_EXPORTS} SELECT f AS file_path, added, importers, areas, runtime FROM c JOIN g ON f = t WHERE removed = '' AND added <> '' AND areas >= 2")
def rule_stable_surface_widening(spark, sf_dir):
    return _joined(MR.stable_surface_widening(*_exports(spark, sf_dir), _imports(spark, sf_dir)[0]), "added")


@query(
    f"""WITH {_IMPORTS}, {_EXPORTS}, k AS (SELECT f, count(*) AS concrete FROM x WHERE NOT old GROUP BY 1 HAVING count(*) FILTER (kind = 'interface') = 0)
SELECT f AS file_path, concrete, importers FROM k JOIN g ON f = t WHERE importers >= 3"""
)
def rule_concrete_stable_module(spark, sf_dir):
    return MR.concrete_stable_module(_exports(spark, sf_dir)[1], _imports(spark, sf_dir)[0])


@query(
    f"""WITH {_IMPORTS}, {_EXPORTS}, v AS (SELECT f, name FROM x WHERE NOT old AND kind = 'let' EXCEPT SELECT f, name FROM x WHERE old),
w AS (SELECT f, array_to_string(list_sort(list(name)), ',') AS bindings FROM v GROUP BY 1) SELECT f AS file_path, bindings, importers FROM w JOIN g ON f = t"""
)
def rule_mutable_surface_expansion(spark, sf_dir):
    return _joined(MR.mutable_surface_expansion(*_exports(spark, sf_dir), _imports(spark, sf_dir)[0]), "bindings")


@query(
    f"""WITH {_IMPORTS} SELECT source AS file_path, min(target) AS target FROM n
WHERE source NOT LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\' AND target LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\' AND split_part(source, '/', 1) <> split_part(target, '/', 1) GROUP BY 1"""
)
def rule_cross_context_test_reach(spark, sf_dir):
    return MR.cross_context_test_reach(_imports(spark, sf_dir)[1])


@query(
    f"""WITH {_IMPORTS}, u AS (SELECT DISTINCT {_path_sql("p_partkey")} AS f FROM part WHERE p_size > 25 OR p_partkey % 6 = 2),
h AS (SELECT target AS f, source AS test, source IN (SELECT f FROM u) AS fresh FROM e WHERE source LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\' AND target IN (SELECT f FROM u))
SELECT f AS file_path, array_to_string(list_sort(list(test)), ',') AS tests FROM h GROUP BY 1 HAVING bool_and(fresh)"""
)
def rule_self_authored_exam(spark, sf_dir):
    new = _t(spark, sf_dir, "part").where("p_size > 25 or p_partkey % 6 = 2").select(_path("p_partkey").alias("file_path"))
    return _joined(MR.self_authored_exam(new, _imports(spark, sf_dir)[0]), "tests")


@query(
    f"""WITH {_IMPORTS}, o AS (SELECT DISTINCT {_path_sql("p_partkey")} AS f, p_brand AS own FROM part),
j AS (SELECT source, target, s.own AS s_own, t.own AS t_own, (source, target) IN (SELECT (source, target) FROM n) AS fresh FROM e JOIN o s ON s.f = source JOIN o t ON t.f = target WHERE s.own <> t.own),
p AS (SELECT s_own, t_own, count(*) AS precedent FROM j WHERE NOT fresh GROUP BY 1, 2)
SELECT source AS file_path, target, j.s_own AS "from", j.t_own AS "to", coalesce(precedent, 0) AS precedent FROM j LEFT JOIN p ON p.s_own = j.s_own AND p.t_own = j.t_own WHERE fresh"""
)
def rule_team_boundary_crossing(spark, sf_dir):
    owners = _t(spark, sf_dir, "part").select(_path("p_partkey").alias("file_path"), F.array("p_brand").alias("owners"))
    edges, fresh = _imports(spark, sf_dir)
    return _joined(MR.team_boundary_crossing(fresh, edges, owners), "from", "to")


@query(
    f"""WITH {_IMPORTS}, h AS (SELECT regexp_replace(f, '[^/]+$', 'index.ts') AS barrel, f FROM (SELECT DISTINCT {_path_sql("p_partkey")} AS f FROM part WHERE p_size > 30)),
l AS (SELECT source, target FROM e UNION SELECT source, regexp_replace(target, '[^/]+$', 'index.ts') FROM i WHERE day < DATE '{EXPORTED}'),
q AS (SELECT target, count(*) AS n FROM l WHERE regexp_extract(source, '^(.*)/[^/]*$', 1) <> regexp_extract(target, '^(.*)/[^/]*$', 1) GROUP BY 1)
SELECT source AS file_path, n.target, barrel, coalesce(v.n, 0) AS via_barrel, coalesce(d.n, 0) AS direct FROM n JOIN h ON f = n.target LEFT JOIN q v ON v.target = barrel LEFT JOIN q d ON d.target = n.target
WHERE regexp_extract(source, '^(.*)/[^/]*$', 1) <> regexp_extract(n.target, '^(.*)/[^/]*$', 1) AND coalesce(v.n, 0) + coalesce(d.n, 0) >= 2"""
)
def rule_barrel_bypass(spark, sf_dir):
    index = lambda c: F.regexp_replace(c, "[^/]+$", "index.ts")
    files = _t(spark, sf_dir, "part").where("p_size > 30").select(_path("p_partkey").alias("target"))
    handed_on = files.select(index("target").alias("barrel"), "target")
    edges, fresh = _imports(spark, sf_dir)
    old = _t(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 35) & (F.col("l_shipdate") < F.lit(EXPORTED))).select(_path("l_suppkey").alias("source"), index(_path("l_partkey")).alias("target"))
    return MR.barrel_bypass(fresh, edges.unionByName(old).distinct(), handed_on)


@query(
    """WITH x AS (SELECT DISTINCT 'a' || p_partkey % 4 || '/s' || p_partkey // 3 || '.ts' AS f, 's' || p_partkey // 3 AS stem, 'a' || p_partkey % 4 AS area, 'n' || p_size % 8 AS name FROM part),
y AS (SELECT f, stem, area, list(name) AS names FROM x GROUP BY 1, 2, 3),
r AS (SELECT l.f AS file_path, l.stem, m.f AS twin, row_number() OVER (PARTITION BY l.f ORDER BY m.f) AS position FROM y l JOIN y m ON l.stem = m.stem AND l.area <> m.area WHERE NOT list_has_any(l.names, m.names))
SELECT file_path, stem, twin FROM r WHERE position <= 6"""
)
def rule_same_stem_divergent_role(spark, sf_dir):
    key = F.col("p_partkey")
    path = F.concat(F.lit("a"), (key % 4).cast("string"), F.lit("/s"), F.floor(key / 3).cast("string"), F.lit(".ts"))
    exports = _t(spark, sf_dir, "part").select(path.alias("file_path"), F.concat(F.lit("n"), (F.col("p_size") % 8).cast("string")).alias("name"))
    return MR.same_stem_divergent_role(exports.select("file_path").distinct(), exports)


@query(
    f"""WITH u AS (SELECT DISTINCT 'd' || l_partkey || '/utils.ts' AS f, 'n' || l_linenumber AS name, 's' || l_suppkey AS usr FROM lineitem WHERE l_quantity > 40),
x AS (SELECT DISTINCT 'd' || l_partkey || '/utils.ts' AS f, 'n' || l_linenumber AS name, l_shipdate < DATE '{EXPORTED}' AS old FROM lineitem),
k AS (SELECT f, name, list(usr) AS users, (f, name) IN (SELECT (f, name) FROM x WHERE old) AS old FROM u WHERE (f, name) IN (SELECT (f, name) FROM x WHERE NOT old) GROUP BY f, name)
SELECT p.f AS file_path, p.name, array_to_string(list_sort(list(q.name)), ',') AS apart_from FROM k p JOIN k q ON p.f = q.f AND NOT p.old AND q.old AND NOT list_has_any(p.users, q.users) GROUP BY 1, 2"""
)
def rule_utility_module_grab_bag(spark, sf_dir):
    name = F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name")
    path = F.concat(F.lit("d"), F.col("l_partkey").cast("string"), F.lit("/utils.ts"))
    lines = _t(spark, sf_dir, "lineitem")
    rows = lines.select(path.alias("file_path"), name, (F.col("l_shipdate") < F.lit(EXPORTED)).alias("old")).distinct()
    used = lines.where("l_quantity > 40").select(path.alias("resolved"), name.alias("imported"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file_path"))
    return _joined(MR.utility_module_grab_bag(rows.where("old").drop("old"), rows.where("not old").drop("old"), used), "apart_from")
