"""Relational rules themselves over the driver's tables.

Parts stand in for functions (a brand is a file), lines of orders for calls, imports and members, documents for bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import relation_rules as RR
from quillspan.plans.queries import _t, query

#: Lines shipped before this day are the tree before a change, the others the tree after it.
DAY = "1996-01-01"

_PART = "f AS (SELECT p_brand AS file_path, 'p' || p_partkey AS name, p_size > 20 AS exported, p_size, p_type, p_retailprice, length(p_name) AS n FROM part)"
_CALL = """c AS (SELECT 's' || l_suppkey AS file_path, 'o' || l_orderkey AS caller, p_brand AS owner, 'p' || l_partkey AS target, l_returnflag AS flag, l_quantity AS q, l_shipdate AS day FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("file_path"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") > 20).alias("exported"), "p_size", "p_type", "p_retailprice", F.length("p_name").alias("n"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("owner"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    rows = _t(spark, sf_dir, "lineitem").join(p, "l_partkey")
    return rows.select(
        name("s", "l_suppkey").alias("file_path"), name("o", "l_orderkey").alias("caller"), "owner", name("p", "l_partkey").alias("target"), F.col("l_returnflag").alias("arguments"), F.col("l_quantity").alias("q"),
        F.col("l_shipdate").alias("day"), F.col("l_linenumber").alias("position"),
    )


@query(f"WITH {_PART}, {_CALL} SELECT file_path, name FROM f WHERE exported AND name NOT IN (SELECT target FROM c WHERE q > 48)")
def rule_unused_exported_helper(spark, sf_dir):
    return RR.unused_exported_helper(_functions(spark, sf_dir), _calls(spark, sf_dir).where("q > 48"))


@query(
    f"""WITH {_PART}, {_CALL}, s AS (SELECT owner, target, min(file_path) AS caller_file FROM c WHERE q > 48 GROUP BY 1, 2 HAVING count(DISTINCT (file_path, caller)) = 1)
SELECT f.file_path, name, caller_file FROM f JOIN s ON owner = f.file_path AND target = name WHERE exported"""
)
def rule_single_caller_exported_helper(spark, sf_dir):
    return RR.single_caller_exported_helper(_functions(spark, sf_dir), _calls(spark, sf_dir).where("q > 48"))


@query(f"WITH {_CALL} SELECT owner, target, count(DISTINCT flag) AS names FROM c WHERE q > 40 GROUP BY 1, 2 HAVING count(DISTINCT flag) >= 3")
def rule_heterogeneous_primitive_callers(spark, sf_dir):
    calls = _calls(spark, sf_dir).where("q > 40").withColumn("arguments", F.concat(F.lit(" row."), F.col("arguments"), F.lit(", 1")))
    return RR.heterogeneous_primitive_callers(calls)


@query("SELECT p_type AS name, count(DISTINCT p_brand) AS files, count(DISTINCT p_size) AS shapes FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1 AND count(DISTINCT p_size) > 1")
def rule_punned_name(spark, sf_dir):
    return RR.punned_name(_functions(spark, sf_dir).withColumns({"name": F.col("p_type"), "parameters": F.array(F.lit("p"), F.col("p_size").cast("string"))}))


@query(f"WITH {_PART}, {_CALL} SELECT f.file_path, name, count(*) AS callers, count(DISTINCT c.file_path) AS files FROM f JOIN c ON owner = f.file_path AND target = name WHERE p_size > 25 AND q > 30 GROUP BY 1, 2")
def rule_wide_fan_in_edit(spark, sf_dir):
    f = _functions(spark, sf_dir)
    after = F.concat(F.col("p_type"), F.when(F.col("p_size") > 25, F.lit(" more")).otherwise(F.lit(" \n")))
    return RR.wide_fan_in_edit(f.withColumn("text", F.concat("p_type", F.lit(" "))), f.withColumn("text", after), _calls(spark, sf_dir).where("q > 30"))


@query(
    f"""WITH {_PART} SELECT file_path, name, CASE WHEN p_retailprice > 1500 THEN 'removed' ELSE 'more parameters' END AS change
FROM f WHERE exported AND (p_retailprice > 1500 OR n % 5 > p_size % 5)"""
)
def rule_breaking_export_reshape(spark, sf_dir):
    f = _functions(spark, sf_dir)
    before = f.withColumn("parameters", F.array_repeat(F.lit("a"), F.col("p_size") % 5))
    after = f.where("p_retailprice <= 1500").withColumn("parameters", F.array_repeat(F.lit("a"), F.col("n") % 5))
    return RR.breaking_export_reshape(before, after)


@query(
    f"""WITH {_PART}, {_CALL} SELECT file_path, name FROM f WHERE name IN (SELECT target FROM c WHERE q > 45 AND day < DATE '{DAY}') AND name NOT IN (SELECT target FROM c WHERE q > 45 AND day >= DATE '{DAY}')"""
)
def rule_change_stranded_code(spark, sf_dir):
    calls = _calls(spark, sf_dir).where("q > 45")
    return RR.change_stranded_code(calls.where(F.col("day") < F.lit(DAY)), calls.where(F.col("day") >= F.lit(DAY)), _functions(spark, sf_dir))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.regexp_replace("target", "^p", "pkg-")
    return _calls(spark, sf_dir).select("file_path", F.concat(target, F.when(F.col("q") > 25, F.lit("/deep/path")).otherwise(F.lit(""))).alias("specifier"), (F.col("arguments") == "R").alias("type_only"))


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("p_size") < 25, F.lit("devDependencies")).otherwise(F.lit("dependencies"))
    return _functions(spark, sf_dir).where("p_size > 5").select(F.lit("package.json").alias("file_path"), F.regexp_replace("name", "^p", "pkg-").alias("name"), section.alias("section"))


@query("SELECT DISTINCT 's' || l_suppkey AS file_path, 'pkg-' || l_partkey AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 5")
def rule_phantom_package_import(spark, sf_dir):
    return RR.phantom_package_import(_imports(spark, sf_dir), _dependencies(spark, sf_dir))


@query("SELECT DISTINCT 's' || l_suppkey AS file_path, 'pkg-' || l_partkey AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 5 AND p_size < 25 AND l_returnflag <> 'R'")
def rule_dev_dependency_runtime_leak(spark, sf_dir):
    return RR.dev_dependency_runtime_leak(_imports(spark, sf_dir), _dependencies(spark, sf_dir))


@query(
    """WITH u AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT 'package.json' AS file_path, 'pkg-' || p_partkey AS name, coalesce(n, 0) AS sites FROM part LEFT JOIN u ON l_partkey = p_partkey WHERE p_size >= 40"""
)
def rule_single_use_dependency(spark, sf_dir):
    now = _functions(spark, sf_dir).select(F.lit("package.json").alias("file_path"), F.regexp_replace("name", "^p", "pkg-").alias("name"), "p_size")
    return RR.single_use_dependency(now.where("p_size < 40"), now, _imports(spark, sf_dir))


@query(
    """WITH RECURSIVE m AS (SELECT DISTINCT p_type || '-' || p_size AS t, p_brand AS f, floor(p_retailprice / 40) AS x FROM part),
r AS (SELECT DISTINCT t, f AS a, f AS b FROM m UNION SELECT r.t, r.a, y.f FROM r JOIN m x ON x.t = r.t AND x.f = r.b JOIN m y ON y.t = x.t AND y.x = x.x),
g AS (SELECT t, a AS f, min(b) AS part FROM r GROUP BY 1, 2),
k AS (SELECT t, list_sort(list(DISTINCT part)) AS parts FROM g GROUP BY 1)
SELECT g.t AS type_name, g.f AS file_path, CASE WHEN part = parts[1] THEN parts[2] ELSE parts[1] END AS other, CAST(len(parts) AS BIGINT) AS meanings FROM g JOIN k ON k.t = g.t WHERE len(parts) > 1"""
)
def rule_context_homonym_type(spark, sf_dir):
    members = _t(spark, sf_dir, "part").select(F.concat_ws("-", "p_type", "p_size").alias("type_name"), F.col("p_brand").alias("file_path"), F.floor(F.col("p_retailprice") / 40).cast("string").alias("member"))
    return RR.context_homonym_type(members)


@query(
    """WITH v AS (SELECT DISTINCT 'u' || user_id AS file_path, 'K' || CAST(floor(value) AS BIGINT) % 5 AS noun, event_type AS verb FROM events WHERE value IS NOT NULL)
SELECT file_path, noun, array_to_string(list_sort(list(verb)), ',') AS verbs FROM v GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def rule_synonym_vocabulary(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("value is not null")
    noun = F.concat(F.lit("K"), (F.floor("value") % 5).cast("string"))
    named = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), F.concat("event_type", noun).alias("name"))
    return RR.synonym_vocabulary(named).withColumn("verbs", F.array_join("verbs", ","))


@query(
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_$][A-Za-z0-9_$]{3,}')) AS identifier FROM documents)
SELECT identifier, count(*) AS files FROM w GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 30"""
)
def rule_shotgun_change(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return RR.shotgun_change(lines)


_STATEMENTS = """s AS (SELECT DISTINCT 'd#' || doc_id AS o, i FROM (SELECT doc_id, regexp_replace(unnest(string_split_regex(text, '[;\n]')), '[ \t\n\v\f\r]+', '', 'g') AS i FROM documents) WHERE length(i) > 12),
n AS (SELECT o, count(*) AS n FROM s GROUP BY o)"""


@query(
    f"""WITH {_STATEMENTS}, p AS (SELECT a.o AS l, b.o AS r, count(*) AS shared FROM s a JOIN s b ON a.i = b.i AND a.o < b.o GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT l AS left, r AS right, shared, round(shared / (x.n + y.n - shared), 3) AS jaccard FROM p JOIN n x ON x.o = l JOIN n y ON y.o = r"""
)
def rule_duplicated_logic(spark, sf_dir):
    return RR.duplicated_logic(_t(spark, sf_dir, "documents").select(F.lit("d").alias("file_path"), F.col("doc_id").cast("string").alias("name"), "text"))


@query(
    """WITH m AS (SELECT DISTINCT 'o' || l_orderkey || '#T' AS o, l_suppkey AS i FROM lineitem WHERE l_quantity > 25), n AS (SELECT o, count(*) AS n FROM m GROUP BY o),
p AS (SELECT a.o AS l, b.o AS r, count(*) AS shared FROM m a JOIN m b ON a.i = b.i AND a.o < b.o GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT l AS left, r AS right, shared, round(shared / (x.n + y.n - shared), 3) AS jaccard FROM p JOIN n x ON x.o = l JOIN n y ON y.o = r WHERE round(shared / (x.n + y.n - shared), 3) >= 0.5"""
)
def rule_convergent_twin_types(spark, sf_dir):
    members = _t(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file_path"), F.lit("T").alias("type_name"), F.col("l_suppkey").cast("string").alias("member"))
    return RR.convergent_twin_types(members)


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS o, CAST(l_suppkey AS VARCHAR) AS i FROM lineitem)
SELECT a.i AS item_1, b.i AS item_2, c.i AS item_3, count(*) AS owners FROM m a JOIN m b ON a.o = b.o AND a.i < b.i JOIN m c ON c.o = a.o AND b.i < c.i GROUP BY 1, 2, 3 HAVING count(*) >= 3"""
)
def rule_data_clump(spark, sf_dir):
    orders = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("parameters"))
    return RR.data_clump(orders.select(F.lit("orders").alias("file_path"), F.col("l_orderkey").cast("string").alias("name"), "parameters"))


_TOKENS = "t AS (SELECT source, doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+')) AS t FROM documents WHERE text IS NOT NULL)"


@query(
    f"""WITH {_TOKENS}, p AS (SELECT a.source, a.doc_id AS x, b.doc_id AS y, len(list_intersect(a.t, b.t)) AS s, len(a.t) + len(b.t) AS n FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.doc_id <> b.doc_id
  AND len(a.t) >= len(b.t) * 0.5 AND len(b.t) >= len(a.t) * 0.5),
j AS (SELECT source, x, y, round(s / (n - s), 3) AS jaccard FROM p WHERE s >= 0.5 * (n - s) AND s > 0)
SELECT source AS file_path, CAST(x AS VARCHAR) AS name, arg_min(CAST(y AS VARCHAR), (-jaccard, CAST(y AS VARCHAR))) AS sibling, max(jaccard) AS jaccard FROM j GROUP BY 1, 2"""
)
def rule_clone_and_tweak_sibling(spark, sf_dir):
    return RR.clone_and_tweak_sibling(_t(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").cast("string").alias("name"), "text").where("text is not null"))


_AREAS = f"""w AS (SELECT 'a' || l_suppkey || '/m' AS source, 'a' || l_partkey || '/m' AS target, l_shipdate < DATE '{DAY}' + 900 AS old FROM lineitem WHERE l_quantity > 25),
o AS (SELECT DISTINCT source, target FROM w WHERE old), z AS (SELECT source, target FROM w EXCEPT SELECT source, target FROM o)"""


@query(
    f"""WITH {_AREAS} SELECT source, target FROM z WHERE source <> target AND (target, source) IN (SELECT (source, target) FROM o)
  AND (source, target) NOT IN (SELECT (source, target) FROM o)"""
)
def rule_direction_reversing_edge(spark, sf_dir):
    side = lambda c: F.concat(F.lit("a"), F.col(c).cast("string"), F.lit("/m"))
    rows = _t(spark, sf_dir, "lineitem").where("l_quantity > 25").select(side("l_suppkey").alias("source"), side("l_partkey").alias("target"), "l_shipdate")
    before = rows.where(F.col("l_shipdate") < F.date_add(F.lit(DAY).cast("date"), 900)).select("source", "target").distinct()
    return RR.direction_reversing_edge(rows.select("source", "target").distinct(), before)


@query("SELECT 'd' || p_partkey // 10 || '/m' || p_partkey || '.test.ts' AS file_path, 'm' || p_partkey AS stem FROM part WHERE p_partkey % 2 = 0 AND p_size > 45")
def rule_far_away_test(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    stem = F.concat(F.lit("d"), F.floor(F.col("p_partkey") / 10).cast("string"), F.lit("/m"), F.col("p_partkey").cast("string"))
    tests = p.where("p_partkey % 2 = 0").select(F.concat(stem, F.lit(".test.ts")).alias("file_path"))
    return RR.far_away_test(tests.unionByName(p.where("p_size <= 45").select(F.concat(stem, F.lit(".ts")).alias("file_path"))))


_NAMED = "lower(replace(p_type, ' ', '-')) || '-' || p_partkey"


@query(
    f"""WITH f AS (SELECT p_partkey // 10 AS d, 'd' || p_partkey // 10 || '/' || {_NAMED} || '.ts' AS path, p_size > 40 AS new, list_distinct(list_filter(string_split_regex({_NAMED}, '[^a-z0-9]+'), lambda v: v <> '')) AS words FROM part),
m AS (SELECT x.path AS file_path, y.path AS twin, CAST(len(list_intersect(x.words, y.words)) AS BIGINT) AS shared FROM f x JOIN f y ON x.d = y.d AND x.path <> y.path WHERE x.new),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY shared DESC, twin) AS k FROM m WHERE shared > 0)
SELECT file_path, twin, shared FROM r WHERE k <= 6"""
)
def rule_duplicate_module_role(spark, sf_dir):
    key = F.col("p_partkey")
    path = F.concat(F.lit("d"), F.floor(key / 10).cast("string"), F.lit("/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit("-"), key.cast("string"), F.lit(".ts"))
    files = _t(spark, sf_dir, "part").select(path.alias("file_path"), "p_size")
    return RR.duplicate_module_role(files.where("p_size > 40"), files)


@query(
    """WITH f AS (SELECT p_brand AS file_path, 'p' || p_partkey AS name, 'x' || p_partkey % 400 AS a, 'y' || p_size AS b, p_partkey % 3 = 0 AS used FROM part),
h AS (SELECT file_path, name, a AS parameter FROM f WHERE NOT used UNION ALL SELECT file_path, name, b FROM f),
s AS (SELECT *, count(*) OVER (PARTITION BY parameter) AS sharing FROM h) SELECT * FROM s WHERE sharing >= 3"""
)
def rule_transitive_plumbing(spark, sf_dir):
    f = _functions(spark, sf_dir)
    a = F.concat(F.lit("x"), (F.substring("name", 2, 20).cast("long") % 400).cast("string"))
    b = F.concat(F.lit("y"), F.col("p_size").cast("string"))
    read = F.when(F.substring("name", 2, 20).cast("long") % 3 == 0, a).otherwise(F.lit("0"))
    text = F.concat(F.lit("function f("), a, F.lit(", "), b, F.lit(") { g("), a, F.lit(", "), b, F.lit("); return "), read, F.lit(" }"))
    return RR.transitive_plumbing(f.select("file_path", "name", F.array(a, b).alias("parameters"), text.alias("text")))


@query(
    """WITH f AS (SELECT p_brand || p_partkey // 40 AS file_path, 'load' || p_size % 10 AS stem, 'load' || p_size % 10 || CASE p_partkey % 3 WHEN 0 THEN 'Async' WHEN 1 THEN 'Sync' ELSE '' END AS name, p_partkey % 3 = 0 AS later FROM part)
SELECT file_path, stem, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM f GROUP BY 1, 2 HAVING bool_or(later) AND NOT bool_and(later)"""
)
def rule_sync_async_sibling_ambiguity(spark, sf_dir):
    key = F.col("p_partkey")
    ending = F.when(key % 3 == 0, "Async").when(key % 3 == 1, "Sync").otherwise("")
    text = F.concat(F.when(key % 3 == 0, "export async function f() {}").otherwise("function f() { /* async */ }"))
    name = F.concat(F.lit("load"), (F.col("p_size") % 10).cast("string"), ending)
    f = _t(spark, sf_dir, "part").select(F.concat("p_brand", F.floor(key / 40).cast("string")).alias("file_path"), name.alias("name"), text.alias("text"))
    return RR.sync_async_sibling_ambiguity(f).withColumn("names", F.array_join("names", ","))


@query(
    """WITH d AS (SELECT 'd' || doc_id AS file_path, regexp_replace(text, '\\bimport\\b[^;''"]*[''"][^''"]*[''"]', '', 'g') AS body FROM documents WHERE text IS NOT NULL),
u AS (SELECT file_path, unnest(['the', 'data', 'model', 'value', 'of']) AS local, body FROM d)
SELECT file_path, CASE WHEN length(local) > 3 THEN './long' ELSE './short' END AS specifier, count(*) AS bound, count(*) FILTER (regexp_matches(body, '\\b' || local || '\\b')) AS used FROM u GROUP BY 1, 2"""
)
def rule_import_use_skew(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("source"))
    names = F.explode(F.array(*[F.lit(x) for x in ("the", "data", "model", "value", "of")]))
    imports = files.select("file_path", names.alias("local")).withColumn("specifier", F.when(F.length("local") > 3, "./long").otherwise("./short"))
    return RR.import_use_skew(imports, files)
