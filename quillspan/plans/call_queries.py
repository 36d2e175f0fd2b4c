"""The relations between functions over the driver's tables: lines of orders stand in for calls and edges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.operators import call_rules as C
from quillspan.operators import relation_rules as RR
from quillspan.plans.queries import _t, query


@query(
    """WITH e AS (SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b)
SELECT p.a AS source, p.b AS target, f.b AS middle FROM e p JOIN e f ON f.a = p.a AND f.b <> p.b JOIN e s ON s.a = f.b AND s.b = p.b"""
)
def layer_skips(spark, sf_dir):
    follows = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), follows.alias("target")).where("target is not null").distinct()
    return C.skipped_intermediaries(edges, edges)


@query(
    """WITH o AS (SELECT DISTINCT o_custkey AS customer, o_orderkey AS member, l_returnflag AS style FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
h AS (SELECT customer, style, CAST(count(DISTINCT member) AS BIGINT) AS others, array_to_string(list_sort(list(DISTINCT member))[1:6], ',') AS members FROM o GROUP BY 1, 2)
SELECT m.customer, m.member, h.style, h.others, h.members FROM (SELECT DISTINCT customer, member FROM o) m JOIN h ON h.customer = m.customer
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.customer = m.customer AND o.member = m.member AND o.style = h.style)"""
)
def style_gaps(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("styles"))
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("member"))
    gaps = C.other_styles(orders.join(lines, F.col("member") == F.col("l_orderkey")), "customer", "member", "styles")
    return gaps.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query(
    """WITH d AS (SELECT DISTINCT source, sha256(text) AS digest FROM documents WHERE text IS NOT NULL)
SELECT source, digest, groups FROM d JOIN (SELECT digest, CAST(count(*) AS BIGINT) AS groups FROM d GROUP BY 1 HAVING count(*) >= 2) USING (digest)"""
)
def shared_policies(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("source", F.sha2("text", 256).alias("digest"))
    return C.shared_signatures(docs, "source", "digest")


@query("SELECT p_partkey AS partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey IS NOT NULL)")
def unconsumed_names(spark, sf_dir):
    large = _t(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("partkey"))
    return C.unconsumed(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_name"), large, "partkey")


@query(
    """WITH c AS (SELECT c_custkey AS k, least(CAST(ceil(c_custkey / 7.0) AS BIGINT) * 7, max(c_custkey) OVER ()) AS last FROM customer)
SELECT 'f' || ((k - 1) // 21) AS file_path, 'c' || k AS name, array_to_string(['c' || x FOR x IN range(k + 1, last + 1)], ',') AS chain FROM c WHERE last - k >= 3"""
)
def hollow_chains(spark, sf_dir):
    """Each customer forwards to the next, up to the next multiple of seven."""
    k = F.col("c_custkey")
    body = F.when(k % 7 == 0, F.lit("const y = x + 1;\n  return y;")).otherwise(F.format_string("return c%d(x);", k + 1))
    spans = _t(spark, sf_dir, "customer").select(
        F.concat(F.lit("f"), F.floor((k - 1) / 21).cast("string")).alias("file_path"),
        k.cast("string").alias("id"),
        F.lit("function").alias("kind"),
        F.lit(1).alias("start_line"),
        F.concat(F.format_string("function c%d(x) {\n  ", k), body, F.lit("\n}")).alias("text"),
    )
    functions = RR.functions_of(spans)
    none = functions.limit(0).select("file_path", F.col("name").alias("local"), F.col("name").alias("imported"), F.col("name").alias("resolved"))
    calls = RR.resolved_calls(RR.calls_of(functions), functions, none)
    return C.hollow_delegation_chain(functions, calls).select("file_path", "name", F.array_join("chain", ",").alias("chain"))
