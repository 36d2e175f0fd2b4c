"""Comparison by shape, call order, diffs, graphs and sets over the driver's tables.

Documents stand in for functions, their lines for statements; lines of orders stand in for calls.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.operators import call_order, references, shape, similarity, units
from quillspan.operators import relation_rules as RR
from quillspan.plans.queries import _t, query
from quillspan.session import stored
from quillspan.sources import diff

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SHAPES = f"""d AS (SELECT doc_id, array_to_string([substr('{_LETTERS}', least(25, length(x) // 16) + 1, 1) FOR x IN string_split(coalesce(text, ''), chr(10))], '') AS shape FROM documents),
s AS (SELECT shape, min(doc_id) AS first, count(*) AS n FROM d GROUP BY shape)"""


@query(
    f"""WITH {_SHAPES},
g AS (SELECT shape, i AS pos, substr(shape, i, 3) AS gram, greatest(length(shape) - 2, 1) AS m FROM s, unnest(generate_series(1, greatest(length(shape) - 2, 1))) t(i)),
c AS (SELECT gram, count(DISTINCT shape) AS n FROM g GROUP BY gram),
w AS (SELECT shape, pos, m, min(lpad(CAST(n AS VARCHAR), 12, '0') || gram) OVER (PARTITION BY shape ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS pick FROM g JOIN c USING (gram)),
p AS (SELECT DISTINCT shape, pick FROM w WHERE pos <= greatest(m - 2, 1)),
e AS (SELECT DISTINCT a.shape AS l, b.shape AS r FROM p a JOIN p b USING (pick) WHERE a.shape < b.shape AND abs(length(a.shape) - length(b.shape)) * 4 <= greatest(length(a.shape), length(b.shape)))
SELECT x.first AS left_doc, y.first AS right_doc, x.n AS left_docs, y.n AS right_docs, CAST(levenshtein(l, r) AS BIGINT) AS distance
FROM e JOIN s x ON x.shape = l JOIN s y ON y.shape = r WHERE levenshtein(l, r) <= greatest(length(l), length(r)) // 4"""
)
def shape_lookalikes(spark, sf_dir):
    letters = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.substring(F.lit(_LETTERS), F.least(F.lit(25), F.floor(F.length(x) / 16)).cast("int") + 1, F.lit(1)))
    shapes = stored(_t(spark, sf_dir, "documents").select("doc_id", F.array_join(letters, "").alias("shape")).groupBy("shape").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    near = shape.near_shapes(shapes)
    left = shapes.select(F.col("shape").alias("left"), F.col("first").alias("left_doc"), F.col("n").alias("left_docs"))
    right = shapes.select(F.col("shape").alias("right"), F.col("first").alias("right_doc"), F.col("n").alias("right_docs"))
    return near.join(left, "left").join(right, "right").select("left_doc", "right_doc", "left_docs", "right_docs", "distance")


_ASKED = "asked AS (SELECT a, b FROM (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier) WHERE b IS NOT NULL)"


@query(
    f"""WITH {_ASKED}, c AS (SELECT l_orderkey AS caller, l_suppkey AS t, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
SELECT a AS first, b AS second, count(*) FILTER (x.p < y.p) AS before, count(*) FILTER (x.p >= y.p) AS after, count(*) FILTER (x.p IS NULL) AS without, min(y.caller) FILTER (x.p IS NULL OR x.p >= y.p) AS example
FROM asked JOIN c y ON y.t = b LEFT JOIN c x ON x.t = a AND x.caller = y.caller GROUP BY 1, 2"""
)
def call_order_support(spark, sf_dir):
    after = F.lead("s_suppkey").over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    asked = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("first"), after.alias("second")).where("second is not null")
    calls = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("position"))
    return call_order.order_support(calls, asked)


@query(
    """WITH RECURSIVE e AS (SELECT * FROM (SELECT o_orderkey AS a, o_orderstatus AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL AND s <> 'F'),
p AS (SELECT a AS origin, a AS node, CAST(a AS VARCHAR) AS path, 1 AS n FROM e WHERE a NOT IN (SELECT b FROM e)
  UNION ALL SELECT origin, b, path || ',' || b, n + 1 FROM p JOIN e ON e.a = p.node)
SELECT origin, node, path, CAST(n AS BIGINT) AS layers FROM p"""
)
def handed_on_paths(spark, sf_dir):
    follows = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    steps = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), "o_orderstatus", follows.alias("target")).where("target is not null and o_orderstatus <> 'F'")
    return call_order.first_paths(steps).select("origin", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), F.size("path").cast("long").alias("layers"))


_RING = "e AS (SELECT DISTINCT source, target FROM (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem WHERE l_quantity > 40) WHERE source <> target)"


@query(
    f"""WITH RECURSIVE {_RING},
r AS (SELECT source AS origin, target AS node FROM e UNION SELECT origin, target FROM r JOIN e ON e.source = r.node),
m AS (SELECT a.origin AS node, min(a.node) AS least FROM r a JOIN r b ON b.origin = a.node AND b.node = a.origin GROUP BY 1)
SELECT x.least AS component, count(DISTINCT e.source) AS files, count(*) AS edges FROM e JOIN m x ON x.node = e.source JOIN m y ON y.node = e.target WHERE x.least = y.least GROUP BY 1"""
)
def cycle_components(spark, sf_dir):
    follows = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    e = _t(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("source"), follows.alias("target")).where("source <> target")
    inside, sizes = RR.cycle_components(e)
    least = inside.groupBy("root").agg(F.min("source").alias("component"))
    return sizes.join(least, "root").select("component", "files", "edges")


@query(
    """WITH RECURSIVE m AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 20),
r AS (SELECT DISTINCT c, o AS a, o AS b FROM m UNION SELECT r.c, r.a, y.o FROM r JOIN m x ON x.c = r.c AND x.o = r.b JOIN m y ON y.c = x.c AND y.s = x.s)
SELECT c AS customer, a AS member, min(b) AS part FROM r GROUP BY 1, 2"""
)
def cohesion_parts(spark, sf_dir):
    o, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem").where("l_quantity > 20")
    rows = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("member"), "l_suppkey").distinct()
    return similarity.parts(rows, ["customer"], "member", "l_suppkey")


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, text, lag(doc_id) OVER w AS other, lag(text) OVER w AS old FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY string_split(text, chr(10))[1] ORDER BY doc_id)),
p AS (SELECT doc_id, other, string_split(old, chr(10)) AS a, string_split(text, chr(10)) AS b FROM d WHERE other IS NOT NULL),
r AS (SELECT doc_id, 0 AS i, [0 FOR x IN b] AS best FROM p
  UNION ALL SELECT r.doc_id, i + 1, [list_max([CASE WHEN b[k] = a[i + 1] THEN CASE WHEN k = 1 THEN 0 ELSE best[k - 1] END + 1 ELSE best[k] END FOR k IN generate_series(1, j)]) FOR j IN generate_series(1, len(b))]
  FROM r JOIN p ON p.doc_id = r.doc_id WHERE i < len(a))
SELECT p.doc_id, p.other, CAST(len(b) - list_max(best) AS BIGINT) AS added, CAST(len(a) - list_max(best) AS BIGINT) AS removed FROM p JOIN r ON r.doc_id = p.doc_id AND i = len(a)"""
)
def line_diffs(spark, sf_dir):
    w = W.partitionBy(F.get(F.split("text", "\n"), F.lit(0))).orderBy("doc_id")
    d = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("source"), F.lag("doc_id").over(w).alias("other"), F.lag("text").over(w).alias("old_source")).where("other is not null")
    hunks = diff.line_hunks(d.select(F.col("doc_id").cast("string").alias("file_path"), "source", "old_source"))
    sizes = hunks.groupBy(F.col("file_path").cast("long").alias("doc_id")).agg(F.sum(F.size("new_lines")).alias("added"), F.sum(F.size("old_lines")).alias("removed"))
    none = F.lit(0).cast("long")
    return d.select("doc_id", "other").join(sizes, "doc_id", "left").select("doc_id", "other", F.coalesce("added", none).alias("added"), F.coalesce("removed", none).alias("removed"))


_PAGES = r"p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*[^?#/])', 1) AS path, url FROM pages)"
_UNITS = "u AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS unit FROM p WHERE url LIKE '%#top' UNION SELECT DISTINCT regexp_extract(path, '^([^/]+)/', 1) FROM p WHERE url LIKE 'https:%')"


@query(
    f"""WITH {_PAGES}, {_UNITS}
SELECT page_id, max_by(unit, length(unit)) AS unit FROM p LEFT JOIN u ON unit <> '' AND starts_with(path, unit || '/') GROUP BY page_id"""
)
def nearest_unit(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^?#]*[^?#/])", 1).alias("path"))
    sections = p.where("url like '%#top'").select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("unit"))
    hosts = p.where("url like 'https:%'").select(F.regexp_extract("path", "^([^/]+)/", 1).alias("unit"))
    found = units.nearest(p.select("path"), sections.unionByName(hosts).where("unit <> ''"))
    return p.join(found, "path", "left").select("page_id", "unit")


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM documents)
SELECT name, count(*) AS sites, count(DISTINCT doc_id) AS files FROM w GROUP BY name"""
)
def identifier_postings(spark, sf_dir):
    # prose has no strings or comments; what would begin one is taken out on both sides of the comparison
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9_$\n]", " ")
    posted = references.postings(_t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), plain.alias("source")))
    return posted.groupBy("name").agg(F.count("*").alias("sites"), F.count_distinct("file_path").alias("files"))


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
z AS (SELECT o, list_sort(list(s)) AS k, count(*) AS n FROM i GROUP BY o), f AS (SELECT min(o) AS o, any_value(n) AS n FROM z WHERE n >= 2 GROUP BY k),
r AS (SELECT i.o, i.s, n FROM i JOIN f ON f.o = i.o)
SELECT a.o AS inside, b.o AS outside, any_value(a.n) AS size, any_value(b.n) AS other_size FROM r a JOIN r b ON a.s = b.s AND b.n > a.n GROUP BY a.o, b.o HAVING count(*) = any_value(a.n)"""
)
def contained_sets(spark, sf_dir):
    return similarity.contained_sets(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
