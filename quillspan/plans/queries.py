"""The operators over the driver's tables, which stand in for source files, edges, spans and answers.

Each query has beside it the SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions import text as T
from quillspan.operators import module_facts as MF
from quillspan.operators import module_rules as MR
from quillspan.operators import modules as M
from quillspan.operators import relation_rules as RR
from quillspan.operators import review as R
from quillspan.operators import similarity as S
from quillspan.operators import spans as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str):
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")


DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS BIGINT)"


# spans -------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(len(line)) AS BIGINT) AS longest,
  CAST(sum(CASE WHEN regexp_matches(line, '\\|') THEN 1 ELSE 0 END) AS BIGINT) AS table_lines
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id"""
)
def line_candidates(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.col("text").alias("source"))
    rows = P.lines(files)
    return rows.groupBy(F.col("file_path").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"), F.count_if(F.col("line").rlike(r"\|")).alias("table_lines"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents),
s AS (SELECT doc_id, line_number, line, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, CAST(start AS BIGINT) AS start, CAST(len(line) AS BIGINT) AS n FROM s"""
)
def line_starts(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.col("text").alias("source"))
    rows = P.lines(files)
    return rows.select(F.col("file_path").alias("doc_id"), F.col("line_number").cast("long").alias("line_number"), "start", F.length("line").cast("long").alias("n"))


@query(
    """SELECT doc_id, CAST(len(string_split(substr(text, 1, CAST(n_chars // 2 AS INT)), chr(10))) AS BIGINT) AS line,
  CAST(len(string_split(substr(text, 1, CAST(n_chars // 2 AS INT)), chr(10))[-1]) + 1 AS BIGINT) AS col FROM documents"""
)
def position_at(spark, sf_dir):
    half = F.expr("n_chars div 2")
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", T.line_at(F.col("text"), half).cast("long").alias("line"), T.column_at(F.col("text"), half).cast("long").alias("col"))


@query(
    """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l, len(string_split(substr(text, 1, CAST(n_chars // 2 AS INT)), chr(10))) AS here FROM documents)
SELECT doc_id, sha256(array_to_string(list_slice(l, greatest(1, here - 1), least(here + 3, len(l))), chr(10))) AS nearby FROM s"""
)
def nearby_source(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    d = d.withColumn("at", T.line_at(F.col("text"), F.expr("n_chars div 2")))
    return d.select("doc_id", F.sha2(T.nearby_source(F.col("text"), F.col("at"), F.col("at")), 256).alias("nearby"))


@query(
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, {DAY.format("l_shipdate")} AS s, {DAY.format("l_shipdate")} + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
r AS (SELECT o_orderkey, {DAY.format("o_orderdate")} + 30 AS s, {DAY.format("o_orderdate")} + 60 AS e FROM orders)
SELECT l_orderkey, l_linenumber, c.s AS start_line, c.e AS end_line FROM c
WHERE EXISTS (SELECT 1 FROM r WHERE r.o_orderkey = c.l_orderkey AND c.s <= r.e AND c.e >= r.s)"""
)
def changed_overlap_semi(spark, sf_dir):
    spans = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", _day("l_shipdate").alias("start_line"), (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end_line"))
    ranges = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (_day("o_orderdate") + 30).alias("start"), (_day("o_orderdate") + 60).alias("end"))
    return P.overlapping(spans, ranges, "key").withColumnRenamed("key", "l_orderkey")


@query(
    f"""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS id, {DAY.format("l_shipdate")} AS s, {DAY.format("l_shipdate")} + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
m AS (SELECT o_orderkey, span.id, span.e - span.s AS width, row_number() OVER (PARTITION BY o_orderkey ORDER BY span.e - span.s, span.id) AS r
  FROM orders JOIN s AS span ON span.k = o_orderkey AND {DAY.format("o_orderdate")} + 50 BETWEEN span.s AND span.e)
SELECT o_orderkey, id AS span_id, width FROM m WHERE r = 1"""
)
def innermost_enclosing(spark, sf_dir):
    sites = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("key"), (_day("o_orderdate") + 50).alias("at"))
    spans = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("span_id"), _day("l_shipdate").alias("start"), (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"))
    return P.innermost(sites, spans, "key", "at", ["o_orderkey"])


@query(
    f"""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
  AND {DAY.format("o_orderdate")} + 50 BETWEEN {DAY.format("l_shipdate")} AND {DAY.format("l_shipdate")} + CAST(l_quantity AS BIGINT))"""
)
def outside_nested(spark, sf_dir):
    sites = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (_day("o_orderdate") + 50).alias("at"))
    spans = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), _day("l_shipdate").alias("start"), (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"))
    return P.outside(sites, spans, "key", "at").select(F.col("key").alias("o_orderkey"))


@query(
    f"""WITH e AS (SELECT l_suppkey AS k, {DAY.format("l_shipdate")} AS d, 1 AS n FROM lineitem
  UNION ALL SELECT l_suppkey, {DAY.format("l_shipdate")} + CAST(l_quantity AS BIGINT) + 1, -1 FROM lineitem),
g AS (SELECT k, d, sum(n) AS n FROM e GROUP BY 1, 2),
r AS (SELECT k, sum(n) OVER (PARTITION BY k ORDER BY d) AS live FROM g)
SELECT k AS l_suppkey, CAST(max(live) AS BIGINT) AS most_alive FROM r GROUP BY k"""
)
def liveness_sweep(spark, sf_dir):
    spans = _t(spark, sf_dir, "lineitem").select("l_suppkey", _day("l_shipdate").alias("start"), (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"))
    return P.most_alive(spans, "l_suppkey")


@query(
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS start, CAST(l_linenumber + CAST(l_quantity AS BIGINT) % 7 - 1 AS BIGINT) AS "end"
FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 7 > 0"""
)
def hunk_headers(spark, sf_dir):
    header = F.concat(F.lit("@@ -1,1 +"), F.col("l_linenumber").cast("string"), F.lit(","), (F.col("l_quantity").cast("long") % 7).cast("string"), F.lit(" @@ f\n+x\n"))
    diffs = _t(spark, sf_dir, "lineitem").select("l_orderkey", header.alias("h")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("h"), "").alias("diff"))
    return P.hunks(diffs, "l_orderkey", "diff")


@query("SELECT doc_id, CAST(1 AS BIGINT) AS start, CAST(len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS BIGINT) AS \"end\" FROM documents")
def whole_file_ranges(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return P.whole_file(files, "doc_id", "text").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# modules -----------------------------------------------------------------------------------------

HREF = 'href="([^"]+)"'
_EDGES_SQL = f"""e AS (SELECT DISTINCT page_id AS source, unnest(regexp_extract_all(html, '{HREF}', 1)) AS specifier FROM pages),
k AS (SELECT specifier, min(source) AS target FROM e GROUP BY 1)"""


def _edges(spark, sf_dir) -> DataFrame:
    """Links of pages; a link stands for the first page that holds it."""
    pages = _t(spark, sf_dir, "pages")
    e = pages.select(F.col("page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("specifier")).distinct()
    known = e.groupBy("specifier").agg(F.min("source").alias("target"))
    return e.join(known, "specifier")


@query(
    f"""WITH {_EDGES_SQL}, d AS (SELECT target, count(*) AS n FROM e JOIN k USING (specifier) WHERE source <> target GROUP BY 1)
SELECT page_id AS node, CAST(coalesce(n, 0) AS BIGINT) AS in_degree FROM pages LEFT JOIN d ON page_id = target"""
)
def importer_in_degree(spark, sf_dir):
    nodes = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("node"))
    return M.in_degree(_edges(spark, sf_dir), nodes)


@query(
    f"""WITH {_EDGES_SQL}, d AS (SELECT target, count(*) AS n FROM e JOIN k USING (specifier) WHERE source <> target GROUP BY 1),
a AS (SELECT page_id AS node, coalesce(n, 0) AS n FROM pages LEFT JOIN d ON page_id = target)
SELECT node, CAST(n AS BIGINT) AS in_degree FROM a ORDER BY n DESC, node LIMIT 50"""
)
def module_plan_top50(spark, sf_dir):
    return importer_in_degree(spark, sf_dir).orderBy(F.desc("in_degree"), "node").limit(50)


@query(
    """SELECT page_id, count(*) AS edges, CAST(sum(CASE WHEN top <> own THEN 1 ELSE 0 END) AS BIGINT) AS crossing FROM (
  SELECT page_id, regexp_extract(target, '^([^/]*)/', 1) AS top, regexp_extract(source, '^([^/]*)/', 1) AS own FROM (
    SELECT DISTINCT page_id, regexp_replace(url, '^https?://', '') AS source, unnest(regexp_extract_all(html, 'href="/?([^"]+)"', 1)) || '/x' AS target FROM pages)) GROUP BY page_id"""
)
def edges_crossing_areas(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    targets = F.explode(F.regexp_extract_all("html", F.lit('href="/?([^"]+)"'), F.lit(1)))
    e = pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("source"), targets.alias("t")).select("page_id", "source", F.concat("t", F.lit("/x")).alias("target")).distinct()
    return M.edge_facts(e).groupBy("page_id").agg(F.count("*").alias("edges"), F.count_if("crosses").alias("crossing"))


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT o_custkey, o_orderkey, CAST(position AS INT) AS position, total FROM c WHERE position <= 20"""
)
def call_edges_top20(spark, sf_dir):
    calls = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return M.first_callers(calls, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "position", "total")


@query(
    """WITH t AS (SELECT DISTINCT o_custkey AS test, o_orderkey AS seam FROM orders WHERE o_orderpriority LIKE '1%'),
m AS (SELECT DISTINCT test, seam, l_partkey AS target FROM t JOIN lineitem ON seam = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY test, seam) AS position FROM m)
SELECT test, seam, target, CAST(position AS INT) AS position FROM r WHERE position <= 10"""
)
def transitive_pins(spark, sf_dir):
    tests = _t(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("test"), F.col("o_orderkey").alias("seam"))
    calls = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"))
    return M.transitive_pins(tests, calls)


@query(
    """SELECT source, count(*) AS n, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS holding,
  sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) * 10 >= count(*) * 7 AS is_norm FROM documents GROUP BY source"""
)
def placement_norm(spark, sf_dir):
    return M.norm(_t(spark, sf_dir, "documents").select("source", (F.col("lang") == "en").alias("flag")), ["source"])


@query(
    """WITH t AS (SELECT regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*)/', 1) AS area, count(*) AS files, max(CASE WHEN url LIKE '%#top' THEN 1 ELSE 0 END) AS indexed FROM pages GROUP BY 1)
SELECT count(*) AS areas, CAST(sum(CASE WHEN files >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS full_areas, CAST(sum(indexed) AS BIGINT) AS indexed_areas FROM t"""
)
def feature_grouping_norm(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(T.top_directory(F.regexp_replace("url", "^https?://", "")).alias("area"), F.col("url").endswith("#top").alias("indexed"))
    areas = pages.groupBy("area").agg(F.count("*").alias("files"), F.max(F.col("indexed").cast("int")).alias("indexed"))
    return areas.agg(F.count("*").alias("areas"), F.count_if(F.col("files") >= 3).alias("full_areas"), F.sum("indexed").alias("indexed_areas"))


_YEAR = "SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE year(l_shipdate) {} 1995"


@query(
    f"""WITH b AS ({_YEAR.format("<=")}), a AS ({_YEAR.format(">")}),
j AS (SELECT coalesce(a.k, b.k) AS k, b.k IS NULL AS new, a.k IS NULL AS gone FROM a FULL OUTER JOIN b ON a.k = b.k AND a.v = b.v)
SELECT k, CAST(sum(new::INT) AS BIGINT) AS added, CAST(sum(gone::INT) AS BIGINT) AS removed FROM j GROUP BY k HAVING sum(new::INT) + sum(gone::INT) > 0
ORDER BY sum(new::INT) + sum(gone::INT) DESC, k LIMIT 50"""
)
def symmetric_diff(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"), F.year("l_shipdate").alias("y"))
    return M.change_sizes(rows.where("y <= 1995").select("k", "v"), rows.where("y > 1995").select("k", "v"), "k", "v", 50)


@query(f"SELECT count(*) AS new_edges FROM (({_YEAR.format('>')}) EXCEPT ({_YEAR.format('<=')}))")
def new_edges(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"), F.year("l_shipdate").alias("y"))
    return M.new_edges(rows.where("y > 1995").select("k", "v").distinct(), rows.where("y <= 1995"), ["k", "v"]).agg(F.count("*").alias("new_edges"))


_HOPS = "SELECT DISTINCT c_nationkey AS s, (c_nationkey * 7 + c_custkey % 3) % 25 AS t FROM customer"


@query(
    f"""WITH RECURSIVE e AS ({_HOPS}),
r AS (SELECT n_nationkey AS origin, n_nationkey AS node, 0 AS distance FROM nation
  UNION SELECT origin, t, distance + 1 FROM r JOIN e ON node = s WHERE distance < 3)
SELECT origin, CAST(node AS BIGINT) AS node, min(distance) AS distance FROM r GROUP BY 1, 2"""
)
def cycle_reach3(spark, sf_dir):
    edges = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), ((F.col("c_nationkey") * 7 + F.col("c_custkey") % 3) % 25).alias("target"))
    start = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("origin"))
    return M.within_steps(edges, start, 3).select("origin", F.col("node").cast("long").alias("node"), "distance")


@query(
    """SELECT event_id, key AS name, value AS version FROM (
  SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events)"""
)
def manifest_entries(spark, sf_dir):
    manifest = F.concat(F.lit('{"dependencies":'), F.col("props"), F.lit("}"))
    files = _t(spark, sf_dir, "events").select(F.col("event_id").alias("file_path"), manifest.alias("source"))
    return M.manifest_dependencies(files).select(F.col("file_path").alias("event_id"), "name", "version")


@query(
    """SELECT c_custkey, first FROM (SELECT c_custkey, min(o_orderkey) AS first FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE o_orderstatus = 'F' GROUP BY c_custkey)"""
)
def named_function_first(spark, sf_dir):
    calls = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    return calls.join(_t(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "first")


# similarity --------------------------------------------------------------------------------------


@query(
    """WITH u AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i FROM lineitem),
n AS (SELECT o, count(*) AS n FROM u GROUP BY o),
p AS (SELECT a.o AS l, b.o AS r, count(*) AS shared FROM u a JOIN u b ON a.i = b.i AND a.o < b.o GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT l AS left, r AS right, shared, round(shared / (x.n + y.n - shared), 3) AS jaccard FROM p JOIN n x ON x.o = l JOIN n y ON y.o = r"""
)
def jaccard_twins(spark, sf_dir):
    return S.shared_items(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS i FROM lineitem)
SELECT a.i AS item_1, b.i AS item_2, count(*) AS owners FROM i a JOIN i b ON a.o = b.o AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def clump_groups(spark, sf_dir):
    return S.clumps(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 2, 3)


@query(
    """WITH c AS (SELECT user_id AS o, event_type AS i, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT DISTINCT user_id AS l, user_id + 1 AS r FROM events)
SELECT l AS left, r AS right, CAST(coalesce(sum(CASE WHEN b.n IS NOT NULL THEN least(a.n, b.n) END), 0) AS BIGINT) AS overlap
FROM p LEFT JOIN c a ON a.o = l LEFT JOIN c b ON b.o = r AND b.i = a.i GROUP BY 1, 2"""
)
def opcode_overlap(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = events.select(F.col("user_id").alias("left"), (F.col("user_id") + 1).alias("right")).distinct()
    return S.multiset_overlap(counts, pairs, "user_id", "event_type", "n")


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders)
SELECT o_custkey, o_orderkey, CAST(p AS INT) AS position FROM r WHERE p <= 4"""
)
def comparison_budget(spark, sf_dir):
    return S.within_budget(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "position")


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS v FROM lineitem), s AS (SELECT DISTINCT l_suppkey AS v, l_linenumber % 3 AS s FROM lineitem WHERE l_quantity < 5),
x AS (SELECT o, s, count(*) AS shared FROM a JOIN s USING (v) GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY shared DESC, s) AS k FROM x)
SELECT o AS l_orderkey, s AS name, shared FROM r WHERE k = 1"""
)
def restated_values(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    sets = lines.where("l_quantity < 5").select("l_suppkey", (F.col("l_linenumber") % 3).alias("name"))
    return S.nearest_set(lines, sets, "l_orderkey", "name", "l_suppkey")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    f"""WITH k AS (SELECT unnest({SEGMENTS}) AS key), d AS (SELECT c_custkey, key, levenshtein(replace(c_mktsegment, 'I', 'Y'), key) AS n FROM customer, k)
SELECT c_custkey, key FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n, key) AS r FROM d) WHERE r = 1"""
)
def levenshtein_nearest(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", T.closest_key(F.replace("c_mktsegment", F.lit("I"), F.lit("Y")), SEGMENTS).alias("key"))


@query(
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p_name || '-' || p_type), '[^a-z0-9]+'), lambda x: len(x) > 0))), ' ') AS tokens FROM part"""
)
def name_token_sets(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(T.name_tokens(F.lower(F.concat_ws("-", "p_name", "p_type")))), " ").alias("tokens"))


# modules and changes: pages stand for files, their links for imports --------------------------------


_EDGE_SQL = """(SELECT DISTINCT source, target FROM e JOIN k USING (specifier) WHERE source <> target)"""


def _paths(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of three areas, and their edges, those of every fifth page being new."""
    top = F.when(F.expr("page_id % 3 = 0"), "core").when(F.expr("page_id % 3 = 1"), "web").otherwise("tool")
    files = _t(spark, sf_dir, "pages").select("page_id", F.concat(top, F.lit("/p"), F.col("page_id"), F.lit(".ts")).alias("file_path"))
    e = _edges(spark, sf_dir).where("source <> target").select("source", "target").distinct()
    s, t = (files.select(F.col("page_id").alias(f"_{c}"), F.col("file_path").alias(f"{c}_path")) for c in ("source", "target"))
    e = e.join(s, F.col("source") == F.col("_source")).join(t, F.col("target") == F.col("_target"))
    rows = e.select(F.col("source_path").alias("source"), F.col("target_path").alias("target"), (F.col("source") % 5 == 0).alias("new"))
    return files, rows.select("source", "target"), rows.where("new").select("source", "target")


_PATHS_SQL = f"""{_EDGES_SQL}, f AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'web' ELSE 'tool' END AS area, area || '/p' || page_id || '.ts' AS file_path FROM pages),
g AS (SELECT s.file_path AS source, s.area AS s_area, t.file_path AS target, t.area AS t_area, x.source % 5 = 0 AS new FROM {_EDGE_SQL} x JOIN f s ON s.page_id = x.source JOIN f t ON t.page_id = x.target)"""


@query(
    f"""WITH {_PATHS_SQL}, r AS (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS position, count(*) OVER (PARTITION BY target) AS total FROM g)
SELECT target, source, CAST(position AS INT) AS position, total, total > 40 AS truncated FROM r WHERE position <= 40"""
)
def module_edges_in(spark, sf_dir):
    return MF.edges_in(_paths(spark, sf_dir)[1]).select("target", "source", "position", "total", "truncated")


@query(
    """WITH x AS (SELECT p_partkey % 50 AS s, p_partkey AS t, p_partkey % 5 = 0 AS new FROM part UNION ALL SELECT p_partkey, p_partkey % 7, false FROM part),
g AS (SELECT 'a' || s % 3 AS s_area, 'a' || s % 3 || '/p' || s AS source, 'a' || t % 3 || '/p' || t AS target, new FROM x WHERE s <> t),
d AS (SELECT target, count(DISTINCT source) AS importers, count(DISTINCT s_area) AS areas FROM g GROUP BY 1)
SELECT source AS file_path, g.target, o.importers, o.areas FROM g JOIN d o ON o.target = g.source LEFT JOIN d t ON t.target = g.target
WHERE new AND o.importers >= 3 AND coalesce(t.importers, 0) <= 1"""
)
def stable_to_volatile_edges(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    x = part.select((F.col("p_partkey") % 50).alias("s"), F.col("p_partkey").alias("t"), (F.col("p_partkey") % 5 == 0).alias("new"))
    x = x.unionByName(part.select(F.col("p_partkey").alias("s"), (F.col("p_partkey") % 7).alias("t"), F.lit(False).alias("new"))).where("s <> t")
    path = lambda c: F.concat(F.lit("a"), F.col(c) % 3, F.lit("/p"), F.col(c))
    g = x.select(path("s").alias("source"), path("t").alias("target"), "new")
    return MR.stable_to_volatile_edge(g.where("new").drop("new"), g.drop("new")).select("file_path", "target", "importers", "areas")


@query(
    f"""WITH {_PATHS_SQL}, old AS (SELECT * FROM g WHERE NOT new),
d AS (SELECT target, count(*) AS importers, count(DISTINCT s_area) AS areas FROM old GROUP BY 1),
c AS (SELECT source, g.target, areas, importers, row_number() OVER (PARTITION BY source ORDER BY areas DESC, importers DESC, g.target) AS r FROM g JOIN d ON d.target = g.target
  WHERE new AND t_area = 'core' AND s_area <> 'core' AND NOT EXISTS (SELECT 1 FROM old WHERE old.target = g.target AND old.s_area = g.s_area))
SELECT source AS file_path, target, areas, importers FROM c WHERE r = 1"""
)
def shared_module_consumers(spark, sf_dir):
    _, edges, fresh = _paths(spark, sf_dir)
    return MR.shared_kernel_new_consumer(fresh, edges).select("file_path", "target", "areas", "importers")


@query(
    f"""WITH {_PATHS_SQL}, n AS (SELECT DISTINCT source, t_area FROM g WHERE new), o AS (SELECT DISTINCT source, t_area FROM g WHERE NOT new)
SELECT source, count(*) AS new_areas FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source = n.source AND o.t_area = n.t_area) GROUP BY 1 HAVING count(*) >= 2"""
)
def coupling_bursts(spark, sf_dir):
    _, edges, fresh = _paths(spark, sf_dir)
    before = edges.join(fresh, ["source", "target"], "left_anti")
    return RR.efferent_coupling_burst(edges, before, 2).select("source", "new_areas")


_SURFACE_SQL = """b AS (SELECT o_custkey AS f, list_sort(list(DISTINCT l_partkey)) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY 1),
a AS (SELECT o_custkey AS f, list_sort(list(DISTINCT l_partkey)) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <> 2 GROUP BY 1)"""


@query(
    f"""WITH {_SURFACE_SQL}
SELECT CAST(f AS VARCHAR) AS file_path, len(list_filter(a.x, lambda v: NOT list_contains(b.x, v))) AS added, len(list_filter(b.x, lambda v: NOT list_contains(a.x, v))) AS removed,
  len(list_filter(a.x, lambda v: list_contains(b.x, v))) AS kept FROM a JOIN b USING (f)"""
)
def export_surface_changes(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").cast("string").alias("file_path"), F.col("l_partkey").alias("name"), "l_linenumber")
    out = MR.export_changes(rows.where("l_linenumber <= 2"), rows.where("l_linenumber <> 2"))
    return out.select("file_path", *[F.size(c).cast("long").alias(c) for c in ("added", "removed", "kept")])
