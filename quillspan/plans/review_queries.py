"""Rules, evidence, batching, caching and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions import text as T
from quillspan.operators import graph as G
from quillspan.operators import requests as Q
from quillspan.operators import review as R
from quillspan.plans.queries import _t, query

#: Events stand for candidates, their types for kinds; a rule asks about one kind.
RULES = [("click-burst", "click", True), ("view-depth", "view", True), ("purchase-size", "purchase", True), ("purchase-origin", "purchase", False), ("error-cause", "error", True)]
CATEGORIES = ("error", "purchase", "signup", "view", "click")
_RULES_SQL = "(VALUES " + ", ".join(f"('{r}', '{k}', {str(h).lower()})" for r, k, h in RULES) + ") rules(rule_id, scope, handled)"
_CATEGORY_SQL = "CASE event_type " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES)) + f" ELSE {len(CATEGORIES)} END"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the rules of their type; evidence is a value over 10, and a negative one fails."""
    rules = spark.createDataFrame(RULES, "rule_id string, scope string, handled boolean")
    events = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    evidence = events.join(F.broadcast(rules), F.col("kind") == F.col("scope"))
    evidence = evidence.select("id", "rule_id", F.when(F.col("value") > 10, F.col("value")).alias("evidence"), F.when(F.col("value") < 0, F.lit("negative")).alias("error"))
    return R.questions(events, rules, evidence)


_ASKED_SQL = f"""asked AS (SELECT event_id AS id, event_type AS kind, rule_id, handled, value,
  CASE WHEN value < 0 THEN 'failure' WHEN handled AND NOT coalesce(value > 10, false) THEN 'abstention' ELSE 'question' END AS outcome
  FROM events JOIN {_RULES_SQL} ON event_type = scope)"""


@query(f"WITH {_ASKED_SQL} SELECT rule_id, outcome, count(*) AS n FROM asked GROUP BY 1, 2")
def rule_scope_join(spark, sf_dir):
    return _asked(spark, sf_dir).groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_ASKED_SQL} SELECT rule_id, kind, count(*) AS count FROM asked WHERE outcome = 'abstention' GROUP BY 1, 2")
def abstention_counts(spark, sf_dir):
    return R.abstentions(_asked(spark, sf_dir))


@query(f"SELECT event_id, CAST(row_number() OVER (ORDER BY {_CATEGORY_SQL}, value DESC NULLS LAST, event_id) AS BIGINT) AS position FROM events")
def judgment_order(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), F.col("value").alias("probability"))
    return R.numbered(e, [*R.ranked(e, CATEGORIES), F.col("event_id")]).select("event_id", "position")


@query(f"SELECT event_id, value AS probability FROM events WHERE value >= 40 ORDER BY {_CATEGORY_SQL}, value DESC, event_id LIMIT 5")
def min_score_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), F.col("value").alias("probability")).where("probability >= 40")
    return e.orderBy(*R.ranked(e, CATEGORIES), "event_id").limit(R.SHOWN).select("event_id", "probability")


@query(
    """WITH r AS (SELECT event_type AS kind, row_number() OVER (ORDER BY CASE event_type WHEN 'module' THEN 0 WHEN 'abstraction' THEN 1 WHEN 'function' THEN 2 WHEN 'comment' THEN 3 ELSE 4 END, user_id DESC, event_id) AS p FROM events)
SELECT kind, count(*) AS candidates, CAST(sum(CASE WHEN p <= 500 THEN 1 ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN p > 500 THEN 1 ELSE 0 END) AS BIGINT) AS omitted FROM r GROUP BY kind"""
)
def coverage_omitted(spark, sf_dir):
    c = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("in_degree"), F.col("event_id").alias("start"), F.lit("").alias("file_path"))
    return R.coverage(R.cap(c, R.audit_order(c), 500))


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(len(line) AS BIGINT) AS n FROM l),
p AS (SELECT doc_id, i, n AS used, 1 AS held, CAST(0 AS BIGINT) AS batch FROM r WHERE i = 1
  UNION ALL SELECT r.doc_id, r.i, CASE WHEN held = 24 OR used + r.n > 48000 THEN r.n ELSE used + r.n END,
    CASE WHEN held = 24 OR used + r.n > 48000 THEN 1 ELSE held + 1 END, CASE WHEN held = 24 OR used + r.n > 48000 THEN batch + 1 ELSE batch END
  FROM p JOIN r ON r.doc_id = p.doc_id AND r.i = p.i + 1)
SELECT doc_id, i AS line_number, batch FROM p"""
)
def batch_packing(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    d = d.select("doc_id", (F.col("at") + 1).cast("long").alias("line_number"), F.length("line").cast("long").alias("n"))
    return R.batches(d, "doc_id", ["line_number"], "n").select("doc_id", "line_number", "batch")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def digest_dedupe(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(
    """WITH a AS (SELECT doc_id, sha256(text) AS digest, quality FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT digest, min(CAST(quality AS DOUBLE)) AS probability FROM a WHERE quality IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM a JOIN c USING (digest)) AS hits, (SELECT count(DISTINCT digest) FROM a WHERE digest NOT IN (SELECT digest FROM c)) AS misses"""
)
def cache_left_join(spark, sf_dir):
    asked = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    cache = asked.join(_t(spark, sf_dir, "labels"), "doc_id").select("digest", F.col("quality").cast("double").alias("probability"))
    hits, misses = R.split_cached(asked, cache)
    return hits.agg(F.count("*").alias("hits")).join(F.broadcast(misses.agg(F.count("*").alias("misses"))), F.lit(True))


@query(
    """SELECT shard, count(*) AS n FROM (SELECT substr(sha256(concat('1:q', CAST(len(source) AS VARCHAR), ':', source, CAST(len(CAST(doc_id AS VARCHAR)) AS VARCHAR), ':', doc_id)), 1, 2) AS shard FROM documents) GROUP BY 1"""
)
def question_digests(spark, sf_dir):
    digest = R.question_digest(F.lit("q"), F.col("source"), F.col("doc_id"))
    return _t(spark, sf_dir, "documents").groupBy(R.shard(digest).alias("shard")).agg(F.count("*").alias("n"))


@query(
    """SELECT CASE WHEN quality IS NULL THEN 'invalid' WHEN quality BETWEEN 0 AND 1 THEN 'ok' ELSE 'invalid' END AS state, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""
)
def answer_states(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(R.answer_state(F.col("quality").cast("double")).alias("state")).agg(F.count("*").alias("n"))


@query(
    """WITH d(rule_id, scope, category, message) AS (SELECT r_name, 'function', NULL, 'about ' || r_name FROM region)
SELECT rule_id, CASE WHEN rule_id = 'ASIA' THEN 'module' ELSE scope END AS scope, CASE WHEN rule_id = 'EUROPE' THEN 'security' ELSE 'maintainability' END AS category, message
FROM d WHERE rule_id <> 'AFRICA' UNION ALL SELECT 'own/rule', 'comment', 'style', 'own'"""
)
def merged_rules(spark, sf_dir):
    defaults = _t(spark, sf_dir, "region").select(F.col("r_name").alias("rule_id"), F.lit("function").alias("scope"), F.lit(None).cast("string").alias("category"), F.concat(F.lit("about "), F.col("r_name")).alias("message"))
    custom = spark.createDataFrame([("own/rule", "comment", "style", "own")], defaults.schema)
    overrides = spark.createDataFrame([("AFRICA", True, None, None, None), ("ASIA", False, "module", None, None), ("EUROPE", False, None, "security", None)], "rule_id string, off boolean, scope string, category string, message string")
    return R.merge_rules(defaults, custom, overrides)


@query(
    """SELECT rule_id, count(*) AS questions, round(sum(ms), 3) AS ms FROM (
  SELECT l_returnflag AS rule_id, CAST(l_orderkey % 100 AS DOUBLE) / count(*) OVER (PARTITION BY l_orderkey) AS ms FROM lineitem) GROUP BY 1"""
)
def rule_timings(spark, sf_dir):
    calls = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule_id"), F.col("l_orderkey").alias("batch"), (F.col("l_orderkey") % 100).cast("double").alias("batch_ms"))
    return R.timings(calls)


@query(
    """SELECT doc_id, '::notice file=' || replace(replace(source, '%', '%25'), ',', '%2C') || ',line=1::' ||
  replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS line FROM documents"""
)
def annotations(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    line = F.concat(F.lit("::notice file="), T.escape_annotation(F.col("source"), True), F.lit(",line=1::"), T.escape_annotation(F.col("text")))
    return d.select("doc_id", line.alias("line"))


@query("SELECT page_id FROM pages WHERE regexp_replace(url, '^https?://', '') LIKE 'blog.%' OR contains(url, '/en/')")
def path_scope(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "")
    p = _t(spark, sf_dir, "pages").withColumn("path", path)
    return p.where(T.in_paths(F.regexp_extract("path", r"^(blog)\.", 1), ["blog"]) | F.col("url").contains("/en/")).select("page_id")


@query(
    """SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good, bit_xor(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)) AS artifact
FROM documents JOIN labels USING (doc_id) GROUP BY source"""
)
def file_artifacts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id")
    part = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 15), 16, 10).cast("long")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.bit_xor(part).alias("artifact"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, s_suppkey + 1000 AS b FROM supplier UNION SELECT DISTINCT s_suppkey + 1000, s_nationkey FROM supplier),
r AS (SELECT a AS node, a AS least FROM e UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node)
SELECT CAST(node AS BIGINT) AS node, CAST(min(least) AS BIGINT) AS least FROM r GROUP BY 1"""
)
def components(spark, sf_dir):
    links = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") + 1000).alias("b"))
    return G.components(links)


@query(
    """SELECT conv_id, role, CAST(count(*) AS BIGINT) AS turns, CAST(sum(CASE WHEN previous = role THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM (
  SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations) GROUP BY 1, 2"""
)
def adjoining_comments(spark, sf_dir):
    previous = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    c = _t(spark, sf_dir, "conversations").select("conv_id", "role", previous.alias("previous"))
    return c.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.count_if(F.col("previous") == F.col("role")).alias("repeated"))


@query(
    """WITH p AS (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS f FROM lineitem),
n AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f, l_returnflag) - 1 AS c,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, 'part-' || l_partkey || '-' || l_suppkey) - 1 AS q FROM p)
SELECT CAST(l_orderkey AS VARCHAR) AS file_path, 'q' || q AS question_id, l_returnflag AS candidate_id, 'part-' || l_partkey || '-' || l_suppkey AS rule_id, 'candidates[' || c || ']' AS inspect,
  'candidates[' || c || ']' || CASE WHEN l_linestatus = 'F' THEN '.nearbySource' ELSE '.source' END AS context,
  CASE WHEN l_quantity > 25 THEN 'candidates[' || c || '].evidence["part-' || l_partkey || '-' || l_suppkey || '"]' END AS evidence_path FROM n"""
)
def request_questions(spark, sf_dir):
    return _named(spark, sf_dir).select("file_path", "question_id", "candidate_id", "rule_id", "inspect", "context", "evidence_path")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the questions of a batch, return flags as candidates."""
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file_path"),
        F.lit(0).alias("batch"),
        F.col("l_linenumber").alias("position"),
        F.col("l_returnflag").alias("candidate_id"),
        F.concat(F.lit("part-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey")).alias("rule_id"),
        F.when(F.col("l_linestatus") == "F", F.lit("")).alias("nearby_source"),
        F.when(F.col("l_quantity") > 25, F.lit("{}")).alias("evidence"),
    )
    return Q.questions_of(rows)


@query(
    """SELECT CAST(doc_id AS BIGINT) AS doc_id, '{"function":{"name":"' || coalesce(source, '') || '"},"note":"' || coalesce(lang, '') || '"}' AS evidence, md5(substr(coalesce(text, ''), 1, 16000)) AS module_digest FROM documents"""
)
def evidence_sections(spark, sf_dir):
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    section = F.struct(text.alias("moduleSource"), source.alias("name"), text.alias("source"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(section.alias("function"), F.coalesce("lang", F.lit("")).alias("note"))).alias("evidence"))
    return Q.compact_evidence(rows).select("doc_id", "evidence", F.md5("module_source").alias("module_digest"))


@query(
    """SELECT owner, file_path, CAST(position AS INT) AS position, true AS bounded FROM (
  SELECT a.n_name AS owner, b.n_name AS file_path, row_number() OVER (PARTITION BY a.n_name ORDER BY
    CASE WHEN a.n_name = b.n_name THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 2 END, b.n_nationkey) AS position
  FROM nation a, nation b) WHERE position <= 12"""
)
def scope_order(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    owners = n.select(F.col("n_name").alias("owner"), "n_regionkey")
    files = n.select(F.col("n_name").alias("file_path"), F.col("n_nationkey").alias("file_order"), "n_regionkey")
    return Q.scope_files(owners, files, owners.join(files, "n_regionkey"), most=12)


@query(
    """SELECT file_path, file_path || '.json' AS artifact, CAST(sum(n) AS BIGINT) AS evaluated, CAST(sum(m) AS BIGINT) AS abstained FROM (
  SELECT user_id::VARCHAR AS file_path, CASE WHEN value > 10 THEN 1 ELSE 0 END AS n, CASE WHEN value > 10 THEN 0 ELSE 1 END AS m FROM events) GROUP BY 1"""
)
def artifact_totals(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_path"), F.coalesce(F.col("value") > 10, F.lit(False)).alias("high"))
    return Q.artifact_totals(e.where("high"), e.where("not high").withColumn("count", F.lit(1).cast("long")))


@query(
    """SELECT event_type AS kind, count(*) FILTER (WHERE value > 10) || ' of ' || count(*) || ' candidates of kind ' || event_type || ' scored, ' || (count(*) - count(*) FILTER (WHERE value > 10))
  || ' omitted; coverage ' || CASE WHEN count(*) = count(*) FILTER (WHERE value > 10) THEN 'complete' ELSE 'incomplete' END AS sentence FROM events GROUP BY event_type"""
)
def coverage_sentences(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.coalesce(F.col("value") > 10, F.lit(False)).alias("asked"))
    return Q.coverage_sentence(R.coverage(e)).select("kind", "sentence")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as candidates, two line rules, abstentions left out, the five longest of each rule; nothing is scored."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))
    kind = F.when(F.col("line").rlike(r"\|"), "table").when(F.col("line").rlike("(?i)licen[cs]ed? under"), "license")
    rules = spark.createDataFrame([("long-table", "table"), ("license-line", "license")], "rule_id string, scope string")
    met = lines.withColumn("kind", kind).where("kind is not null").join(F.broadcast(rules), F.col("kind") == F.col("scope"))
    asked = met.where((F.col("kind") == "license") | (F.length("line") > 200))
    best = W.partitionBy("rule_id").orderBy(F.desc(F.length("line")), "doc_id", "line_number")
    return asked.withColumn("position", F.row_number().over(best)).where(F.col("position") <= R.SHOWN).select("rule_id", "position", "doc_id", "line_number", F.length("line").alias("n_chars"))
