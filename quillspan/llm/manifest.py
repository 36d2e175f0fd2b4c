"""A Merkle manifest of a table of documents, with lookup proofs by coordinates.

Each document is a leaf; the leaves of a language, by doc_id, are the bottom of a tree whose nodes
hash up to FAN nodes below them; the roots of these trees are the leaves of one more tree. A node
has coordinates: its tree, its level and its index there. Which coordinates the proof of a leaf needs
follows from the leaf's index and the number of leaves alone, so that leaves ask for them without
knowing any node: they explode the coordinates of their siblings, which are joined with the table of
nodes and gathered in order. The leaves of a run share all siblings above the run, so that a run asks
once for its up to FAN leaves; within the run the siblings are at hand. Nodes near the root, for
which very many runs ask, are few: the levels that hold up to BROADCAST_ROWS nodes are broadcast,
below them no node is asked for by more than a small part of the runs.

Leaves are numbered over all partitions of a range-sorted table, so that a language with a third of
all rows stays spread over the cluster.

Defined results: nulls are written as `-`, other values with their length in bytes; null doc_ids come
first, rows of one doc_id by their leaf, equal rows (any of them first) have equal leaves; texts of
any length are hashed whole; a null language is a language of its own, the first; a tree of one leaf
has that leaf as its root and no siblings; an empty table gives an empty result. Columns other than
doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.llm.common import BROADCAST_ROWS, join_dimension, settle, table

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(value: Column) -> Column:
    """A value as it goes into a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(docs: DataFrame, text: Column | None = None) -> Column:
    """Digest (32 bytes) of each row, with another text if one is given."""
    fields = [written(text if f == "text" and text is not None else docs[f]) for f in FIELDS]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, h, doc_id, changed): each row's tree (its language; the empty string for null, so that it is
    first), digest, and, where `tampered` is true, its digest with A-Z of the text lower-cased."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    changed = F.when(tampered, leaf_hash(docs, F.translate(docs["text"], UPPER, LOWER))) if tampered is not None else F.lit(None).cast("binary")
    return docs.select(tree.alias("tree"), leaf_hash(docs).alias("h"), "doc_id", changed.alias("changed"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, from 0 within each tree by `order` (nulls first), and n, the rows of the tree."""
    at = F.col("_at")
    # equal rows are told apart by where they were read, so that they do not all go to one partition
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = spread.repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie").drop("_tie")
    placed = settle(placed.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit((1 << 33) - 1))})
    spans = placed.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = W.partitionBy("tree")  # a tree has a row for each partition that it reaches into
    spans = spans.withColumns({"_before": F.sum("_n").over(whole.orderBy("_part")) - F.col("_n"), "n": F.sum("_n").over(whole)})
    out = join_dimension(placed, settle(spans.drop("_n")), ["tree", "_part"], spread=at)
    return out.withColumn("idx", F.col("_before") + F.col("_row") - F.col("_first")).drop("_at", "_part", "_row", "_first", "_before")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def _above(n: Column, levels: Column, fan: int) -> Column:
    """Nodes that a tree of n leaves has `levels` levels above them."""
    power = _power(levels, fan)
    return _div(n + power - 1, power)


def _power(level: Column, fan: int) -> Column:
    return F.get(F.array(*[F.lit(fan**k).cast("long") for k in range(_highest(fan))]), level.cast("int"))


def _highest(fan: int) -> int:
    """Levels after which fan to their power is no long any more."""
    k = 0
    while fan**k < 1 << 62:
        k += 1
    return k


def depth_of(n: Column, fan: int) -> Column:
    """Levels of hashing between the leaves and the root of a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(fan**k).cast("long") for k in range(_highest(fan))]), lambda p: p < n))


class Tree:
    """The nodes of all trees of numbered leaves, and the siblings of each leaf.

    `found` has tree, h, idx, n and whatever else goes with a leaf.
    """

    def __init__(self, found: DataFrame, fan: int = FAN):
        self.fan = fan
        payload = [c for c in found.columns if c not in ("tree", "n")]
        kid = F.struct("idx", *[c for c in payload if c != "idx"])
        grouped = found.groupBy("tree", "n", _div(F.col("idx"), fan).alias("run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        self.runs = settle(grouped)  # up to `fan` leaves a row
        self.trees = settle(self.runs.where("run = 0").select("tree", "n", F.col("kids")[0]["h"].alias("only")))
        most = self.trees.agg(F.max("n")).first()[0] or 0
        self.counts: list[int] = []  # nodes of level 1 and up, over all trees
        level, kids = self.runs.where("n > 1").select("tree", "n", "run", F.col("kids.h").alias("hs")), 1
        nodes = []
        while most > 1:
            joined = F.array_join(F.transform("hs", hex_of), "")
            here = settle(level.select("tree", F.lit(kids).alias("level"), F.col("run").alias("idx"), _div(F.col("n") + (fan - 1), fan).alias("n"), F.unhex(F.sha2(joined, 256)).alias("h")))
            nodes.append(here)
            self.counts.append(here.count())
            above = here.where("n > 1").groupBy("tree", "n", _div(F.col("idx"), fan).alias("run"))
            level = above.agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("hs")).withColumn("hs", F.col("hs.h"))
            kids, most = kids + 1, -(-most // fan)
        self.nodes = nodes

    def roots(self) -> DataFrame:
        """(tree, root) of each tree."""
        out = self.trees.where("n = 1").select("tree", F.col("only").alias("root"))
        for here in self.nodes:
            out = out.unionByName(here.where("n = 1").select("tree", F.col("h").alias("root")))
        return out

    def _asked(self, low: int, high: int | None) -> DataFrame:
        """Coordinates of the siblings on levels from `low` to under `high` that each run needs."""
        fan, depth = self.fan, depth_of(F.col("n"), self.fan)
        last = depth - 1 if high is None else F.least(depth - 1, F.lit(high - 1))

        def siblings(level: Column) -> Column:
            own = _div(F.col("run"), _power(level - 1, fan))
            first = _div(own, fan) * fan
            stop = F.least(first + (fan - 1), _above(F.col("n"), level, fan) - 1)
            return F.transform(F.filter(F.sequence(first, stop), lambda i: i != own), lambda i: F.struct(level.alias("level"), i.alias("idx")))

        wanted = F.when(last >= low, F.flatten(F.transform(F.sequence(F.lit(low), last), siblings)))
        return self.runs.select("tree", "run", F.explode(wanted).alias("c")).select("tree", "run", "c.level", "c.idx")

    def gathered(self) -> DataFrame:
        """(tree, run, sibs): level, idx and h of all siblings above each run, in order."""
        high = len(self.nodes)  # from level high + 1 on, nodes are broadcast
        while high and sum(self.counts[high - 1 :]) <= BROADCAST_ROWS:
            high -= 1
        parts = []
        for asked, nodes, few in ((self._asked(1, high + 1), self.nodes[:high], False), (self._asked(high + 1, None), self.nodes[high:], True)):
            if nodes:
                there = nodes[0]
                for more in nodes[1:]:
                    there = there.unionByName(more)
                there = there.select("tree", "level", "idx", "h")
                parts.append(asked.join(F.broadcast(there) if few else there, ["tree", "level", "idx"]))
        if not parts:
            return self.runs.select("tree", "run").where("false").withColumn("sibs", F.array().cast("array<struct<level:int,idx:bigint,h:binary>>"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("level", "idx", "h"))).alias("sibs"))

    def proofs(self) -> DataFrame:
        """Each leaf with what came with it, and `path`: for each level, from below, the digests of the siblings
        to the left and to the right, joined."""
        fan = self.fan
        rows = self.runs.join(self.gathered(), ["tree", "run"], "left")

        def side(sibs: Column, keep) -> Column:
            return F.array_join(F.transform(F.filter(sibs, keep), lambda s: hex_of(s["h"])), "")

        def of_level(level: Column) -> Column:
            own = _div(F.col("run"), _power(level - 1, fan))
            here = lambda s: s["level"] == level
            left = side(F.col("sibs"), lambda s: here(s) & (s["idx"] < own))
            right = side(F.col("sibs"), lambda s: here(s) & (s["idx"] > own))
            return F.struct(left.alias("left"), right.alias("right"))

        depth = depth_of(F.col("n"), fan)
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        upper = F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), of_level)).otherwise(nothing)
        rows = rows.select("tree", "n", "kids", upper.alias("upper"))
        rows = rows.select("tree", "n", "upper", "kids", F.explode("kids").alias("kid"))
        left = side(F.col("kids"), lambda s: s["idx"] < F.col("kid.idx"))
        right = side(F.col("kids"), lambda s: s["idx"] > F.col("kid.idx"))
        own = F.array(F.struct(left.alias("left"), right.alias("right")))
        return rows.select("tree", "kid.*", F.when(F.col("n") > 1, F.concat(own, F.col("upper"))).otherwise(nothing).alias("path"))


def fold(digest: Column, path: Column) -> Column:
    """Root (hex) that a leaf's digest (hex) gives with the siblings of its path."""
    return F.aggregate(path, digest, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, changed (the leaf after tampering, else null), subroot, root (digests in hex) and path of each row."""
    below = Tree(numbered(settle(leaves(docs, tampered)), ["doc_id", "h"]), fan)  # each text is hashed once
    roots = settle(below.roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("h")))
    top = Tree(numbered(roots, ["of"]), fan)
    root = top.roots().select(hex_of("root")).first()
    paths = settle(top.proofs().select(F.col("of").alias("tree"), hex_of("h").alias("subroot"), F.col("path").alias("upper")))
    rows = join_dimension(below.proofs(), paths, ["tree"], spread=F.col("h"))
    whole = F.concat("path", "upper").alias("path")
    return rows.select("doc_id", hex_of("h").alias("leaf"), hex_of("changed").alias("changed"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), whole)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC32 = """(list_reduce(list_prepend(4294967295::BIGINT, flatten([[((ord(c) >> i) & 1)::BIGINT FOR i IN [0, 1, 2, 3, 4, 5, 6, 7]] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END))"""


def _sql_leaf(text: str) -> str:
    fields = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


ORACLE_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("text")} AS leaf,
        CASE WHEN xor({_CRC32}, 4294967295) % 3 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
    FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
low(tree, level, idx, n, h) AS (
    SELECT tree, 0, idx, n, leaf FROM l
    UNION ALL
    SELECT tree, level + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // {FAN}, n),
t AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
top(level, idx, n, h) AS (
    SELECT 0, idx, n, subroot FROM t
    UNION ALL
    SELECT level + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // {FAN}, n),
up AS MATERIALIZED (
    SELECT 'l' || tree AS tree, 0 AS part, level, idx, n, h FROM low WHERE n > 1
    UNION ALL SELECT 't', 1, level, idx, n, h FROM top WHERE n > 1),
steps AS (
    SELECT tree, part, level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
    FROM up a JOIN up b USING (tree, part, level) WHERE a.idx // {FAN} = b.idx // {FAN} GROUP BY tree, part, level, a.idx),
p AS (
    SELECT l.r, string_agg(s.l || s.r, '' ORDER BY s.part, s.level) AS siblings, list({{'l': s.l, 'r': s.r}} ORDER BY s.part, s.level) AS path
    FROM l JOIN t USING (tree)
    JOIN steps s ON (s.part = 0 AND s.tree = 'l' || l.tree AND s.idx = l.idx // CAST(pow({FAN}, s.level) AS BIGINT)) OR (s.part = 1 AND s.idx = t.idx // CAST(pow({FAN}, s.level) AS BIGINT))
    GROUP BY l.r),
f AS (
    SELECT doc_id, leaf, t.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
        list_reduce(list_prepend({{'l': coalesce(changed, leaf), 'r': ''}}, coalesce(path, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
    FROM l JOIN t USING (tree) LEFT JOIN p USING (r))
SELECT *, folded_root = root AS verified FROM f
"""
