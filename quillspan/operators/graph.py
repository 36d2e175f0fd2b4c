"""Connected parts of a graph: of links, and of directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import checkpoint_folder, stored


def components(links: DataFrame) -> DataFrame:
    """(node, least): each node of `links` (a, b: of one ordered type) and the least node that it is connected with.

    Every round gives each node the least label among its own, its neighbours' and its label's label,
    which halves paths; rounds end when no label changes. Only that count reaches the driver.
    """
    checkpoint_folder(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("least")).checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("least").alias("n"))
        jump = labels.select(F.col("node").alias("_l"), F.col("least").alias("j"))
        step = labels.join(near, labels["node"] == near["a"], "left").join(jump, F.col("least") == F.col("_l"), "left")
        step = step.select("node", F.least("least", F.coalesce("n", "least"), F.coalesce("j", "least")).alias("new"), "least").checkpoint()
        if step.where("new <> least").isEmpty():
            return step.select("node", F.col("new").alias("least"))
        labels = step.select("node", F.col("new").alias("least"))


def _spread(edges: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """(node, f, b): the least label among the nodes from which `node` is reached by `edges` (s, t), and among those that
    it reaches, itself included.

    Nodes are longs and so are labels: the nodes themselves for `salt` 0, else their hashes, which differ, as xxhash64 maps
    one long to one long and no two to the same. Both ways are gone at once, the way back as edges of a second graph. A node
    also takes its label's label, which a path leads from as well, so that labels travel twice as far each round.
    """
    own = F.xxhash64(F.lit(salt), F.col("node")) if salt else F.col("node")
    ways = lambda w: F.lit(w).alias("way")
    itself = nodes.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.col("node").alias("s"), F.col("node").alias("t"))
    both = stored(edges.select(ways(0), "s", "t").unionByName(edges.select(ways(1), F.col("t").alias("s"), F.col("s").alias("t"))).unionByName(itself))
    labels = itself.select("way", F.col("s").alias("node")).withColumn("label", own)

    def once(now: DataFrame) -> DataFrame:
        near = both.join(now.withColumnRenamed("node", "s"), ["way", "s"]).groupBy("way", F.col("t").alias("node")).agg(F.min("label").alias("met"))
        jump = now.select("way", own.alias("met"), F.col("label").alias("more"))
        return near.join(jump, ["way", "met"]).select("way", "node", F.least("met", "more").alias("label"))

    while True:
        step = stored(once(once(labels)).withColumnRenamed("label", "new").join(labels, ["way", "node"]))
        labels = step.select("way", "node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            break
    return labels.where("way = 0").select("node", F.col("label").alias("f")).join(labels.where("way = 1").select("node", F.col("label").alias("b")), "node")


def _trimmed(e: DataFrame) -> DataFrame:
    """`e` (s, t) without edges from nodes that have no way in, or to nodes that have no way out; such are on no circle."""
    for _ in range(2):
        e = e.join(e.select(F.col("t").alias("s")).distinct(), "s", "left_semi")
        e = stored(e.join(e.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t"))
    return e


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of `edges` (source, target) that lie on circles, and one node for each set of nodes that reach each other.

    A round colours each node by the least node that it is reached from and by the least one that it reaches. Where
    both are the same node, the node belongs to that one's component; edges between other colours lie on no
    circle and go. In the first round nodes with many ways in and out are least, which lie in large components most
    likely; then orders are drawn anew each round, so that the rest falls apart quickly, however long its paths are.
    No row holds more than a node, an edge and their colours.
    """
    e = edges.select(F.col("source").alias("s"), F.col("target").alias("t"))
    loops = e.where("s = t").select(F.col("s").alias("node"), F.col("s").alias("root")).distinct()
    e = _trimmed(stored(e.where("s <> t").distinct()))
    one, zero = F.lit(1), F.lit(0)
    ends = e.select(F.col("s").alias("name"), one.alias("out"), zero.alias("in")).unionByName(e.select(F.col("t").alias("name"), zero.alias("out"), one.alias("in")))
    ranked = ends.groupBy("name").agg(F.least(F.sum("out"), F.sum("in")).alias("ways")).orderBy(F.desc("ways"), F.xxhash64("name"))
    names = stored(ranked.select("name", F.monotonically_increasing_id().alias("node")))  # stored, as the numbers of a rerun may differ
    e = e.join(names.select(F.col("name").alias("s"), F.col("node").alias("_s")), "s").join(names.select(F.col("name").alias("t"), F.col("node").alias("_t")), "t")
    e, nodes = stored(e.select(F.col("_s").alias("s"), F.col("_t").alias("t"))), names.select("node")
    done, salt = nodes.where("false").select("node", zero.alias("salt"), F.col("node").alias("f")), 0
    while not e.isEmpty():
        colours = stored(_spread(e, nodes, salt))
        done = done.unionByName(colours.where("f = b").select("node", F.lit(salt).alias("salt"), "f"))
        left = colours.where("f <> b")
        from_ = left.select(F.col("node").alias("s"), F.col("f").alias("f1"), F.col("b").alias("b1"))
        to = left.select(F.col("node").alias("t"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        e = _trimmed(e.join(from_, "s").join(to, "t").where("f1 = f2 and b1 = b2").select("s", "t"))
        nodes, salt = e.select(F.col("s").alias("node")).unionByName(e.select(F.col("t").alias("node"))).distinct(), salt + 1
    # a node alone in its component is on no circle, unless it has an edge to itself
    found = stored(done.join(names, "node").select("name", "salt", "f"))
    sizes = found.groupBy("salt", "f").agg(F.count("*").alias("n"), F.min("name").alias("root")).where("n > 1")
    found = found.join(sizes, ["salt", "f"]).select(F.col("name").alias("node"), "root")
    return stored(found.unionByName(loops.join(found.select("node"), "node", "left_anti").select("node", "root")))
