"""Spans: candidates of a text, overlap with changed lines, enclosure, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import code_lines

#: What a line must hold to be a candidate of a kind, tried in this order.
LINE_KINDS = (
    ("comment", r"^\s*(//|/\*|\*|#)"),
    ("abstraction", r"^\s*(export\s+)?(default\s+)?(abstract\s+)?(class|interface|type|enum)\s+\w"),
    ("function", r"^\s*(export\s+)?(default\s+)?(async\s+)?function\b|^\s*(export\s+)?const\s+\w+\s*=\s*(async\s*)?\([^)]*\)\s*(:[^=]+)?=>"),
)


def lines(files: DataFrame, path: str = "file_path", source: str = "source") -> DataFrame:
    """(path, line_number from 1, start offset, line) of each file."""
    parts = files.select(path, F.posexplode(F.split(F.col(source), "\n")).alias("_pos", "line"))
    upto = W.partitionBy(path).orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(upto), F.lit(0))
    return parts.select(path, (F.col("_pos") + 1).alias("line_number"), start.cast("long").alias("start"), "line")


def candidates(files: DataFrame) -> DataFrame:
    """Comments, functions and abstractions as spans, numbered per file in (start, end) order.

    A comment is a maximal run of comment lines. A function or abstraction reaches from its first
    line to the line on which the depth of braces falls back to where it began, found by a running
    sum over the file's lines. Braces in strings and comments do not count.
    """
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(LINE_KINDS):
        kind = F.when(F.col("line").rlike(pattern), F.lit(name)).otherwise(kind)
    both = F.arrays_zip(F.split("source", "\n").alias("line"), F.split(code_lines(F.col("source")), "\n").alias("code"))
    rows = files.select("file_path", F.posexplode(both).alias("at", "x")).select("file_path", (F.col("at") + 1).alias("line_number"), "x.line", "x.code").withColumn("kind", kind)
    braces = F.length(F.regexp_replace("code", "[^{]", "")) - F.length(F.regexp_replace("code", "[^}]", ""))
    rows = rows.withColumn("braces", braces)
    order = W.partitionBy("file_path").orderBy("line_number")
    rows = rows.withColumn("after", F.sum("braces").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumns({"before": F.col("after") - F.col("braces"), "previous": F.lag("kind").over(order)})
    starts_comment = (F.col("kind") == "comment") & ~F.col("previous").eqNullSafe(F.lit("comment"))
    run = F.sum(starts_comment.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    comments = rows.withColumn("run", run).where("kind = 'comment'").groupBy("file_path", "run")
    comments = comments.agg(F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line")).select("file_path", F.lit("comment").alias("kind"), "start_line", "end_line")
    # a line that ends at a lower depth closes each depth in between; a head ends with the next line that closes its own
    heads = rows.where("kind in ('function', 'abstraction')").select("file_path", F.col("before").alias("depth"), "line_number", "kind", (F.col("after") <= F.col("before")).alias("closed"))
    closing = rows.where("after < before").select("file_path", F.explode(F.sequence("after", F.col("before") - 1)).alias("depth"), "line_number", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("closed"))
    level = W.partitionBy("file_path", "depth").orderBy("line_number")
    ends = F.min(F.when(F.col("kind").isNull(), F.col("line_number"))).over(level.rangeBetween(1, W.unboundedFollowing))
    blocks = heads.unionByName(closing).withColumn("end_line", F.when(F.col("closed"), F.col("line_number")).otherwise(ends))
    blocks = blocks.where("kind is not null and end_line is not null").select("file_path", "kind", F.col("line_number").alias("start_line"), "end_line")
    number = F.row_number().over(W.partitionBy("file_path").orderBy("start_line", "end_line", "kind")) - 1
    return comments.unionByName(blocks).withColumn("id", F.concat(F.lit("candidate_"), number.cast("string")))


def overlapping(spans: DataFrame, ranges: DataFrame, on: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """The spans that share a line with a range (columns `on`, start, end) of the same file."""
    r = ranges.select(F.col(on).alias("_on"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return spans.join(r, (spans[on] == r["_on"]) & (spans[start] <= r["_end"]) & (spans[end] >= r["_start"]), "left_semi")


def innermost(sites: DataFrame, spans: DataFrame, on: str, at: str, site_key: list[str]) -> DataFrame:
    """Each site with the narrowest span (columns `on`, span_id, start, end) that holds it, the smaller id among equals."""
    s = spans.select(F.col(on).alias("_on"), "span_id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    met = sites.join(s, (sites[on] == s["_on"]) & (sites[at] >= s["_start"]) & (sites[at] <= s["_end"]))
    best = F.min(F.struct((F.col("_end") - F.col("_start")).alias("width"), F.col("span_id"))).alias("best")
    return met.groupBy(*site_key).agg(best).select(*site_key, F.col("best.span_id").alias("span_id"), F.col("best.width").alias("width"))


def outside(nodes: DataFrame, spans: DataFrame, on: str, at: str) -> DataFrame:
    """The nodes that no span of the same file holds."""
    s = spans.select(F.col(on).alias("_on"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return nodes.join(s, (nodes[on] == s["_on"]) & (nodes[at] >= s["_start"]) & (nodes[at] <= s["_end"]), "left_anti")


def most_alive(spans: DataFrame, on: str) -> DataFrame:
    """For each key, how many of its spans [start, end] are open at once at most: a sweep over their ends."""
    edge = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("step"))))
    steps = spans.select(on, edge.alias("e")).groupBy(on, "e.at").agg(F.sum("e.step").alias("step"))
    live = F.sum("step").over(W.partitionBy(on).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumn("live", live).groupBy(on).agg(F.max("live").alias("most_alive"))


def hunks(diffs: DataFrame, on: str, diff: str) -> DataFrame:
    """(on, start, end) of the new side of each hunk header of unified diffs; hunks that only delete go."""
    header = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"
    rows = diffs.select(on, F.explode(F.regexp_extract_all(F.col(diff), F.lit(header), F.lit(1))).alias("side"))
    part = F.split("side", ",")
    count = F.coalesce(F.get(part, F.lit(1)).cast("long"), F.lit(1))
    first = F.get(part, F.lit(0)).cast("long")
    return rows.select(on, first.alias("start"), (first + count - 1).alias("end"), count.alias("n")).where("n > 0").drop("n")


def whole_file(files: DataFrame, path: str = "file_path", source: str = "source") -> DataFrame:
    """(path, start, end): all lines of a file as one range; a line feed at the end opens no line."""
    text = F.regexp_replace(F.col(source), "\n$", "")
    return files.select(path, F.lit(1).alias("start"), F.size(F.split(text, "\n")).alias("end"))
