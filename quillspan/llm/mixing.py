"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source whose target is r times its size takes floor(r) copies of each document and one more with
probability r - floor(r). The extra copies are not drawn independently: two documents of a source
at a time duel, one gaining the words that the other gives up until one of them is certain (0 or 1),
so that the expected words of the source never move. The undecided document goes on to the next
duel. Duels run inside groups of about FAN documents; each group passes on one undecided document,
and those meet in groups again: a reduction tree of depth log_FAN(documents). What a source takes
so differs from its target by less than its longest document.

Random draws are hashes of the seed and the document, so that reruns agree; rows that share doc_id,
source and size are told apart by their texts.

Defined results: a null text has size 0, and documents of size 0 take nothing; a null source is a
source of its own, the last one; texts of any length count whole; repeated rows (also of a null doc_id) are mixed as documents of
their own; an empty table gives an empty result. Columns of the input other than doc_id, text and
source are not read by `mix` and are kept by `take_copies`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.llm.common import free_prefix, join_dimension, let, settle, table, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
FAN = 128
#: Probabilities nearer to 0 or 1 than this are taken as certain.
SURE = 1e-9


def source_order(sources: DataFrame) -> DataFrame:
    """Adds rank (from 0) by code point, null last, to a table of distinct sources, without gathering it in one task."""
    placed = settle(
        sources.repartitionByRange(F.col("source").isNull(), "source")
        .sortWithinPartitions(F.col("source").isNull(), "source")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").withColumn("rank", rank).drop("_part", "_at", "_n", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from documents with source and size.

    Sources weigh `weights` by turns and share all words; a target stops at `most` times its
    source's size, and what is over is shared again by weight until none is above.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = settle(source_order(settle(by_source)).withColumn("weight", turn).withColumn("most", F.col("source_size") * most))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each turn fills at least one more source; only three numbers reach the driver
        over = F.col("most") <= F.col("weight") * F.lit(level) if full >= 0 else F.lit(False)
        n, kept, free = s.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not free or (n or 0) == full:
            break
        full, level = n or 0, (total - (kept or 0)) / free
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level)))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def _draw(doc: Column, seed: int) -> Column:
    """A number from 0 to 1 (not 1) for a document."""
    return F.pmod(F.xxhash64(F.lit(seed), doc["doc_id"], doc["tie"], doc["size"]), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _duel(one: Column, two: Column, draw: Column) -> Column:
    """Both documents after mass moved between them, the certain one first."""
    moved = F.struct(
        F.least((1 - one["p"]) * one["size"], two["p"] * two["size"]).alias("up"),
        F.least(one["p"] * one["size"], (1 - two["p"]) * two["size"]).alias("down"),
    )

    def after(m: Column) -> Column:
        shift = F.when(draw * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"])
        return let(shift, lambda t: F.struct(_sure(one["p"] + t / one["size"]).alias("p1"), _sure(two["p"] - t / two["size"]).alias("p2")))

    def order(q: Column) -> Column:
        a, b = one.withField("p", q["p1"]), two.withField("p", q["p2"])
        return F.when(q["p1"].isin(0.0, 1.0), F.struct(a.alias("out"), b.alias("on"))).otherwise(F.struct(b.alias("out"), a.alias("on")))

    return let(let(moved, after), order)


def _sure(p: Column) -> Column:
    return F.when(p < SURE, F.lit(0.0)).when(p > 1 - SURE, F.lit(1.0)).otherwise(p)


def _round_group(docs: Column, seed: int) -> Column:
    """Folds an array of documents: out holds the certain ones, on the one that goes on."""
    kind = "struct<doc_id:bigint,tie:int,size:bigint,p:double>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.get(docs, F.lit(0)).alias("on"))

    def step(acc: Column, doc: Column) -> Column:
        met = F.when(acc["on"]["p"].isin(0.0, 1.0), F.struct(acc["on"].alias("out"), doc.alias("on"))).otherwise(_duel(acc["on"], doc, _draw(doc, seed)))
        return let(met, lambda m: F.struct(F.concat(acc["out"], F.array(m["out"])).alias("out"), m["on"].alias("on")))

    return F.aggregate(F.slice(docs, F.lit(2), F.size(docs)), start, step)


def mix(docs: DataFrame, seed: int = 10, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, tie (number of the row among rows of equal doc_id, source and size, by the hash of their
    texts), source, size, source_size, target, copies and taken of each row of `docs`."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    tie = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy("digest"))
    sized = settle(sized.withColumn("tie", tie).drop("digest"))
    goals = settle(targets(sized, weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(ratio - F.round(ratio)) < SURE, F.round(ratio)).otherwise(ratio)
    goals = goals.withColumn("ratio", near).withColumns({"whole": F.floor("ratio"), "p": F.col("ratio") - F.floor("ratio")})
    rows = join_dimension(sized, goals, ["source"], spread=F.struct("doc_id", "tie"))
    keys = ["source", "source_size", "n_docs", "target", "whole"]
    doc = F.struct("doc_id", "tie", "size", "p")
    certain = rows.where((F.col("size") == 0) | (F.col("p") == 0)).select(*keys, doc.alias("doc"), F.lit(0.0).alias("extra"))

    most_docs = goals.agg(F.max("n_docs")).first()[0] or 0
    depth = max(1, math.ceil(math.log(max(most_docs, 2), FAN)))
    spans = F.ceil(F.col("n_docs") / F.lit(FAN))
    open_docs = rows.where((F.col("size") > 0) & (F.col("p") > 0)).select(
        *keys, doc.alias("doc"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "tie", "size"), spans).alias("bucket")
    )
    done = [certain]
    for level in range(depth + 1):
        # the longest duel first, so that what is left undecided tends to be short
        order = F.struct((-F.col("doc.size")).alias("long"), _draw(F.col("doc"), seed + 2 + level).alias("u"), F.col("doc"))
        groups = open_docs.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(order)).alias("docs"))
        folded = settle(groups.withColumn("r", _round_group(F.col("docs.doc"), seed + 100 + level)).select(*keys, "bucket", "r"))
        done.append(folded.select(*keys, F.explode("r.out").alias("doc"), F.col("doc.p").alias("extra")))
        open_docs = folded.select(*keys, F.col("r.on").alias("doc"), F.expr(f"bucket div {FAN}").alias("bucket"))
    last = F.when(_draw(F.col("doc"), seed + 99) < F.col("doc.p"), F.lit(1.0)).otherwise(F.lit(0.0))
    done.append(open_docs.select(*keys, "doc", last.alias("extra")))

    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("doc.size") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("doc.doc_id", "doc.tie", "source", "doc.size", "source_size", "target", copies.alias("copies"), (copies * F.col("doc.size")).alias("taken"))


def take_copies(docs: DataFrame, seed: int = 10) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with the columns of `docs`."""
    p = free_prefix(docs.columns)
    key = ("doc_id", "source", "size", "tie")
    here = docs.withColumns({f"{p}doc_id": F.col("doc_id"), f"{p}source": F.col("source"), f"{p}size": word_count(F.col("text")), f"{p}digest": F.xxhash64("text")})
    here = here.withColumn(f"{p}tie", F.row_number().over(W.partitionBy(f"{p}doc_id", f"{p}source", f"{p}size").orderBy(f"{p}digest")))
    took = mix(docs, seed).where("copies > 0").select(*[F.col(c).alias(f"{p}t_{c}") for c in (*key, "copies")])
    same = F.lit(True)
    for c in key:
        same = same & F.col(p + c).eqNullSafe(F.col(f"{p}t_{c}"))
    twice = here.join(took, same).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}t_copies").cast("int"))))
    return twice.select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
