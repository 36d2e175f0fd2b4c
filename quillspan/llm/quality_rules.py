"""Quality rules with thresholds that adapt to each language and source.

`measure` adds the base counts of a text, `sketch` folds the measured rates into mergeable quantile
sketches (one row for each language, source, rate and bucket; two sketches merge by adding counts),
`thresholds` reads fences from them, and `judge` joins the fences to the documents. A language and
source with too few documents takes the fence of the merged sketch of its language, else of its
source, else of all rows, so that every document that passes the base rules meets a fence.

Buckets hold integers exactly up to 127 and with a relative width of 1/64 above, so that results do
not depend on the order in which partial sketches meet.

Defined results: a null text counts as empty and fails the base rules; a null language or source is
a group of its own; a text of any length is measured whole, in the task that reads it; repeated rows
are judged one by one; an empty table gives an empty result. `keep_good` keeps all columns of its
input, whatever their names; the working columns of `measure` start with `_q_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.llm.common import join_dimension, settle, table, words

MIN_WORDS = 50
#: Rates in thousandths, and on which side of the fence a document fails.
RATES = ("symbols", "dup_lines", "repeats", "capitals", "word_length")
BOTH_SIDES = ("word_length",)
#: Fences stand this many interquartile ranges outside the quartiles, the group's own or the mean range
#: of the groups of its language, whichever is wider, but never nearer than SLACK thousandths: most texts have no symbols,
#: repeated lines or windows at all, and where copies of one text fill a group its quartiles coincide.
REACH = 4
SLACK = {"symbols": 60, "dup_lines": 500, "repeats": 250, "capitals": 20, "word_length": 750}
#: Groups with fewer documents have no stable quartiles; a wider sketch gives their fence.
MIN_GROUP = 20
#: What sketches are merged by, narrowest first. The last holds all rows and serves however few they are.
LEVELS = (("lang", "source"), ("lang",), ("source",), ())

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the rates."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumns({"_q_w": words(F.col(text)), "_q_lines": lines})
    d = d.withColumn("_q_x", F.transform("_q_w", lambda w: F.xxhash64(w)))
    n, x = F.size("_q_x"), F.col("_q_x")
    windows = F.transform(F.slice(x, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(x, i + 1), F.get(x, i + 2)))
    d = d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
            "n_symbols": (F.length(raw) - F.length(F.regexp_replace(raw, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_n_lines": F.size("_q_lines").cast("long"),
            "_q_capitals": (F.length(raw) - F.length(F.regexp_replace(raw, r"\p{Lu}", ""))).cast("long"),
            "_q_h": windows,
        }
    ).drop("_q_w", "_q_x", "_q_lines")
    # only texts in which some window recurs are sorted
    placed = F.transform(F.col("_q_h"), lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    d = d.withColumn(
        "_q_s",
        F.when(F.size(F.array_distinct("_q_h")) < F.size("_q_h"), F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")),
    )
    s, m = F.col("_q_s"), F.size("_q_s")
    twin = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
    at = F.when(m > 0, F.filter(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda k: F.coalesce(twin(k), F.lit(False)))).otherwise(F.array().cast("array<int>"))
    covered = F.flatten(F.transform(at, lambda k: F.array(F.get(s, k)["p"], F.get(s, k)["p"] + 1, F.get(s, k)["p"] + 2)))
    d = d.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).drop("_q_s", "_q_h")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rate = lambda x, y: F.when(F.col(y) > 0, F.expr(f"(1000 * {x}) div {y}")).otherwise(F.lit(0)).cast("long")
    return d.withColumns(
        {
            "_q_symbols": rate("n_symbols", "word_chars"),
            "_q_dup_lines": rate("n_dup_lines", "_q_n_lines"),
            "_q_repeats": rate("n_repeat_words", "n_words"),
            "_q_capitals": rate("_q_capitals", "word_chars"),
            "_q_word_length": rate("word_chars", "n_words"),
            # a column that the optimiser may not copy keeps it from writing all of the above into a filter, many times over
            "_q_row": F.monotonically_increasing_id(),
        }
    ).drop("_q_n_lines")


def bucket(v: Column) -> Column:
    """Bucket of a value from 0 on: the value cut to its seven leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return v - F.pmod(v, unit)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n) of the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(f"_q_{r}")).alias("bucket")) for r in RATES])
    rows = measured.where(~F.col("base_failed") & (F.col("_q_row") >= 0)).select("lang", "source", F.explode(pairs).alias("x"))
    return rows.groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows that the given sketches have seen."""
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row for each language and source: low_<rate> and high_<rate> from the first of LEVELS with MIN_GROUP documents."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), *[F.when(F.lit(c in level), F.col(c)).alias(c) for c in ("lang", "source")]) for k, level in enumerate(LEVELS)])
    wide = sketches.select(F.explode(levels).alias("g"), "rate", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "rate", "bucket").agg(F.sum("n").alias("n"))
    by = W.partitionBy("level", "lang", "source", "rate")
    ranked = wide.select(
        "*",
        F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(by).alias("total"),
    )
    quart = ranked.groupBy("level", "lang", "source", "rate").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
        F.max("total").alias("total"),
    )
    slack = F.create_map(*[F.lit(x) for r in RATES for x in (r, SLACK[r])])
    quart = quart.withColumn("own", F.col("q3") - F.col("q1"))
    peers = W.partitionBy("level", "lang", "rate")
    mean = F.floor(F.sum(F.col("own") * F.col("total")).over(peers) / F.sum("total").over(peers))
    quart = quart.withColumn("spread", F.when(F.col("level") == 0, F.greatest("own", mean)).otherwise(F.col("own")))
    reach = F.greatest(REACH * F.col("spread"), F.element_at(slack, F.col("rate")).cast("long"))
    sides = quart.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    pick = lambda side, r: F.max(F.when(F.col("rate") == r, F.col(side))).alias(f"_q_{side}_{r}")
    fences = [*[pick("high", r) for r in RATES], *[pick("low", r) for r in BOTH_SIDES]]
    found = settle(sides.groupBy("level", "lang", "source").agg(F.struct(*fences).alias("fence"), F.max("total").alias("total")))
    out = found.where("level = 0").select("lang", "source", F.when(F.col("total") >= MIN_GROUP, F.col("fence")).alias("fence"))
    for k, level in enumerate(LEVELS[1:], 1):
        wider = found.where((F.col("level") == k) & (F.lit(not level) | (F.col("total") >= MIN_GROUP)))
        wider = wider.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("fence").alias("_wider"))
        same = F.lit(True)
        for c in level:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(wider if level else F.broadcast(wider), same, "left").select("lang", "source", F.coalesce("fence", "_wider").alias("fence"))
    return out.select("lang", "source", "fence.*")


def judge(measured: DataFrame, fences: DataFrame, spread: Column) -> DataFrame:
    """Adds kept: false if the base rules failed or a rate stands outside its group's fence.

    `fences` must come from sketches that have seen each language and source; kept is null where they have not.
    """
    d = join_dimension(measured, fences, ["lang", "source"], spread=spread)
    inside = ~F.col("base_failed") & (F.col("_q_row") >= 0)
    for r in RATES:
        inside = inside & (F.col(f"_q_{r}") <= F.col(f"_q_high_{r}"))
    for r in BOTH_SIDES:
        inside = inside & (F.col(f"_q_{r}") >= F.col(f"_q_low_{r}"))
    d = d.withColumn("kept", inside)
    return d.drop(*[c for c in d.columns if c.startswith("_q_")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row, without its text: doc_id, lang, source, the counts, base_failed, kept."""
    seen = settle(measure(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    fences = settle(thresholds(sketch(seen)))
    return judge(seen, fences, F.col("doc_id"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs`."""
    fences = settle(thresholds(sketch(measure(docs.select("lang", "source", "text")))))
    whole = docs.select("lang", "source", "text", F.struct(*docs.columns).alias("_row"))  # so that no column of docs is lost
    return judge(measure(whole), fences, F.xxhash64("text")).where("kept").select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
