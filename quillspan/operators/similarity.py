"""Similarity within bounds: shared names, statement overlap, clumps, value sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.operators.graph import components
from quillspan.operators.near_sets import compared, near_at_all, sketched
from quillspan.session import dealt, stored


#: Sets of up to so many items are indexed by pairs of items, larger ones by single items.
PAIRED = 64


def _ordered(rows: DataFrame) -> DataFrame:
    """(o, x): the items of each owner in `rows` (o, i) with how many owners they have (n, i), rarest first."""
    counts = rows.groupBy("i").agg(F.count("*").alias("n"))
    return rows.join(counts, "i").groupBy("o").agg(F.sort_array(F.collect_list(F.struct("n", "i"))).alias("x"))


def meeting_pairs(ordered: DataFrame, least: int) -> DataFrame:
    """(left, right): owners of `ordered` sets that may share `least` items, among them all that do.

    Of two such owners of n items, two of the n - least + 2 rarest of each are among those of the other, so that sets
    of up to PAIRED items meet by pairs of these, of which few are common. Larger sets, and all where one item is
    enough, meet by one of the n - least + 1 rarest.
    """
    rarest = lambda more: F.filter(F.slice("x", F.lit(1), F.size("x") - (least - more)), lambda e: e["n"] > 1)

    def meeting(one: DataFrame, other: DataFrame) -> DataFrame:
        met = one.select(F.col("key").alias("_k"), F.col("o").alias("_a")).join(other.select(F.col("key").alias("_j"), F.col("o").alias("_b")), F.col("_k") == F.col("_j"))
        return met.where("_a <> _b").select(F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"))

    single = ordered.select("o", F.size("x").alias("size"), F.explode(rarest(1)).alias("e")).select("o", "size", F.col("e.i").alias("key"))
    if least == 1:
        return meeting(single, single).distinct()
    prefix = ordered.where(F.size("x") <= PAIRED).select("o", rarest(2).alias("rest"))
    pair = _groups(prefix, ["a", "b"]).select("o", F.xxhash64("a.i", "b.i").alias("key"))  # pairs of one hash are told apart by their sets
    return meeting(pair, pair).unionByName(meeting(single, single.where(F.col("size") > PAIRED))).distinct()


def shared_items(items: DataFrame, owner: str, item: str, least: int) -> DataFrame:
    """(left, right, shared, jaccard) of owners that share `least` items or more, from an inverted index.

    Owners that meet in it are compared as whole sets. Every item counts, however many owners it has.
    """
    rows = items.select(F.col(owner).alias("o"), F.col(item).alias("i")).where("o is not null and i is not null").distinct()
    ordered = _ordered(rows).where(F.size("x") >= least)
    sets = ordered.select("o", F.transform("x", lambda e: e["i"]).alias("all"))
    pairs = meeting_pairs(ordered, least)
    pairs = pairs.join(sets.select(F.col("o").alias("left"), F.col("all").alias("_l")), "left").join(sets.select(F.col("o").alias("right"), F.col("all").alias("_r")), "right")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("_l", "_r")).cast("long")).where(F.col("shared") >= least)
    jaccard = F.col("shared") / (F.size("_l") + F.size("_r") - F.col("shared"))
    return pairs.select("left", "right", "shared", F.round(jaccard, 3).alias("jaccard"))


def _groups(sets: DataFrame, names: list[str]) -> DataFrame:
    """(o, *names): all groups of the items of each set (o, rest), in the order of the array."""
    rows, left = sets, len(names)
    for at, name in enumerate(names):
        left -= 1
        rest = F.slice("rest", F.col("_k") + 2, F.greatest(F.size("rest") - F.col("_k") - 1, F.lit(0)))
        rows = rows.select("o", *names[:at], "rest", F.posexplode("rest").alias("_k", name)).select("o", *names[: at + 1], rest.alias("rest")).where(F.size("rest") >= left)
    return rows.drop("rest")


#: Groups of over two items are listed at once for owners of up to so many items.
WHOLE = 12
#: Also for wider ones that have at most so many groups each, and no more in all than the others.
MOST_GROUPS = 100_000


def sets_of(items: DataFrame, owner: str, item: str) -> DataFrame:
    """(o, rest): the distinct items of each owner in order, without nulls."""
    rows = items.select(F.col(owner).alias("o"), F.col(item).alias("i")).where("o is not null and i is not null")
    return rows.groupBy("o").agg(F.sort_array(F.collect_set("i")).alias("rest"))


def clumps(members: DataFrame, owner: str, item: str, size: int, least: int) -> DataFrame:
    """Groups of `size` items (item_1 < item_2 ...) that occur together in `least` owners or more."""
    return set_clumps(stored(sets_of(members, owner, item)), size, least)


def set_clumps(sets: DataFrame, size: int, least: int) -> DataFrame:
    """`clumps` of (o, rest): one row for each owner, with its distinct items in order. Read more than once; should be stored.

    Items of fewer owners are taken out of the sets where over a quarter of all places hold such ones. Groups of owners of
    over WHOLE items are made only of pairs that are in enough owners already, unless they are few beside the other groups.
    """
    names = [f"item_{k + 1}" for k in range(size)]
    sets = sets.where(F.size("rest") >= size)
    rows = sets.select("o", F.explode("rest").alias("i"))
    counts = rows.groupBy("i").agg(F.count("*").alias("owners"))
    if size == 1:
        return counts.where(F.col("owners") >= least).select(F.col("i").alias(names[0]), "owners")
    places, rare = counts.agg(F.sum("owners"), F.sum(F.when(F.col("owners") < least, F.col("owners")))).first()
    if (rare or 0) * 4 > (places or 0):
        frequent = counts.where(F.col("owners") >= least).select("i")
        sets = stored(rows.join(frequent, "i").groupBy("o").agg(F.sort_array(F.collect_list("i")).alias("rest")).where(F.size("rest") >= size))
    counted = lambda found: found.groupBy(*found.columns[1:]).agg(F.count("*").alias("owners")).where(F.col("owners") >= least)
    n, narrow = F.size("rest").cast("double"), F.size("rest") <= WHOLE
    groups = reduce(lambda x, k: x * (n - k) / (k + 1), range(size), F.lit(1.0))
    of_narrow, of_wide, most = sets.agg(F.sum(F.when(narrow, groups)), F.sum(F.when(~narrow, groups)), F.max(groups)).first()
    if size == 2 or of_wide is None or (most <= MOST_GROUPS and of_wide <= (of_narrow or 0)):
        return counted(_groups(dealt(sets, "o"), names))
    wide = sets.where(~narrow)
    pairs = counted(_groups(dealt(sets, "o"), names[:2])).drop("owners")
    kept = stored(_groups(dealt(wide, "o"), names[:2]).join(pairs, names[:2], "left_semi").select("o", *names[:2]))
    found = kept
    for k in range(2, size):
        found = found.join(kept.select("o", F.col(names[0]).alias(names[k - 1]), F.col(names[1]).alias(names[k])), ["o", names[k - 1]]).select("o", *names[: k + 1])
    return counted(_groups(dealt(sets.where(narrow), "o"), names).unionByName(found))


def multiset_overlap(counts: DataFrame, pairs: DataFrame, owner: str, item: str, n: str) -> DataFrame:
    """Adds `overlap` to the asked (left, right) pairs: the items that both hold, as often as the one with fewer."""
    c = counts.select(F.col(owner).alias("o"), F.col(item).alias("i"), F.col(n).alias("n"))
    left = pairs.join(c.select(F.col("o").alias("left"), "i", F.col("n").alias("n_left")), "left")
    both = left.join(c.select(F.col("o").alias("right"), "i", F.col("n").alias("n_right")), ["right", "i"])
    score = both.groupBy("left", "right").agg(F.sum(F.least("n_left", "n_right")).alias("overlap"))
    return pairs.join(score, ["left", "right"], "left").select("left", "right", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def within_budget(scored: DataFrame, by: list[str], order: list, budget: int) -> DataFrame:
    """The first `budget` comparisons of each group."""
    return scored.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("position") <= budget)


def nearest_set(asked: DataFrame, sets: DataFrame, owner: str, name: str, value: str, least: int = 2) -> DataFrame:
    """For each owner the named set that shares most of its values (at least `least`), the smaller name among equals."""
    a = asked.select(F.col(owner).alias("o"), F.col(value).alias("v")).distinct()
    s = sets.select(F.col(name).alias("s"), F.col(value).alias("v")).distinct()
    shared = a.join(s, "v").groupBy("o", "s").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    best = F.min(F.struct((-F.col("shared")).alias("k"), F.col("s"))).alias("b")
    return shared.groupBy("o").agg(best).select(F.col("o").alias(owner), F.col("b.s").alias(name), (-F.col("b.k")).alias("shared"))


def contained_sets(items: DataFrame, owner: str, item: str, least: int = 2) -> DataFrame:
    """(inside, outside, size, other_size): sets of `least` items or more that lie wholly in another, larger one.

    Owners of equal sets are one, the least of them. A set lies only in sets that hold its two rarest items: it meets
    those of up to PAIRED items by that pair, larger ones by the rarest item first. What it meets must then hold the rest.
    """
    sets = sets_of(items, owner, item).where(F.size("rest") >= least)
    first = stored(sets.groupBy(F.col("rest").alias("x")).agg(F.min("o").alias("o")))
    rows = first.select("o", F.size("x").cast("long").alias("n"), F.explode("x").alias("i"))
    counts = rows.groupBy("i").agg(F.count("*").alias("owners"))
    mark = F.expr("bit_or(shiftleft(1L, cast(xxhash64(i) & 63 as int)))").alias("sketch")
    ordered = rows.join(counts, "i").groupBy("o", "n").agg(F.sort_array(F.collect_list(F.struct("owners", "i"))).alias("x"), mark)
    ordered = stored(ordered.select("o", "n", F.transform("x", lambda e: e["i"]).alias("x"), "sketch"))
    asked = ordered.select(F.col("o").alias("inside"), F.col("n").alias("size"), F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), F.col("sketch").alias("_s"))
    columns = ["inside", "outside", "size", "other_size"]

    there = ordered.select(F.col("o").alias("outside"), F.col("n").alias("other_size"), F.col("sketch").alias("_t"), "x")
    rest = F.slice("x", F.col("k") + 2, F.greatest(F.size("x") - F.col("k") - 1, F.lit(0)))
    small = there.where((F.col("other_size") > 2) & (F.col("other_size") <= PAIRED)).select("outside", "other_size", "_t", "x", F.posexplode("x").alias("k", "a"))
    pairs = small.select("outside", "other_size", "_t", "a", F.explode(rest).alias("b"))
    fits = (F.col("other_size") > F.col("size")) & (F.col("_s").bitwiseAND(F.bitwise_not("_t")) == 0)  # no item of the one has a bit that the other has not
    by_pair = asked.where("size > 1").join(pairs, ["a", "b"])
    large = there.where(F.col("other_size") > PAIRED).select("outside", "other_size", "_t", F.explode("x").alias("a"))
    by_item = asked.where("size > 1").join(large, "a").where(fits).join(large.select("outside", F.col("a").alias("b")), ["outside", "b"], "left_semi")
    alone = asked.where("size = 1").join(there.select("outside", "other_size", "_t", F.explode("x").alias("a")), "a")
    met = by_pair.select(*columns, "_s", "_t").unionByName(by_item.select(*columns, "_s", "_t")).unionByName(alone.select(*columns, "_s", "_t")).where(fits).select(*columns)

    one, two = ordered.select(F.col("o").alias("inside"), F.col("x").alias("_x")), ordered.select(F.col("o").alias("outside"), F.col("x").alias("_y"))
    whole = met.where("size > 2").join(one, "inside").join(two, "outside").where(F.size(F.array_except("_x", "_y")) == 0)
    return met.where("size <= 2").unionByName(whole.select(*columns))


#: Groups of so many sets are cut into blocks of about so many, or into about so many blocks.
BLOCK, MOST_BLOCKS = 8192, 64
#: Groups of up to so many sets are compared with others in one go.
SMALL = 1024


def _units(sets: DataFrame, least: float) -> tuple[DataFrame, int]:
    """`sets` (g, o, sketch; stored) once for each unit (ug, ua, ub) that compares them, with which of its sides they are on (first, second).

    A unit is two blocks of a large group whose sizes can go together, or several small groups. No more than a block's
    share of a group is in one; as many copies are made of a set as blocks go with its own. Beside it, over how many partitions to deal them.
    """
    step = F.floor(F.log2("sketch.n") * 8).cast("int")
    counts = sets.groupBy("g", step.alias("step")).agg(F.count("*").alias("n"))
    of = W.partitionBy("g")
    counts = counts.withColumns({"all": F.sum("n").over(of), "before": F.sum("n").over(of.orderBy("step")) - F.col("n")})
    block = F.greatest(F.lit(BLOCK), F.ceil(F.col("all") / MOST_BLOCKS))
    dealt_to = F.struct(F.floor(F.col("before") / block).cast("int").alias("at"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    counts = stored(counts.select("g", "step", "n", (F.col("all") <= SMALL).alias("small"), dealt_to.alias("to")))
    few = counts.where("small").agg(F.sum("n")).first()[0] or 0
    placed = sets.withColumn("step", step).join(counts.drop("n"), ["g", "step"]).withColumn("at", F.col("to.at") + F.pmod(F.xxhash64("o"), "to.parts").cast("int")).drop("step", "to")

    blocks = placed.where("not small").groupBy("g", "at").agg(F.min("sketch.n").alias("lo"), F.max("sketch.n").alias("hi"))
    blocks = stored(blocks)
    side = lambda k: blocks.select("g", *[F.col(c).alias(c + k) for c in ("at", "lo", "hi")])
    fit = lambda a, b: F.col(f"hi{a}") >= F.col(f"lo{b}") * F.lit(least) - F.lit(1e-6)
    pairs = side("a").join(side("b"), "g").where((F.col("ata") <= F.col("atb")) & fit("a", "b") & fit("b", "a"))
    one = F.struct(F.col("ata").alias("at"), F.lit(True).alias("first"), (F.col("ata") == F.col("atb")).alias("second"))
    other = F.struct(F.col("atb").alias("at"), F.lit(False).alias("first"), F.lit(True).alias("second"))
    visits = pairs.select("g", F.col("ata").alias("ua"), F.col("atb").alias("ub"), F.inline(F.when(F.col("ata") == F.col("atb"), F.array(one)).otherwise(F.array(one, other))))
    large = placed.where("not small").join(visits, ["g", "at"]).select(F.col("g").alias("ug"), "ua", "ub", *sets.columns, "first", "second")
    together = F.pmod(F.xxhash64("g"), F.lit(few // SMALL + 1)).cast("int")
    small = placed.where("small").select(F.when(F.lit(False), F.col("g")).alias("ug"), together.alias("ua"), together.alias("ub"), *sets.columns, F.lit(True).alias("first"), F.lit(True).alias("second"))
    n = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), (pairs.count() + few // SMALL) // 4 + 1)
    return large.unionByName(small), n


def jaccard_pairs(items: DataFrame, group: str, owner: str, item: str, least: float, sets_of_some: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group, left, right, jaccard) of owners of one group whose sets of items have `least` Jaccard or more (over 0).

    Sketches of all sets are compared in blocks, two at a time, and nothing is kept of a pair. Of two blocks only the sets
    that may have a similar one in them go on, with their items, to be compared item by item.

    With `sets_of_some`, `item` is the sketch of each owner's set (see `sketched`) and no group is null; it gives (group, owner, items: an array or
    words of one text) of the owners asked (group, owner), and `right` is the one owner that is nearest to `left` by `jaccard`, the least of equal ones.
    """
    nearest = sets_of_some is not None
    if nearest:
        found = items.select(F.struct(group).alias("g"), F.col(owner).alias("o"), F.col(item).alias("sketch"))
    else:
        rows = items.select(F.struct(group).alias("g"), F.col(owner).alias("o"), F.col(item).alias("i")).where("o is not null and i is not null")  # a struct, as null is a group too
        whole = stored(rows.groupBy("g", "o").agg(F.collect_set("i").alias("x")))
        found = sketched(whole, "x")
    found = stored(found)
    units, n = _units(found, least)
    unit = ["ug", "ua", "ub"]
    near = stored(units.repartition(n, *unit).groupBy(*unit).applyInArrow(lambda table: near_at_all(table, least), units.schema))
    if nearest:
        asked = near.withColumns({"_g": F.col(f"g.{group}"), "_o": F.col("o")})
        fetched = sets_of_some(asked.select(F.col("_g").alias(group), F.col("_o").alias(owner)).distinct()).toDF("_g", "_o", "x")
        near = asked.join(fetched, ["_g", "_o"]).drop("_g", "_o")
    else:
        near = near.join(whole, ["g", "o"])
    typed = ", ".join(f"{name} {found.schema[c].dataType.simpleString()}" for name, c in (("g", "g"), ("left", "o"), ("right", "o")))
    pairs = near.repartition(n, *unit).groupBy(*unit).applyInArrow(lambda table: compared(table, least, nearest), f"{typed}, shared long, n long")
    jaccard = F.floor(F.col("shared") / F.col("n") * 1000 + 0.5) / 1000  # as SQL rounds: 201 of 400 are 0.502, where the decimal digits would make it 0.503
    if nearest:
        best = F.min(F.struct((-jaccard).alias("j"), "right")).alias("best")
        return pairs.groupBy("g", "left").agg(best).select(F.col(f"g.{group}").alias(group), "left", "best.right", (-F.col("best.j")).alias("jaccard"))
    return pairs.select(F.col(f"g.{group}").alias(group), "left", "right", jaccard.alias("jaccard"))


def parts(rows: DataFrame, owner: list[str], item: str, feature: str) -> DataFrame:
    """(owner, part, items): the items of each owner, in parts that share features directly or through others.

    `part` is the least item of its part; an item whose feature is null is a part of its own.
    """
    given = rows.select(F.struct(*owner).alias("k"), F.col(item).alias("i"), F.col(feature).alias("f")).distinct()
    # a feature links the least item that has it with the others; one that a single item has links none
    least = given.where("f is not null").withColumn("first", F.min("i").over(W.partitionBy("k", "f")))
    node = lambda c: F.struct("k", F.col(c).alias("i"))
    labels = components(least.where("first < i").select(node("first").alias("a"), node("i").alias("b")).distinct())
    own, met = given.select("k", "i").distinct(), labels.select(F.col("node.k").alias("_k"), F.col("node.i").alias("_i"), F.col("least.i").alias("part"))
    found = own.join(met, F.col("k").eqNullSafe(F.col("_k")) & (F.col("i") == F.col("_i")), "left")
    return found.select("k.*", F.coalesce("part", "i").alias("part"), F.col("i").alias(item))
