"""Size-aware heavy-light join on the Jaccard similarity of word n-gram sets, exact and without all pairs.

Sets are distinct 64-bit hashes of n-grams (two different n-grams of one pair of texts share a hash
with a chance below 1e-12). Equal sets form one class; only classes are joined. With d(n) the number
of elements that a set of n elements may lack in a similar one:

1. Candidates. Two similar sets share at least d + 1 of the 2 d + 1 elements of least hash (d of the
   smaller). These elements are counted over all sets; a set with too few of them in any other set
   has no partner and goes. Most texts end here.
2. Lists. Elements of the candidates are put in order of rarity, counted over all candidates. Two
   similar sets share one of their d + 1 rarest elements, so that heavy sets are indexed in the
   inverted lists of these alone, with their sizes and the element's position. A passage in very many
   texts is common and so stands in few lists.
3. Light sets, of at most `boundary()` elements, enumerate their subsets of the size that a similar
   pair shares instead; a light set stands in the inverted lists as well if a heavy one may be similar
   to it. The boundary is where the subsets of all smaller sets and the measured lengths of the lists
   that all larger sets would scan cost least together.
4. Scans. Each list is scanned with its most central member, that with the fewest rarer elements.
   Then, of each list that still holds several components, the members outside its largest component
   meet those of all others. Sizes and positions rule out pairs before any set is compared. Pairs within a
   component need no comparison, so that a group of n copies costs n of them.

Defined results: a null or empty text, or one without words, has no set and is linked with nothing;
so is a row with a null doc_id, whose component is null; a text of any length is one set; rows that
share a doc_id are one document; an empty table gives an empty result; columns of the input other
than doc_id and text are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import drop_folder, free_prefix, new_folder, release, settle, table
from quillspan.llm.components import components

#: Defaults, those of op5's contract.
NGRAM = 4
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Sets with more subsets than this are heavy whatever the lists cost.
MOST_SUBSETS = 2000
#: Listing a subset costs as much as scanning so many entries of a list.
SUBSET_COST = 2.0

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
REMEMBERED = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number scattered over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


def _scaled(k: int, by: np.uint64) -> np.uint64:
    return np.uint64(k * int(by) % (1 << 64))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()


def ngram_set(text: bytes | None, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams of a UTF-8 text, A-Z in lower case."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * M1 + h[k : len(h) - size + 1 + k]
    return np.unique(mixed(out))


def set_key(s: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), ">i8")[0])


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


# sizes and subsets -------------------------------------------------------------------------------


def lacking(n: int, percent: int = PERCENT) -> int:
    """How many elements of a set of n a similar set may lack."""
    return n - -(-percent * n // 100)


def sampled(n: int, percent: int = PERCENT) -> int:
    """How many elements of least hash the candidate test looks at."""
    return min(n, 2 * lacking(n, percent) + 1)


def shared_at_least(n: int, percent: int = PERCENT) -> int:
    """How many of the elements of the candidate test a set of n shares with a similar set, however small that is."""
    least = -(-percent * n // 100)
    return min(lacking(least, percent) + 1, least)


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of n elements must enumerate to meet every light partner."""
    return sorted({k for b in range(n, 100 * n // percent + 1) if (k := -(-percent * b // 100)) <= n})


def n_subsets(n: int, percent: int = PERCENT) -> int:
    return sum(math.comb(n, k) for k in subset_sizes(n, percent))


def most_light(percent: int = PERCENT) -> int:
    """The largest size whose subsets may be enumerated."""
    n = 1
    while n_subsets(n + 1, percent) <= MOST_SUBSETS:
        n += 1
    return n


def boundary(costs: list[tuple[int, int, int]], percent: int = PERCENT) -> int:
    """The last light size, from (size, sets of that size, entries that they scan) of sizes up to `most_light`."""
    light, best, total = 0, 0.0, 0.0
    for n, sets, scanned in sorted(costs):
        total += SUBSET_COST * sets * n_subsets(n, percent) - scanned
        if total < best:
            light, best = n, total
    return light


def subset_hashes(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the subsets of a light set, of which two similar light sets share at least one."""
    out = []
    for k in subset_sizes(len(s), percent):
        chosen = np.array(list(combinations(range(len(s)), k)))
        out.append(mixed(mixed(s)[chosen].sum(axis=1, dtype=np.uint64) + _scaled(k, M1)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


# Spark steps -------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def sets_of(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and set_key (null for an empty set) of each row, and the elements that the
    candidate test looks at where the set comes first in its task (else null)."""

    def rows(batches):
        seen: set[int] = set()
        out: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = ngram_set(text, n)
                key, least = (set_key(s) if len(s) else None), None
                if key is not None and doc_id is not None and key not in seen:
                    seen.add(key)
                    least = s[: sampled(len(s), percent)].view(np.int64)
                out.append((doc_id, len(s), key, least))
                if len(out) >= 500:
                    yield _rows(out)
                    out = []
        yield _rows(out)

    def _rows(out):
        ids, sizes, keys, least = zip(*out, strict=True) if out else ([], [], [], [])
        columns = [pa.array(list(x), t) for x, t in ((ids, pa.int64()), (sizes, pa.int64()), (keys, pa.int64()), (least, pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "least"])

    return _texts(docs).mapInArrow(rows, "doc_id long, n_shingles long, set_key long, least array<long>")


def _lacking(n: Column, percent: int) -> Column:
    return n - _least_partner(n, percent)


def _least_partner(n: Column, percent: int) -> Column:
    """The size of the smallest set that may be similar to one of n, which is the least overlap with any as well."""
    return F.floor((percent * n + 99) / 100).cast("long")


def candidates(hashed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(set_key, doc_id, n) of the sets that share enough of their elements of least hash with others; doc_id is the least with that set."""
    found = hashed.where("least is not null").select(F.explode("least").alias("e"), "set_key")
    alone = found.groupBy("e").agg(F.min("set_key").alias("set_key"), F.max("set_key").alias("last")).where("set_key = last")
    alone = alone.groupBy("set_key").agg(F.count("*").alias("alone")).withColumnRenamed("set_key", "_k")
    sets = hashed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    partner = _least_partner(F.col("n"), percent)
    tested = F.least(2 * _lacking(F.col("n"), percent) + 1, F.col("n"))
    needed = F.least(_lacking(partner, percent) + 1, partner)
    met = sets.join(alone, sets["set_key"] == alone["_k"], "left").where(tested - F.coalesce("alone", F.lit(0)) >= needed)
    return met.select("set_key", "doc_id", "n")


def fetch_sets(docs: DataFrame, wanted: DataFrame, n: int = NGRAM) -> DataFrame:
    """(set_key, elements) for the rows of `wanted` (set_key, doc_id)."""

    def rows(batches):
        for batch in batches:
            keys, sets = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = ngram_set(text, n)
                if set_key(s) == key:  # rows of one doc_id may differ in text
                    keys.append(key)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["set_key", "elements"])

    here = _texts(docs).withColumnRenamed("doc_id", "_doc_id")
    return here.join(wanted, here["_doc_id"] == wanted["doc_id"]).select("set_key", "text").mapInArrow(rows, "set_key long, elements array<long>")


def inverted_lists(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(e, set_key, n, pos, length) of the rarest elements of each set, as many as one of them must be in a similar set.

    pos is the number of the set's elements that are rarer, length the number of entries of the list.
    """
    entries = sets.select(F.explode("elements").alias("e"), "set_key", F.size("elements").cast("long").alias("n"))
    counts = settle(entries.groupBy("e").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("e", "_e"))
    common = entries.join(counts, entries["e"] == counts["_e"]).groupBy("set_key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("x"))
    common = common.select("set_key", "n", F.posexplode("x").alias("at", "y"), (F.col("n") - F.size("x")).alias("alone"))
    rare = common.where(F.col("alone") + F.col("at") <= _lacking(F.col("n"), percent)).select("y.e", "set_key", "n", (F.col("alone") + F.col("at")).alias("pos"))
    rare = settle(rare)
    lengths = rare.groupBy("e").agg(F.count("*").alias("length")).where("length > 1").withColumnRenamed("e", "_e")
    return settle(rare.join(settle(lengths), rare["e"] == F.col("_e")).drop("_e"))


def light_lists(sets: DataFrame, light: int, percent: int = PERCENT) -> DataFrame:
    """(e, set_key, n, pos) of the subsets of the light sets; pos is 0, which rules nothing out."""

    def rows(batches):
        for batch in batches:
            out, keys, sizes = [], [], []
            for key, elements in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = subset_hashes(np.array(elements, np.int64).view(np.uint64), percent).view(np.int64)
                out.append(h)
                keys += [key] * len(h)
                sizes += [len(elements)] * len(h)
            e = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array([0] * len(e), pa.int64())], names=["e", "set_key", "n", "pos"])

    small = sets.where(F.size("elements") <= light).select("set_key", "elements")
    return small.mapInArrow(rows, "e long, set_key long, n long, pos long")


def all_lists(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(e, set_key, n, pos): the lists of both kinds, with the boundary between light and heavy sets set by their costs."""
    heavy = inverted_lists(sets, percent)
    costs = heavy.where(F.col("n") <= most_light(percent)).groupBy("n").agg(F.countDistinct("set_key"), F.sum("length")).collect()  # a row a size
    light = boundary([tuple(r) for r in costs], percent)
    heavy = heavy.where(100 * F.col("n") > percent * light).select("e", "set_key", "n", "pos")  # the others have no heavy partner
    return settle(heavy.unionByName(light_lists(sets, light, percent))) if light else heavy


def _fits(percent: int) -> Column:
    """Whether the sizes of two entries of a list, and what is left of both sets from there on, let them be similar."""
    overlap = percent * (F.col("n") + F.col("_n"))  # of similar sets, at least, times 100 + percent
    by_size = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    return by_size & ((100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos")) >= overlap)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("set_key", "_k").alias("a"), F.greatest("set_key", "_k").alias("b")).distinct()


def central_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the most central member of each list with each other one that fits it."""
    first = lists.groupBy("e").agg(F.min(F.struct("pos", "set_key", "n")).alias("x"))
    first = settle(first.select(F.col("e").alias("_e"), F.col("x.set_key").alias("_k"), F.col("x.n").alias("_n"), F.col("x.pos").alias("_pos")))
    return _pairs(lists.join(first, (F.col("e") == F.col("_e")) & (F.col("set_key") != F.col("_k")) & _fits(percent)))


def crossing_pairs(lists: DataFrame, of: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): members of a list in different components that fit each other, at least one of them outside its largest."""
    known = lists.join(of, lists["set_key"] == of["node"], "left").select("e", "set_key", "n", "pos", F.coalesce("least", "set_key").alias("c"))
    known = settle(known)
    sizes = known.groupBy("e", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("e").agg(F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("x")).where("parts > 1")
    main = settle(main.select(F.col("e").alias("_main_e"), F.col("x.c").alias("main")))
    still = settle(known.join(main, known["e"] == main["_main_e"]).drop("_main_e"))
    others = still.where("c <> main").select(F.col("e").alias("_e"), F.col("set_key").alias("_k"), F.col("n").alias("_n"), F.col("pos").alias("_pos"), F.col("c").alias("_c"))
    return _pairs(still.join(others, (F.col("e") == F.col("_e")) & (F.col("c") != F.col("_c")) & _fits(percent)))


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `pairs` (a, b: set keys) whose sets are similar."""

    def rows(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similar(np.array(p, np.int64), np.array(q, np.int64), percent) for p, q in zip(x, y, strict=True)]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    one = sets.select(F.col("set_key").alias("_a"), F.col("elements").alias("x"))
    two = sets.select(F.col("set_key").alias("_b"), F.col("elements").alias("y"))
    both = pairs.join(one, pairs["a"] == one["_a"]).select("a", "b", "x")
    both = both.join(two, both["b"] == two["_b"]).select("a", "b", "x", "y")
    return both.mapInArrow(rows, "a long, b long")


def link(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs`, by word n-grams and a Jaccard similarity of `percent` or more."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    folder = new_folder(spark, "sets")
    sets_of(docs, n, percent).write.parquet(folder)  # texts are cut into n-grams once for keys and elements
    hashed = spark.read.parquet(folder)
    seen = settle(hashed.select("doc_id", "n_shingles", "set_key"))
    wanted = settle(candidates(hashed, percent))
    drop_folder(spark, folder)
    release(spark)  # the shuffled elements
    folder = new_folder(spark, "candidates")
    fetch_sets(docs, wanted, n).dropDuplicates(["set_key"]).write.parquet(folder)
    sets = spark.read.parquet(folder)
    release(spark)
    lists = all_lists(sets, percent)
    links = settle(verify(central_pairs(lists, percent), sets, percent))
    more = settle(crossing_pairs(lists, settle(components(links)), percent))
    links = settle(links.unionByName(verify(more, sets, percent)))
    of = settle(components(links))
    drop_folder(spark, folder)
    firsts = seen.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    least = firsts.join(of, firsts["set_key"] == of["node"], "left").select("set_key", "doc_id", F.coalesce("least", "set_key").alias("component"))
    named = least.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "_c")
    of_set = least.join(named, least["component"] == named["_c"]).select(F.col("set_key").alias("_k"), "component_id")
    out = seen.join(of_set, seen["set_key"] == of_set["_k"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return _one_document(out.select("doc_id", "n_shingles", own.alias("component_id")))


def _one_document(out: DataFrame) -> DataFrame:
    """Rows of one doc_id in different components join them."""
    twice = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
    if twice.isEmpty():
        return out
    pairs = out.join(twice.select(F.col("doc_id").alias("_d"), "a"), F.col("doc_id") == F.col("_d")).select("a", F.col("component_id").alias("b"))
    least = components(pairs)
    return out.join(least, out["component_id"] == least["node"], "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row of `docs` of each component: one of its smallest doc_id, of several such rows that of the least hash.

    A row with a null doc_id goes by a hash of its text, so that its copies are one document, and is kept only where
    its component has no doc_id. Such rows without words are linked with nothing and stay.
    """
    own = F.coalesce("doc_id", F.xxhash64(F.lit("no doc_id"), "text"))
    alone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = docs.where(~alone)
    nameless = some.where("doc_id is null").select(own.alias("_n")).distinct()
    ids = link(some.select(own.alias("doc_id"), "text"), n, percent).groupBy("component_id", "doc_id").agg(F.count("*").alias("n_rows"))
    p = free_prefix(docs.columns)
    ids = ids.join(nameless, ids["doc_id"] == nameless["_n"], "left")
    first = F.min(F.struct(F.col("_n").isNotNull().alias("nameless"), F.col("doc_id").alias("kept"), F.col("n_rows").alias("n_rows")))
    kept = settle(ids.groupBy("component_id").agg(first.alias("k")).select(F.col("k.kept").alias(f"{p}kept"), "k.n_rows"))
    once, repeated = (kept.where(c).select(f"{p}kept") for c in ("n_rows = 1", "n_rows > 1"))
    stays = some.join(once, own == F.col(f"{p}kept"), "left_semi").unionByName(docs.where(alone))
    if repeated.isEmpty():
        return stays
    least = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    return stays.unionByName(some.join(repeated, own == F.col(f"{p}kept")).groupBy(f"{p}kept").agg(least).select("row.*"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
