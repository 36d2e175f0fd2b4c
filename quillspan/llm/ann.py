"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Inner products become angles: with L the greatest length, x is extended by sqrt(L^2 - |x|^2) and a
query by 0. ROTATIONS orthogonal matrices, each fitted by iterative quantisation (binary codes and
rotation in turn) to SAMPLE rows, give codes of ROTATIONS * dimension bits, the signs of the rotated
coordinates. Every row is indexed.

Rows are dealt into blocks of about BLOCK_ROWS, and queries likewise; each pair of blocks is one
group, so that a group is bounded whatever the input. In a block each 16-bit substring of the codes
has a table from value to rows. Probing raises the distance t allowed in a substring from 0 on: by the
pigeonhole principle, all codes within m (t + 1) - 1 bits of a query's code of m substrings have
then been met. It ends when WANTED codes lie within a radius that is covered; all codes within the
least such radius are ranked by the inner product of the original vectors, in double precision. Once
a level would need more probes than the block has rows, the rest of the block's codes are compared
without the tables, which covers every radius. Where the nearest vectors stand out, as in clustered
data, a level or two settle a query; where they hardly do, as among vectors of random directions, no
radius that holds them is smaller than what comparing all codes costs, and that comparison decides.

Defined results: a null vector, a zero vector, one with null or non-finite components, one of
another dimension than most rows have (no inner product is defined between the two), and one with a
null vec_id take no part; rows that share a vec_id are rows of their own, queries and candidates of
each other; equal scores rank by vec_id; a query with fewer candidates returns them all; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.llm.common import settle, table

NEAREST = 20
EVERY = 20
ROTATIONS = 4
SAMPLE = 4096
ROUNDS = 20
BLOCK_ROWS = 8192
WANTED = 200
SUBSTRING = 16
MOST_FLIPS = 3

#: By number of flipped bits, the masks that flip them.
FLIPS = [np.array([sum(1 << b for b in c) for c in combinations(range(SUBSTRING), t)], np.uint16) for t in range(MOST_FLIPS + 1)]


def rotations(sample: np.ndarray, count: int = ROTATIONS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Orthogonal matrices whose signs lose little of the sample."""
    rng, d, out = np.random.default_rng(9), sample.shape[1], []
    for _ in range(count):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds if len(sample) else 0):
            signs = np.where(sample @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(sample.T @ signs)
            r = u @ v
        out.append(r)
    return out


def codes(vectors: np.ndarray, turned: list[np.ndarray]) -> np.ndarray:
    """Rows of 16-bit substrings."""
    bits = np.concatenate([vectors @ r >= 0 for r in turned], axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING)))
    return np.packbits(bits, axis=1).view(np.uint16)


def words(block: np.ndarray) -> np.ndarray:
    """Codes as columns of 64-bit words: a distance then takes few operations, each over all rows at once."""
    padded = np.pad(block, ((0, 0), (0, -block.shape[1] % 4)))
    return np.ascontiguousarray(padded.view(np.uint64).T)


class MultiIndex:
    """The substring tables of a block of codes."""

    def __init__(self, block: np.ndarray):
        self.n, self.m = block.shape
        self.words = words(block)
        self.order = np.argsort(block, axis=0, kind="stable").T.astype(np.int32, order="C").ravel()
        values = 1 << SUBSTRING
        counts = np.stack([np.bincount(block[:, j], minlength=values) for j in range(self.m)])
        #: By substring and value, the place in `order` at which its rows begin; the next value's place ends them.
        self.begin = np.concatenate([np.zeros((self.m, 1), np.int64), np.cumsum(counts, axis=1)], axis=1) + self.n * np.arange(self.m)[:, None]

    def members(self, values: np.ndarray) -> np.ndarray:
        """Rows of which a substring is one of the values, one row of values for each substring."""
        j = np.arange(self.m)[:, None]
        begin = self.begin[j, values].ravel()
        count = self.begin[j, values.astype(np.int32) + 1].ravel() - begin
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        met = np.zeros(self.n, bool)
        met[self.order[np.repeat(begin, count) + within]] = True
        return np.flatnonzero(met)

    def distance(self, rows: np.ndarray | slice, asked: np.ndarray) -> np.ndarray:
        """Bits in which the codes of the rows differ from the one code that `asked` holds as words."""
        return np.bitwise_count(self.words[:, rows] ^ asked).sum(axis=0, dtype=np.int32)

    def near(self, code: np.ndarray, wanted: int = WANTED) -> np.ndarray:
        """All rows within the least radius that holds `wanted` rows."""
        asked = words(code[None])
        far = np.full(self.n, np.iinfo(np.int32).max, np.int32)
        for t, masks in enumerate(FLIPS):
            if self.m * len(masks) > self.n:
                break
            met = self.members(code[:, None] ^ masks)
            met = met[far[met] == np.iinfo(np.int32).max]
            far[met] = self.distance(met, asked)
            if np.count_nonzero(far <= self.m * (t + 1) - 1) >= wanted:
                return self._least(far, wanted)
        return self._least(self.distance(slice(None), asked), wanted)

    @staticmethod
    def _least(far: np.ndarray, wanted: int) -> np.ndarray:
        if len(far) <= wanted:
            return np.arange(len(far))
        return np.flatnonzero(far <= np.partition(far, wanted - 1)[wanted - 1])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, copy, v): the rows that take part; copy tells the rows of a vec_id apart, once settled."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    rows = rows.where(F.coalesce(fine, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("copy", F.monotonically_increasing_id())


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose vec_id `every` divides."""
    spark = vectors.sparkSession
    rows = settle(usable(vectors))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = sizes["d"] if sizes else 0
    rows = rows.where(F.size("v") == dimension)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, longest = rows.agg(F.count("*"), F.max(square)).first()
    longest = longest or 0.0
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()]  # bounded by SAMPLE
    fitted = np.array(sample, np.float64).reshape(len(sample), dimension)
    sent = spark.sparkContext.broadcast(rotations(_extended(fitted, longest)))

    blocks = max(1, -(-n // BLOCK_ROWS))
    n_queries = rows.where(F.col("vec_id") % every == 0).count()
    parts = max(1, -(-n_queries // BLOCK_ROWS))
    index = rows.withColumns({"block": F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.withColumns({"part": F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(parts)).cast("int"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        q_ids, q_copies, q = _matrix(queries, dimension)
        ids, copies, x = _matrix(block, dimension)
        index_ = MultiIndex(codes(_extended(x, longest), sent.value))
        out: list[tuple[np.ndarray, ...]] = []
        for query, copy, vector, code in zip(q_ids, q_copies, q, codes(np.pad(q, ((0, 0), (0, 1))), sent.value), strict=True):
            near = index_.near(code)
            near = near[(ids[near] != query) | (copies[near] != copy)]
            score = np.einsum("ij,j->i", x[near], vector)
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), query), np.full(len(best), copy), ids[near][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "copy", "vec_id", "score"])

    pairs = asked.select("part", "block", "vec_id", "copy", "v").groupBy("part", "block").cogroup(index.select("part", "block", "vec_id", "copy", "v").groupBy("part", "block"))
    found = pairs.applyInArrow(search, "query_id long, copy long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _extended(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _matrix(rows: pa.Table, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("vec_id").to_numpy(), rows.column("copy").to_numpy(), flat.reshape(rows.num_rows, dimension)


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
