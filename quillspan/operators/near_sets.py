"""Sets of one group that have much in common, found by sketches: all that two blocks of sets need is in one task.

A sketch is an array of bits, 4 to 8 for each item of its set and LEAST_BITS at least; each item flips one of them. An item
that only one of two sets holds flips a bit in which they differ, or flips one back, so that no more bits differ than
items: pairs with more are ruled out for certain. The halves of a sketch laid over each other are the sketch of half
as many bits, so that sets of any two sizes can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS = 256
#: Bits of sketches that are made at once.
AT_ONCE = 1 << 24
#: Sets on either side that are compared at once.
TILE = (16, 4096)
#: Sets that are counted item by item before it is seen anew which ones can still be the nearest.
COUNTED = 256


def bits(n: np.ndarray) -> np.ndarray:
    """How many bits a sketch of `n` items has: a power of two."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(4 * n, LEAST_BITS))).astype(np.int64)


def sketched(sets: DataFrame, items: str) -> DataFrame:
    """`sets` with `sketch` (n, bits) in place of the array `items`, which has no item twice and no null."""
    asked = sets.withColumn(items, F.transform(items, lambda x: F.xxhash64(x)))
    schema = asked.drop(items).withColumn("sketch", F.struct(F.lit(0).alias("n"), F.lit(b"").alias("bits"))).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(items)
            n = pc.list_value_length(hashes).to_numpy(zero_copy_only=False).astype(np.int64)
            made = pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), _sketches(hashes.flatten().to_numpy(zero_copy_only=False), n)], ["n", "bits"])
            kept = [k for k, name in enumerate(batch.schema.names) if name != items]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), made], [*(batch.schema.names[k] for k in kept), "sketch"])

    return asked.mapInArrow(rows, schema)


def _sketches(hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    m = bits(n)
    ends, stops = np.cumsum(n), np.cumsum(m)
    parts, at = [], 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(stops, stops[at] - m[at] + AT_ONCE, "right")))
        own, wide = n[at:to], m[at:to]
        place = np.repeat(np.cumsum(wide) - wide, own) + (hashes[ends[at] - n[at] : ends[to - 1]] & np.repeat(wide - 1, own))
        parts.append(np.packbits((np.bincount(place, minlength=int(wide.sum())) & 1).astype(np.uint8), bitorder="little"))
        at = to
    offsets = np.r_[0, stops // 8].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(parts) if parts else np.empty(0, np.uint8))])


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each value, nulls and structs included: equal ones have the same."""
    if pa.types.is_struct(column.type):
        every = np.stack([_codes(c) for c in column.flatten()])
        return np.unique(every, axis=1, return_inverse=True)[1].reshape(-1)
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


class _Sets:
    """The sets of one side in order of size: `row` is where they stand in the table."""

    def __init__(self, row: np.ndarray, n: np.ndarray, start: np.ndarray, data: np.ndarray):
        self.row = row[np.argsort(n[row], kind="stable")]
        self.n = n[self.row]
        self.m = bits(self.n)
        self._start, self._data = start, data

    def words(self, lo: int, hi: int, m: int) -> np.ndarray:
        """Sketches of the sets from `lo` to `hi`, which have `m` bits or more, as words of 64 of `m` bits."""
        parts = []
        while lo < hi:
            own = int(self.m[lo])
            to = min(hi, int(np.searchsorted(self.m, own, "right")))
            w = self._data[self._start[self.row[lo:to]][:, None] + np.arange(own // 64)]
            while w.shape[1] > m // 64:
                w = w[:, : w.shape[1] // 2] ^ w[:, w.shape[1] // 2 :]
            parts.append(w)
            lo = to
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _scan(one: _Sets, other: _Sets, lo: np.ndarray, group: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of `one` and `other`, and how many bits they differ by at least: all that may have `least` Jaccard. `lo` is where those of no smaller size begin."""
    hi = np.searchsorted(other.n, one.n / least + 1e-6, "right")
    part = (1 - least) / (1 + least)
    at = 0
    while at < len(one.n):
        m = int(one.m[at])
        to = int(np.searchsorted(one.m, m, "right"))
        first, last = int(lo[at]), int(hi[to - 1])
        if first < last:
            ours, theirs = one.words(at, to, m), other.words(first, last, m)
            half = m // 128
            p = np.ascontiguousarray((ours[:, :half] ^ ours[:, half:]).T)
            q = np.ascontiguousarray((theirs[:, :half] ^ theirs[:, half:]).T)
            kind = np.uint16 if other.n[last - 1] <= 20_000 else np.uint32
            # the bound of the sum, rounded down on both sides, lacks less than one
            most_p = (np.floor(one.n[at:to] * part) + 1).astype(kind)
            most_q = np.floor(other.n[first:last] * part).astype(kind)
            for i in range(at, to, TILE[0]):
                j = min(i + TILE[0], to)
                for k in range(int(lo[i]), int(hi[j - 1]), TILE[1]):
                    l = min(k + TILE[1], int(hi[j - 1]))
                    shape = (j - i, l - k)
                    differ, both, count = np.zeros(shape, kind), np.empty(shape, np.uint64), np.empty(shape, np.uint8)
                    for w in range(half):
                        np.bitwise_xor(p[w, i - at : j - at, None], q[w, k - first : l - first], out=both)
                        np.add(differ, np.bitwise_count(both, out=count), out=differ)
                    x, y = np.nonzero(differ <= most_p[i - at : j - at, None] + most_q[k - first : l - first])
                    x, y = x + i, y + k
                    fits = (y >= lo[x]) & (y < hi[x]) & (group[one.row[x]] == group[other.row[y]])
                    x, y = x[fits], y[fits]
                    step = max(1, AT_ONCE // m)
                    for s in range(0, len(x), step):
                        a, b = x[s : s + step], y[s : s + step]
                        fine = np.bitwise_count(ours[a - at] ^ theirs[b - first]).sum(axis=1, dtype=np.int64)
                        near = fine <= (one.n[a] + other.n[b]) * part + 1e-6
                        if near.any():
                            yield one.row[a[near]], other.row[b[near]], fine[near]
        at = to


def _meeting(table: pa.RecordBatch, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the table that may have `least` Jaccard, one of each side or, where both sides are one, any two."""
    n, own = table.column("sketch").flatten()
    n = n.to_numpy().astype(np.int64)
    size = bits(n) // 64
    start = np.cumsum(size) - size
    from_to = np.frombuffer(own.buffers()[1], np.int32)[own.offset :][[0, len(own)]]
    words = np.frombuffer(own.buffers()[2], np.uint8)[slice(*from_to)].view(np.uint64)
    group = _codes(table.column("g"))
    first, second = (table.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
    if second[first].all():
        sets = _Sets(np.arange(len(n)), n, start, words)
        yield from _scan(sets, sets, np.arange(1, len(n) + 1), group, least)
    else:
        one, other = (_Sets(np.flatnonzero(side), n, start, words) for side in (first, second))
        yield from _scan(one, other, np.searchsorted(other.n, one.n, "left"), group, least)
        yield from _scan(other, one, np.searchsorted(one.n, other.n, "right"), group, least)


def near_at_all(table: pa.Table, least: float) -> pa.Table:
    """Those of the sets that may have another at `least` Jaccard."""
    batch = table.combine_chunks().to_batches()[0]
    near = np.zeros(batch.num_rows, bool)
    for a, b, _ in _meeting(batch, least):
        near[a] = near[b] = True
    return table.filter(pa.array(near))


def _shared(ids: np.ndarray, ends: np.ndarray, n: np.ndarray, mark: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """How many items the set at `a` has in common with each of those at `b`."""
    own = ids[ends[a] - n[a] : ends[a]]
    mark[own] = True
    starts = np.cumsum(n[b]) - n[b]
    place = np.arange(int(n[b].sum())) + np.repeat(ends[b] - n[b] - starts, n[b])
    found = np.add.reduceat(mark[ids[place]], starts, dtype=np.int64)
    mark[own] = False
    return found


def compared(table: pa.Table, least: float, nearest: bool) -> pa.Table:
    """(g, left, right, shared, n): pairs at `least` Jaccard (left < right), with how many items are in both and in either; or of each set the nearest one (right)
    as Jaccard is rounded to three places, the least of equal ones.
    """
    batch = table.combine_chunks().to_batches()[0]
    x = batch.column("x") if pa.types.is_nested(batch.schema.field("x").type) else pc.split_pattern(batch.column("x"), " ")
    n = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    coded = pc.dictionary_encode(x.flatten())
    ids, mark = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), bool)
    rank = np.empty(len(n), np.int64)
    rank[pc.sort_indices(batch.column("o")).to_numpy()] = np.arange(len(n))
    thousandths = lambda part, of: np.floor(part / of * 1000 + 0.5).astype(np.int64)  # noqa: E731  as jaccard_pairs rounds
    best, partner, best_shared = np.full(len(n), -1), np.full(len(n), -1), np.zeros(len(n), np.int64)
    found: list[tuple[np.ndarray, ...]] = []

    def count(a: int, b: np.ndarray) -> None:
        shared = _shared(ids, ends, n, mark, a, b)
        either = n[a] + n[b] - shared
        near = (shared > 0) & (shared / either >= least)
        b, shared, either = b[near], shared[near], either[near]
        if not nearest:
            found.append((np.full(len(b), a), b, shared, either))
        elif len(b):
            value = thousandths(shared, either)
            top = np.lexsort((rank[b], -value))[0]
            for to, by, v, s in ((np.array([a]), b[top : top + 1], value[top : top + 1], shared[top : top + 1]), (b, np.full(len(b), a), value, shared)):
                better = (v > best[to]) | ((v == best[to]) & (rank[by] < rank[partner[to]]))
                best[to[better]], partner[to[better]], best_shared[to[better]] = v[better], by[better], s[better]

    for one, other, differ in _meeting(batch, least):
        for k in np.split(np.arange(len(one)), np.flatnonzero(np.diff(one)) + 1):
            a, b, both = int(one[k[0]]), other[k], n[one[k]] + n[other[k]]
            most = thousandths(both - differ[k], both + differ[k])
            in_order = np.argsort(-most, kind="stable")
            for s in range(0, len(b), COUNTED):
                take = in_order[s : s + COUNTED]
                if nearest:
                    take = take[(most[take] >= best[a]) | (most[take] >= best[b[take]])]
                if len(take):
                    count(a, b[take])
    if nearest:
        left = np.flatnonzero(partner >= 0)
        right, shared = partner[left], best_shared[left]
        either = n[left] + n[right] - shared
    else:
        a, b, shared, either = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in range(4))
        left, right = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
    o = batch.column("o")
    return pa.table({"g": batch.column("g").take(pa.array(left)), "left": o.take(pa.array(left)), "right": o.take(pa.array(right)), "shared": pa.array(shared), "n": pa.array(either)})
