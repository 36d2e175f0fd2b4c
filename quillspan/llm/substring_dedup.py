"""Exact removal of long byte strings that occur more than once, by suffix groups.

A byte goes if it is covered by a WINDOW-byte string that also starts anywhere else, in another
text or the same one. A suffix array of a whole corpus is no job for one machine, so that windows
meet in groups first:

1. Each window has an anchor, its leftmost string of half its length that has the least hash; windows
   with one anchor form a run of a text. Equal windows have equal anchors, so that only runs whose
   anchor string occurs twice or more can hold repeated windows.
2. Runs that are equal from the first byte to the last repeat as a whole: they share the hash of the
   anchor and that of the run, 128 bits in all. What is left are runs with a common anchor which
   differ somewhere, about one in thirty.
3. The distinct runs of an anchor are cut into blocks aligned with the anchor, and one suffix array
   of the block strings is built (`suffix_sort`, linear grouping). A window holds a number of whole
   blocks at least, so that only windows whose block suffix shares as many with a neighbour in
   suffix order can repeat; their bytes are then compared.

Anchors with more than MOST distinct runs (a passage in very many texts) would make a task grow with
the corpus: each of their windows becomes a run of its own, and step 2 settles them over the
cluster, by 128 bits of hash and without a comparison of bytes.

The contract of op6 fixes 400 bytes, which passages of little over 50 words do not fill. Its query goes
through the same steps once more with CUT_WINDOW and tells what that window covers in columns of
their own; the columns of the contract do not depend on it.

Texts are known by two 64-bit hashes, so that rows of equal text share their spans; results do not
depend on doc_id. Defined results: a null text is empty; a text shorter than the window keeps all;
texts of any length are looked through in pieces of PIECE windows; repeated rows repeat each other's
windows and so lose all of them; null and repeated doc_ids are returned as they are; an empty table
gives an empty result. Other columns are kept by `cut`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import drop_folder, free_prefix, new_folder, release, settle, table
from quillspan.llm.suffix_sort import common_prefixes, ending_marks, suffix_array

#: Default window in bytes, that of op6's contract.
WINDOW = 400
#: The window of `cut`, somewhat below the length of 50 words of prose.
CUT_WINDOW = 240
BLOCK = 16
#: Distinct runs of an anchor that one suffix array takes.
MOST = 2000
#: Longer texts are looked through in pieces of so many windows.
PIECE = 1 << 18
#: Texts and pieces are hashed end to end, in lines of about so many bytes.
LINE = 1 << 17

FACTOR = 0x9E3779B97F4A7C15
SPANS = "k1 long, k2 long, lo int, hi int"


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all substrings of a text from sums over its prefixes, modulo 2**64."""

    BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
    UP = np.ones(1, np.uint64)
    DOWN = np.ones(1, np.uint64)

    def __init__(self, text: bytes):
        self.grow(len(text) + 1)
        codes = self.BYTES[np.frombuffer(text, np.uint8)]
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(codes * self.UP[: len(text)], dtype=np.uint64, out=self.sums[1:])

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.UP) < n:
            n = max(n, 1 << 17)
            factors = np.full(n - 1, FACTOR, np.uint64), np.full(n - 1, pow(FACTOR, -1, 1 << 64), np.uint64)
            cls.UP, cls.DOWN = (np.concatenate([np.ones(1, np.uint64), np.cumprod(f, dtype=np.uint64)]) for f in factors)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.DOWN[begin])

    def all(self, length: int) -> np.ndarray:
        """Hashes of the strings of `length` bytes from the first on."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.DOWN[: len(self.sums) - length])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    x = np.concatenate([h, np.full(-len(h) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(text: bytes, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(anchor hash, run hash, first window, last window, anchor position) of the runs of a text."""
    return [row for line in runs_of([text], window) for row in zip(*[x.tolist() for x in line[1:]], strict=True)]


def runs_of(texts: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of many texts, as arrays with the number of the text before the columns of `runs`."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        for begin in range(0, max(0, len(text) - window + 1), PIECE):
            pieces.append((k, begin, text[begin : begin + PIECE + window - 1]))
            size += len(pieces[-1][2])
            if size >= LINE:
                yield _line_runs(pieces, window)
                pieces, size = [], 0
    if pieces:
        yield _line_runs(pieces, window)


def _line_runs(pieces: list[tuple[int, int, bytes]], window: int) -> tuple[np.ndarray, ...]:
    number, begin = (np.array(x, np.int64) for x in list(zip(*pieces, strict=True))[:2])
    ends = np.cumsum([len(text) for _, _, text in pieces])
    roll = Rolling(b"".join(text for _, _, text in pieces))
    gram = window // 2
    width = window - gram + 1
    grams = roll.all(gram)
    least = sliding_min(grams, width)
    inside = np.ones(len(least), bool)  # windows that lie in one piece
    for end in ends[:-1].tolist():
        inside[end - window + 1 : end] = False
    change = ~inside[1:] | ~inside[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(inside & np.concatenate([[True], change]))
    last = np.flatnonzero(inside & np.concatenate([change, [True]]))
    anchor = first + np.lib.stride_tricks.sliding_window_view(grams, width)[first].argmin(axis=1)
    early = anchor < last
    if early.any():  # equal strings within reach of each other
        parts = []
        for p, q in zip(first[early].tolist(), last[early].tolist(), strict=True):
            while p <= q:
                a = p + int(grams[p : p + width].argmin())
                parts.append((p, min(a, q), a))
                p = min(a, q) + 1
        whole = np.concatenate([np.stack([first, last, anchor], axis=1)[~early], np.array(parts, np.int64)])
        first, last, anchor = whole[np.argsort(whole[:, 0])].T
    run = mixed(roll.hash(first, last + window) + (anchor - first).astype(np.uint64) * np.uint64(FACTOR) + (last - first).astype(np.uint64))
    piece = np.searchsorted(ends, first, side="right")
    back = begin[piece] - np.concatenate([[0], ends[:-1]])[piece]
    return number[piece], least[first].view(np.int64), run.view(np.int64), first + back, last + back, anchor + back


def repeated_windows(group: list[tuple[bytes, int, bool]], window: int = WINDOW) -> list[list[int]]:
    """For each distinct run of an anchor, given as (bytes, place of the anchor in them, whether the
    run occurs twice), the windows, counted from its first, that repeat. Runs that occur twice get none."""
    ids: dict[bytes, int] = {}
    inner = (window - BLOCK + 1) // BLOCK  # whole blocks in any window, wherever it begins
    strings, starts = [], []
    for text, anchor, _ in group:
        start = anchor % BLOCK
        cut = range(start, len(text) - BLOCK + 1, BLOCK)
        strings.append([ids.setdefault(text[i : i + BLOCK], len(ids)) for i in cut])
        starts.append(start)
    line = ending_marks(strings)
    order = suffix_array(line)
    prefix = [*common_prefixes(line, order), 0]
    shared = [0] * len(line)
    for r, i in enumerate(order):
        shared[i] = max(prefix[r], prefix[r + 1])
    counts: Counter[bytes] = Counter()
    asked: list[list[tuple[int, bytes]]] = []
    base = 0
    for (text, _, twice), blocks, start in zip(group, strings, starts, strict=True):
        mine = []
        for d in range(len(blocks)):
            if shared[base + d] >= inner:
                end = start + d * BLOCK
                for p in range(max(0, end - BLOCK + 1), min(end, len(text) - window) + 1):
                    mine.append((p, text[p : p + window]))
        counts.update(w for _, w in mine)
        asked.append([] if twice else mine)
        base += len(blocks) + 1
    return [[p for p, w in mine if counts[w] > 1] for mine in asked]


def intervals(at: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for p in at:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


# Spark steps -------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(20), text).alias("k2"), text.cast("binary").alias("_bytes"))


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


_L, _I = pa.int64(), pa.int32()


def anchored_runs(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    def rows(batches):
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for number, anchor, run, *at in runs_of(batch.column("_bytes").to_pylist(), window):
                columns = [anchor, run, k1[number], k2[number], *[x.astype(np.int32) for x in at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "run", "k1", "k2", "lo", "hi", "at"])

    return keyed.select("k1", "k2", "_bytes").mapInArrow(rows, "anchor long, run long, k1 long, k2 long, lo int, hi int, at int")


def open_runs(keyed: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """The bytes of the wanted runs: anchor, run, twice, k1, k2, lo, place (of the anchor), bytes."""

    def rows(batches):
        names = ["anchor", "run", "twice", "k1", "k2", "lo", "place", "bytes"]
        kinds = [_L, _L, pa.bool_(), _L, _L, _I, _I, pa.binary()]
        for batch in batches:
            out = []
            for k1, k2, text, runs_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for r in runs_:
                    out.append((r["anchor"], r["run"], r["twice"], k1, k2, r["lo"], r["at"] - r["lo"], text[r["lo"] : r["hi"] + window]))
                if len(out) > 2000:
                    yield _batch(names, kinds, out)
                    out = []
            yield _batch(names, kinds, out)

    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "run", "twice", "lo", "hi", "at")).alias("runs"))
    lists = lists.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    met = keyed.select("k1", "k2", "_bytes").join(lists, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    return met.select("k1", "k2", "_bytes", "runs").mapInArrow(rows, "anchor long, run long, twice boolean, k1 long, k2 long, lo int, place int, bytes binary")


def sorted_spans(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repeated windows of the open runs by one suffix array for each anchor."""

    def spans(group):
        distinct = {run: (text, place, twice, k1, k2, lo) for _, run, twice, k1, k2, lo, place, text in group}
        rows = list(distinct.values())
        for (_, _, _, k1, k2, lo), at in zip(rows, repeated_windows([r[:3] for r in rows], window), strict=True):
            yield from ((k1, k2, lo + p, lo + q) for p, q in intervals(at))

    def rows(batches):
        lines = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out = []
        for _, group in groupby(lines, key=lambda r: r[0]):
            out += spans(group)
            if len(out) > 5000:
                yield _batch(["k1", "k2", "lo", "hi"], [_L, _L, _I, _I], out)
                out = []
        yield _batch(["k1", "k2", "lo", "hi"], [_L, _L, _I, _I], out)

    return found.repartition("anchor").sortWithinPartitions("anchor", "run").mapInArrow(rows, SPANS)


def single_windows(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repeated windows of the open runs, each window as a run of its own, for anchors with very many runs."""

    def rows(batches):
        for batch in batches:
            for anchor, twice, k1, k2, lo, text in zip(*[batch.column(c).to_pylist() for c in ("anchor", "twice", "k1", "k2", "lo", "bytes")], strict=True):
                at = np.arange(len(text) - window + 1)
                h = Rolling(text).hash(at, at + window).view(np.int64)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(h), pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array((lo + at).astype(np.int32)), pa.array([twice] * n, pa.bool_())],
                    names=["anchor", "window", "k1", "k2", "p", "twice"],
                )

    windows = found.dropDuplicates(["anchor", "run"]).mapInArrow(rows, "anchor long, window long, k1 long, k2 long, p int, twice boolean")
    counts = settle(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("_a"), F.col("window").alias("_w")))
    same = (F.col("anchor") == F.col("_a")) & (F.col("window") == F.col("_w"))
    return windows.where("not twice").join(counts, same, "left_semi").select("k1", "k2", F.col("p").alias("lo"), F.col("p").alias("hi"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, lo, hi): first and last start of repeated windows of each distinct text."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    every = anchored_runs(keyed, window)
    again = settle(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("_a")))
    folder = new_folder(spark, "runs")
    every.join(again, every["anchor"] == again["_a"]).drop("_a").write.parquet(folder)
    release(spark)
    live = spark.read.parquet(folder)
    one = F.min(F.struct("k1", "k2", "lo", "hi", "at")).alias("one")
    distinct = settle(live.groupBy("anchor", "run").agg(F.count("*").alias("n"), one))
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("runs"), F.min("n").alias("fewest")).where("runs > 1 and fewest = 1")
    sizes = settle(sizes.withColumnRenamed("anchor", "_a"))
    wanted = settle(distinct.join(sizes, distinct["anchor"] == sizes["_a"]).select("anchor", "run", (F.col("n") > 1).alias("twice"), "one.*", "runs"))
    twice = settle(distinct.where("n > 1").select(F.col("anchor").alias("_a"), F.col("run").alias("_r")))
    whole = live.join(twice, (live["anchor"] == twice["_a"]) & (live["run"] == twice["_r"]), "left_semi").select("k1", "k2", "lo", "hi")
    out = whole.unionByName(sorted_spans(open_runs(keyed, wanted.where(F.col("runs") <= MOST).drop("runs"), window), window))
    most = wanted.where(F.col("runs") > MOST)
    if not most.isEmpty():
        out = out.unionByName(single_windows(open_runs(keyed, most.drop("runs"), window), window))
    spans = settle(out.distinct())
    drop_folder(spark, folder)
    return spans


def removed(spans: list | None, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal byte ranges (begin, end) that the windows cover."""
    out: list[list[int]] = []
    for s in sorted((s["lo"], s["hi"]) for s in spans or []):
        begin, end = s[0], s[1] + window
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for begin, end in gone:
        out.append(text[at:begin])
        at = end
    return b"".join([*out, text[at:]])


def with_spans(docs: DataFrame, *windows: int) -> tuple[DataFrame, list[str]]:
    """`docs` with a column more for each length of windows, of the first and last starts of the repeated windows of its
    text, and the names of these columns."""
    p = free_prefix(docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({f"{p}1": F.xxhash64(text), f"{p}2": F.xxhash64(F.lit(20), text)})
    found = []
    for window in windows:
        found.append(repeated_spans(docs, window).withColumn("window", F.lit(window)))
        release(docs.sparkSession)
    names = [f"{p}spans{window}" for window in windows]
    spans = [F.collect_list(F.when(F.col("window") == window, F.struct("lo", "hi"))).alias(name) for window, name in zip(windows, names, strict=True)]
    lists = settle(reduce(DataFrame.unionByName, found).groupBy(F.col("k1").alias(f"{p}k1"), F.col("k2").alias(f"{p}k2")).agg(*spans))
    del found
    release(docs.sparkSession)  # what the last pass shuffled, before the texts are shuffled once more
    same = (F.col(f"{p}1") == F.col(f"{p}k1")) & (F.col(f"{p}2") == F.col(f"{p}k2"))
    return keyed.join(lists, same, "left").select(*docs.columns, *names), names


def cut(docs: DataFrame, window: int = CUT_WINDOW) -> DataFrame:
    """`docs` with repeated strings of `window` bytes cut from text and n_chars set anew. Where a cut splits a
    character, the rest of it goes too. Documents of which nothing but white space is left go."""
    names = docs.columns
    spanned, (name,) = with_spans(docs, window)

    def rows(batches):
        for batch in batches:
            texts, sizes, stays = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True):
                if spans:
                    text = kept(text.encode(), removed(spans, window)).decode("utf-8", "ignore")
                texts.append(text)
                sizes.append(None if text is None else len(text))
                stays.append(not spans or bool(text.strip()))
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            columns = [new[c] if c == "text" or (c == "n_chars" and pa.types.is_int64(batch.column(c).type)) else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    return spanned.mapInArrow(rows, docs.schema)


def digests(docs: DataFrame, window: int = WINDOW, passages: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of each row of `docs`; where a cut splits a
    character, kept_text lacks the rest of it, which kept_sha256 does not. With `passages`, also n_passage_bytes and
    n_passages: the bytes and spans that a window of so many bytes would remove."""
    windows = [window] if passages is None else [window, passages]
    spanned, spans = with_spans(docs.select("doc_id", "text"), *windows)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "n_passage_bytes", "n_passages"][: 4 + 2 * len(windows)]
    kinds = [_L, _L, _L, _L, pa.string(), pa.string(), _L, _L][: len(names)]

    def rows(batches):
        for batch in batches:
            out = []
            for doc_id, text, *found in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", *spans)], strict=True):
                raw = (text or "").encode()
                gone, *more = (removed(x, w) for x, w in zip(found, windows, strict=True))
                left = kept(raw, gone)
                line = doc_id, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")
                out.append(line + tuple(n for x in more for n in (sum(b - a for a, b in x), len(x))))
            yield _batch(names, kinds, out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return spanned.mapInArrow(rows, schema if passages is None else f"{schema}, n_passage_bytes long, n_passages long")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), passages=CUT_WINDOW)
