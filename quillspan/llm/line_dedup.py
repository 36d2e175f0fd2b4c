"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference counts.

The key of a line is the line without ASCII white space at both ends, A-Z lower-cased; keys are held
as 128-bit digests. A `LineStore` is a folder of versions, each of two Parquet tables:

- `counts`: in how many documents each key is found, exactly. Documents that are inserted add to it,
  documents that are deleted take away from it.
- `filters`: for each shard of keys a cuckoo filter of the keys found in `min_docs` documents or more,
  and its exceptions, the rarer keys of the shard that the filter would take for frequent ones. The
  counts know every key, so that filter and exceptions together answer exactly.

An update moves only the fingerprints of keys that become frequent or cease to be; a filter that
overflows, or whose shard is cut anew as keys grow in number, is built again from the counts. A
version counts once both tables are written, so that an update which is cut off leaves the one
before in force, and deleting what was inserted last gives the answers from before.

Lines are looked up in the filters, never joined with counts by key, so that a line of all documents
lands in no single task. Filters of up to SENT_BYTES in all go to every executor; beyond that the
distinct pairs of text and key are dealt by shard, a shard in as many groups as its counts ask for.

Defined results: a null or empty text is one empty line; keys of fewer than `min_chars` code points
stay; texts and lines of any length count whole; a key counts once in a document, and each row is a
document of its own, repeated rows and null or repeated doc_ids included; an empty table gives an
empty result. Deleting what was never inserted is an error and leaves the store as it is. Columns
other than text are kept by `cut_lines`, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import free_prefix, join_dimension, new_folder, table

MIN_CHARS = 1
MIN_DOCS = 10
#: Keys that a shard holds at most, nearly.
SHARD_KEYS = 1 << 17
#: Filters of up to so many bytes in all are sent to every executor.
SENT_BYTES = 32 << 20
#: Pairs of text and key that a task looks up at once, nearly.
GROUP_ROWS = 1 << 18

SLOTS = 4
KICKS = 500
WHITE = b" \t\n\x0b\x0c\r"
KEYS = np.dtype("<i8")


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes]:
    """Digest of the key of each line; b"" for lines whose key is too short."""
    keys = (line.strip(WHITE).lower() for line in text.split(b"\n"))  # of bytes, lower() changes A-Z only
    return [hashlib.blake2b(k, digest_size=16).digest() if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else b"" for k in keys]


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), KEYS).reshape(len(digests), 2)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four slots; each fingerprint has two buckets."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of all `keys`, as large as they need."""
        buckets = 1
        while buckets * SLOTS * 0.9 < len(keys):
            buckets *= 2
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if all(made.add(int(k)) for k in keys):
                return made
            buckets *= 2

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.uint64)
        prints = np.maximum(k >> np.uint64(48), np.uint64(1))
        last = np.uint64(len(self.slots) - 1)
        one = k & last
        return prints.astype(np.uint16), one.astype(np.int64), (one ^ (self._jump(prints) & last)).astype(np.int64)

    @staticmethod
    def _jump(prints):
        return prints * np.uint64(0x5BD1E995) >> np.uint64(5)

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(keys)
        return ((self.slots[one] == prints[:, None]) | (self.slots[two] == prints[:, None])).any(axis=1)

    def _put(self, bucket: int, fingerprint: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = fingerprint
        return bool(len(free))

    def add(self, key: int) -> bool:
        """False if the filter is too full; it then lacks a fingerprint and is of no more use."""
        prints, one, two = self.places(np.array([key]))
        fingerprint, bucket = int(prints[0]), int(one[0])
        if self._put(bucket, fingerprint) or self._put(int(two[0]), fingerprint):
            return True
        draw = random.Random(key)
        for _ in range(KICKS):
            slot = draw.randrange(SLOTS)
            fingerprint, self.slots[bucket, slot] = int(self.slots[bucket, slot]), fingerprint
            bucket ^= int(self._jump(np.uint64(fingerprint))) & (len(self.slots) - 1)
            if self._put(bucket, fingerprint):
                return True
        return False

    def remove(self, key: int) -> None:
        """Takes out one fingerprint of a key that was added."""
        prints, one, two = self.places(np.array([key]))
        for bucket in (int(one[0]), int(two[0])):
            found = np.flatnonzero(self.slots[bucket] == prints[0])
            if len(found):
                self.slots[bucket, found[0]] = 0
                return
        raise KeyError(key)


class Shard:
    """A filter and its exceptions, as they are stored."""

    def __init__(self, slots: bytes, exceptions: bytes):
        self.filter = CuckooFilter(np.frombuffer(slots, np.uint16).reshape(-1, SLOTS))
        self.exceptions = {tuple(x) for x in np.frombuffer(exceptions, KEYS).reshape(-1, 2).tolist()}

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        found = self.filter.has(keys[:, 1])
        for i in np.flatnonzero(found) if self.exceptions else ():
            found[i] = tuple(keys[i].tolist()) not in self.exceptions
        return found


class Shards(dict):
    """Shards by number, each opened when it is first asked for; None for those without keys."""

    def __init__(self, stored: dict[int, tuple[bytes, bytes]], n_shards: int):
        self.stored, self.n_shards = stored, n_shards

    def __missing__(self, shard: int) -> Shard | None:
        self[shard] = Shard(*self.stored[shard]) if shard in self.stored else None
        return self[shard]

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        at = np.mod(keys[:, 0], self.n_shards)
        for shard in np.unique(at).tolist():
            if self[shard]:
                mine = np.flatnonzero(at == shard)
                found[mine] = self[shard].frequent(keys[mine])
        return found


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, n): in how many rows of `docs` each key is found."""

    def rows(batches):
        for batch in batches:
            n = Counter()
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                n.update(set(line_keys(text or b"", min_chars)))
            n.pop(b"", None)
            keys = halves(list(n))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n.values(), pa.int64())], names=["k1", "k2", "n"])

    return docs.select("text").mapInArrow(rows, "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n"))


class LineStore:
    """Counts and filters of the documents inserted so far, below `folder` (of the shared file system)."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        self.spark, self.folder, self.min_docs, self.min_chars, self.shard_keys = spark, folder, min_docs, min_chars, shard_keys

    def version(self) -> int:
        """Number of the last whole version; 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        done = [n for n in names if n.startswith("v") and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/filters/_SUCCESS"))]
        return max((int(n[1:]) for n in done), default=0)

    def _table(self, version: int, name: str) -> str:
        return f"{self.folder}/v{version:06d}/{name}"

    def counts(self) -> DataFrame:
        """(k1, k2, n) of the keys that documents of the store hold."""
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], "k1 long, k2 long, n long")
        return self.spark.read.parquet(self._table(version, "counts")).where("n > 0").select("k1", "k2", "n")

    def filters(self) -> DataFrame:
        """(shard, n_shards, n_rows, slots, exceptions); n_rows is the sum of the counts of the shard."""
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], "shard long, n_shards long, n_rows long, slots binary, exceptions binary")
        return self.spark.read.parquet(self._table(version, "filters"))

    def insert(self, docs: DataFrame) -> None:
        self._update(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Takes back documents that were inserted, by their texts."""
        self._update(docs, -1)

    def _update(self, docs: DataFrame, sign: int) -> None:
        version, min_docs = self.version(), self.min_docs
        old, delta = self.counts(), line_counts(docs, self.min_chars)
        both = old.withColumn("was", F.col("n")).unionByName(delta.select("k1", "k2", (F.col("n") * sign).alias("n"), F.lit(0).cast("long").alias("was")))
        merged = both.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
        path = self._table(version + 1, "counts")
        merged.write.mode("overwrite").parquet(path)
        merged = self.spark.read.schema("k1 long, k2 long, n long, was long").parquet(path)
        least, total = merged.agg(F.min("n"), F.count("*")).first()
        if least is not None and least < 0:
            raise ValueError("documents to delete were never inserted")
        n_shards = 1
        while n_shards * self.shard_keys < total:
            n_shards *= 2
        columns = "shard long, n_shards long, n_rows long, slots binary, exceptions binary"

        def refresh(key: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
            k1, k2, n, was = (keys.column(c).to_numpy() for c in ("k1", "k2", "n", "was"))
            now, before = n >= min_docs, was >= min_docs
            whole = None
            if filters.num_rows:
                whole = CuckooFilter(np.frombuffer(filters.column("slots")[0].as_py(), np.uint16).reshape(-1, SLOTS).copy())
                for k in k2[before & ~now]:
                    whole.remove(int(k))
                if not all(whole.add(int(k)) for k in k2[now & ~before]):
                    whole = None
            if whole is None:
                whole = CuckooFilter.of(k2[now])
            wrong = (n > 0) & ~now
            wrong[wrong] = whole.has(k2[wrong])
            exceptions = np.stack([k1[wrong], k2[wrong]], axis=1).astype(KEYS).tobytes()
            row = (key[0].as_py(), n_shards, int(n.sum()), whole.slots.tobytes(), exceptions)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["shard", "n_shards", "n_rows", "slots", "exceptions"])

        keyed = merged.withColumn("shard", F.pmod("k1", F.lit(n_shards)).cast("long")).groupBy("shard")
        same = self.filters().where(F.col("n_shards") == n_shards).groupBy("shard")
        keyed.cogroup(same).applyInArrow(refresh, columns).write.mode("overwrite").parquet(self._table(version + 1, "filters"))


def text_drops(docs: DataFrame, filters: DataFrame, n_shards: int, min_chars: int, text: str, names: tuple[str, str, str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each distinct text with frequent keys these keys, `names` being the columns of the hashes of a text and of the keys."""

    def pairs(batches):
        for batch in batches:
            t1, t2, d = [], [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                keys = set(line_keys(raw or b"", min_chars)) - {b""}
                t1 += [a] * len(keys)
                t2 += [b] * len(keys)
                d += keys
            k = halves(d)
            yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["t1", "t2", "k1", "k2"])

    def look_up(key: tuple, rows: pa.Table, shard: pa.Table) -> pa.Table:
        if not shard.num_rows or not rows.num_rows:
            return rows.slice(0, 0).select(["t1", "t2", "k1", "k2"])
        keys = np.stack([rows.column("k1").to_numpy(), rows.column("k2").to_numpy()], axis=1)
        found = Shard(shard.column("slots")[0].as_py(), shard.column("exceptions")[0].as_py()).frequent(keys)
        return rows.filter(pa.array(found)).select(["t1", "t2", "k1", "k2"])

    # the sum of counts is the number of rows of a shard, so that each shard is dealt into groups of about group_rows
    parts = F.ceil(F.col("n_rows") / F.lit(group_rows)).cast("long")
    filters = filters.withColumn("parts", F.greatest(parts, F.lit(1).cast("long")))
    groups = filters.select("shard", F.col("parts").alias("groups"))
    dealt = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).groupBy("shard", "part")
    found = docs.select(names[0], names[1], text).mapInArrow(pairs, "t1 long, t2 long, k1 long, k2 long").distinct()
    found = found.withColumn("shard", F.pmod("k1", F.lit(n_shards)).cast("long"))
    found = join_dimension(found, groups, ["shard"], "inner", F.col("t1")).withColumn("part", F.pmod(F.xxhash64("t1", "t2"), F.col("groups")))
    hits = found.groupBy("shard", "part").cogroup(dealt).applyInArrow(look_up, "t1 long, t2 long, k1 long, k2 long")
    return hits.groupBy(F.col("t1").alias(names[0]), F.col("t2").alias(names[1])).agg(F.collect_list(F.struct("k1", "k2")).alias(names[2]))


def without_lines(docs: DataFrame, store: LineStore, finish, schema, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """`finish(batch, rows)` of each batch of `docs`, rows being (lines, dropped or not) of each text."""
    spark, min_chars, columns = docs.sparkSession, store.min_chars, docs.columns
    filters = store.filters()
    n_bytes, n_shards = filters.agg(F.sum(F.octet_length("slots") + F.octet_length("exceptions")), F.max("n_shards")).first()
    n_shards = n_shards or 1
    p = free_prefix(columns)
    sent = None
    if (n_bytes or 0) <= sent_bytes:
        sent = spark.sparkContext.broadcast({r["shard"]: (bytes(r["slots"]), bytes(r["exceptions"])) for r in filters.collect()})  # of checked size
    else:
        names = (f"{p}1", f"{p}2", f"{p}keys")
        text = F.coalesce(F.col("text"), F.lit(""))
        docs = docs.withColumns({names[0]: F.xxhash64(text), names[1]: F.xxhash64(F.lit(1), text)})
        drops = text_drops(docs, filters, n_shards, min_chars, "text", names)
        docs = docs.join(drops, [names[0], names[1]], "left").drop(names[0], names[1])  # AQE splits a text that very many rows share

    def rows(batches):
        shards = Shards(sent.value, n_shards) if sent is not None else None
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            digests = [line_keys(x, min_chars) for x in texts]
            if shards is not None:
                distinct = list({d for keys in digests for d in keys if d})
                found = shards.frequent(halves(distinct))
                gone = [{d for d, f in zip(distinct, found, strict=True) if f}] * len(texts)
            else:
                gone = [{halves_bytes(k) for k in keys or ()} for keys in batch.column(f"{p}keys").to_pylist()]
            yield finish(batch.select(columns), [(x.split(b"\n"), [k in g for k in keys]) for x, keys, g in zip(texts, digests, gone, strict=True)])

    return docs.mapInArrow(rows, schema)


def halves_bytes(key: dict) -> bytes:
    return np.array([key["k1"], key["k2"]], KEYS).tobytes()


def cut_lines(docs: DataFrame, store: LineStore, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """`docs` without the lines that the store has as frequent; texts without such lines, null ones too, are as they were."""

    def finish(batch, rows):
        old = batch.column("text").to_pylist()
        texts = [b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g).decode() if any(gone) else t for t, (lines, gone) in zip(old, rows, strict=True)]
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return without_lines(docs, store, finish, docs.schema, sent_bytes)


def digests(docs: DataFrame, store: LineStore, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of `docs`."""

    def finish(batch, rows):
        kept = [hashlib.sha256(b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g)).hexdigest() for lines, gone in rows]
        columns = [batch.column("doc_id"), pa.array([len(x) for x, _ in rows], pa.int64()), pa.array([sum(g) for _, g in rows], pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return without_lines(docs.select("doc_id", "text"), store, finish, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", sent_bytes)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = LineStore(spark, new_folder(spark, "lines"))
    store.insert(docs)
    return digests(docs, store)


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM d),
k AS MATERIALIZED (SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k FROM k WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(f.k) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (k) GROUP BY r
"""
