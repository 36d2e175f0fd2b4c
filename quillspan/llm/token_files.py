"""Token ids as Arrow files of fixed-size lists, and their way back.

Documents are ordered by doc_id, encoded, ended by END and laid end to end; the run is cut into
sequences of LENGTH ids. A shard is one Arrow IPC file whose record batches hold BATCH sequences
each (the last may hold fewer): `tokens` is a fixed-size list of unsigned integers, `mask` marks the
places that hold a token (false only in the padding of a shard's last sequence), and `ends` marks
the last token of each document. All sequences being of one length, sequence i of a shard lies in
batch i // BATCH, row i % BATCH, and TokenFile reads it from the memory map without a copy. A second
Arrow file beside it lists the doc_ids of the shard in order.

Each task writes the shards of its range of doc_ids under names of their own and returns a manifest
row for each; only shards in the settled manifest count, so that tasks which ran twice do no harm.

Defined results: a text of any length is encoded whole; a null text is empty and leaves only END; null doc_ids come first; repeated rows
are written one by one, those of one doc_id in the order of a hash of their texts, so that reruns agree; an empty table writes nothing.
Columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.llm.bpe import default_tokenizer, encoder_of
from quillspan.llm.common import new_folder, open_store, settle, table

LENGTH = 2048
BATCH = 64
#: Rows that are read back before they are passed on.
MOST_ROWS = 50_000
END = 0
#: A shard is closed at the first document end after so many ids.
SHARD_IDS = 64 << 20


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes documents, one after the other, into a shard and its list of doc_ids."""

    def __init__(self, store: fs.FileSystem, path: str, width: int, length: int = LENGTH):
        self.kind, self.dtype = (pa.uint16(), np.dtype("<u2")) if width == 2 else (pa.uint32(), np.dtype("<u4"))
        self.length, self.path, self.n_tokens = length, path, 0
        self.out = store.open_output_stream(f"{path}.arrow", compression=None)
        self.names = store.open_output_stream(f"{path}.docs.arrow", compression=None)
        self.writer = pa.ipc.new_file(self.out, _schema(self.kind, length))
        self.listing = pa.ipc.new_file(self.names, pa.schema([("doc_id", pa.int64())]))
        self.ids: list[bytes] = []
        self.ends: list[int] = []
        self.held = 0
        self.doc_ids: list = []
        self.n_docs = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(ids)
        n = len(ids) // self.dtype.itemsize
        self.held += n
        self.n_tokens += n
        self.n_docs += 1
        self.ends.append(self.held - 1)
        self.doc_ids.append(doc_id)
        if self.held >= 8 * BATCH * self.length:
            self._flush(self.held // (BATCH * self.length) * BATCH)

    def _flush(self, sequences: int) -> None:
        flat = np.frombuffer(b"".join(self.ids), self.dtype)
        n = sequences * self.length
        tokens, mask, ends = np.zeros(n, self.dtype), np.zeros(n, bool), np.zeros(n, bool)
        real = min(n, len(flat))
        tokens[:real] = flat[:real]
        mask[:real] = True
        at = np.array(self.ends, np.int64)
        ends[at[at < real]] = True
        for k in range(0, sequences, BATCH):
            cut = slice(k * self.length, min(k + BATCH, sequences) * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut], t), self.length) for x, t in ((tokens, self.kind), (mask, pa.bool_()), (ends, pa.bool_()))]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=_schema(self.kind, self.length)))
        self.ids, self.ends, self.held = [flat[real:].tobytes()], (at[at >= real] - real).tolist(), len(flat) - real
        self.listing.write_batch(pa.RecordBatch.from_arrays([pa.array(self.doc_ids, pa.int64())], names=["doc_id"]))
        self.doc_ids = []

    def close(self) -> None:
        if self.held or self.doc_ids:
            self._flush(-(-self.held // self.length))
        for x in (self.writer, self.listing, self.out, self.names):
            x.close()


class TokenFile:
    """Sequences of a local shard by number, as views of the memory map."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        self.reader = pa.ipc.open_file(self.map)
        last = self.reader.num_record_batches - 1
        self.n = BATCH * last + self.reader.get_batch(last).num_rows if last >= 0 else 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids of sequence i (no copy) and its mask."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch = self.reader.get_batch(i // BATCH)
        tokens, mask = (batch.column(c) for c in ("tokens", "mask"))
        length = tokens.type.list_size
        cut = slice(i % BATCH * length, (i % BATCH + 1) * length)
        return tokens.values[cut].to_numpy(), mask.values[cut]


def read_shard(store: fs.FileSystem, path: str):
    """(doc_id, ids) of each document of a shard, from its two files."""
    with store.open_input_file(f"{path}.docs.arrow") as names:
        listing = pa.ipc.open_file(names)
        doc_ids = [x for k in range(listing.num_record_batches) for x in listing.get_batch(k).column(0).to_pylist()]
    with store.open_input_file(f"{path}.arrow") as f:
        reader = pa.ipc.open_file(f)
        rest, k = None, 0
        for b in range(reader.num_record_batches):
            batch = reader.get_batch(b)
            mask = batch.column("mask").values.to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens").values.to_numpy()[mask]
            begin = 0
            for end in np.flatnonzero(batch.column("ends").values.to_numpy(zero_copy_only=False)) + 1:
                ids = tokens[begin:end]
                yield doc_ids[k], ids if rest is None else np.concatenate([rest, ids])
                rest, begin, k = None, end, k + 1
            if begin < len(tokens):
                rest = tokens[begin:].copy() if rest is None else np.concatenate([rest, tokens[begin:]])


def write(docs: DataFrame, folder: str, tokenizer_json: str, length: int = LENGTH, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards under `folder`; the settled manifest: part, shard, path, n_docs, n_tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def shards(batches):
        from pyspark import TaskContext

        encoder, part, shard, writer, manifest = encoder_of(sent.value), TaskContext.get().partitionId(), 0, None, []
        store, root = open_store(folder)
        end = END.to_bytes(encoder.width, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    writer = ShardWriter(store, f"{root}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}", encoder.width, length)
                writer.add(doc_id, encoder.text(text or "") + end)
                if writer.n_tokens >= shard_ids:
                    writer.close()
                    manifest.append((part, shard, writer.path, writer.n_docs, writer.n_tokens))
                    writer, shard = None, shard + 1
        if writer is not None:
            writer.close()
            manifest.append((part, shard, writer.path, writer.n_docs, writer.n_tokens))
        names = ["part", "shard", "path", "n_docs", "n_tokens"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        for row in manifest:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    # rows of one doc_id, null among them, follow each other by a hash of their texts, so that reruns agree
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return settle(ordered.mapInArrow(shards, "part int, shard int, path string, n_docs long, n_tokens long"))


def offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with `first`, the ids of all shards before each one."""
    block = F.expr("part div 1024")
    sums = manifest.groupBy(block.alias("block")).agg(F.sum("n_tokens").alias("block_tokens"))
    blocks = sums.select("block", (F.sum("block_tokens").over(W.orderBy("block")) - F.col("block_tokens")).alias("block_first"))
    inside = F.sum("n_tokens").over(W.partitionBy("block").orderBy("part", "shard")) - F.col("n_tokens")
    return manifest.withColumn("block", block).withColumn("inside", inside).join(blocks, "block").select(*manifest.columns, (F.col("block_first") + F.col("inside")).alias("first"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the shards of the manifest."""
    tasks = max(8, 2 * manifest.sparkSession.sparkContext.defaultParallelism)

    def documents(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = ([], [], [], [])
                for doc_id, ids in read_shard(store, path):
                    if len(rows[0]) == MOST_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = ([], [], [], [])
                    for column, value in zip(rows, (doc_id, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(value)
                    first += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = offsets(manifest).select("path", "first").repartition(tasks, "path")
    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    return read(write(table(spark, sf_dir, "documents"), folder, default_tokenizer()), folder)
