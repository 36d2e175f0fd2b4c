"""Byte-pair encoding and decoding of a corpus through a table of distinct words.

A word is a run of white space with the characters after it up to the next white space. Byte-level
pre-tokenisers never join a character to white space that follows it, so that a text's ids are its
words' ids one after the other. `encode` therefore

1. cuts the documents into chunks of about CHUNK_BYTES, and each chunk into its distinct words;
2. deals the words of all chunks by hash: each task holds every occurrence of its words, encodes
   each distinct one once with the tokenizers library, and answers each chunk with the ids in the
   order in which the chunk asked;
3. brings each chunk's answers and its documents together and puts ids at the words' positions.

Only distinct words and one compressed copy of the texts are shuffled. Chunks are bounded by bytes,
not by a key, so that no group can grow hot; a word that every document holds is asked for once a
chunk. Steps 1 and 3 cut the documents twice: they must be a stored table (a chunk whose words
changed between the two is found by a checksum and fails the job rather than giving wrong ids).

`decode` joins ids to the pieces of the vocabulary, a table whose size the tokenizer file fixes.

Defined results: a null text is empty and has no ids; a text of any length is encoded whole, within one chunk; a null doc_id is kept; repeated rows are
encoded row by row; an empty table gives an empty result; columns of the input other than doc_id and
text are not read. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import table

CHUNK_BYTES = 12 << 20
#: The characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Words and pieces that a worker remembers at most; then it begins anew.
REMEMBERED, REMEMBERED_PIECES = 800_000, 400_000
#: Fixed value: how byte-level pre-tokenisers cut a word into the pieces that are merged.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Below this character, letters and numbers are those of every Unicode version.
LATIN = "\u0250"


class Encoder:
    """Ids of words and texts as little-endian bytes, WIDTH bytes an id."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = json.loads(tokenizer_json).get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that reach beyond their own characters are not supported")
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in added) + ")") if added else None
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = 2 if self.kind == "H" else 4
        self.known = _Words(self.word, REMEMBERED)
        self.merged = _Words(self._merge, REMEMBERED_PIECES)
        kinds = [(chr(c), unicodedata.category(chr(c))[0]) for c in range(ord(LATIN))]
        letters, numbers = ("".join(re.escape(c) for c, k in kinds if k == kind) for kind in "LN")
        cut = CUT.format(L=f"[{letters}]", N=f"[{numbers}]", S=WHITE, l=letters, n=numbers)
        plain = json.loads(tokenizer_json)
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        byte_level = plain.get("normalizer") is None and level.items() <= (plain.get("pre_tokenizer") or {}).items()
        self.cut = re.compile(cut) if byte_level else None
        self.shown = "".join(_byte_characters())

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if self.special is None or not self.special.search(text):
            return WORD.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else WORD.findall(part)
        return out

    def word(self, word: str) -> bytes:
        """The ids of a word, from the merges of its pieces where the cut is certain, else from the library as a whole."""
        if self.cut is None or max(word, default="") >= LATIN or (self.special and self.special.search(word)):
            return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.merged.__getitem__, self.cut.findall(word)))

    def _merge(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.shown)
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def text(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.words(text)))


class _Words(dict):
    def __init__(self, of: Callable[[str], bytes], most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.of(word)
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(tokenizer_json: str) -> Encoder:
    """The encoder of this Python worker, which lives on from task to task."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def pieces(tokenizer_json: str) -> pa.Array:
    """The bytes of each id; ids that the vocabulary lacks are empty."""
    of_char = {c: b for b, c in enumerate(_byte_characters())}
    spec = json.loads(tokenizer_json)
    vocab = {i: bytes(of_char[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    vocab |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return pa.array([vocab.get(i, b"") for i in range(max(vocab) + 1)], pa.binary())


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def decode_ids(ids: np.ndarray, vocabulary: pa.Array) -> bytes:
    """The bytes of a run of ids: each id gathers its piece."""
    found = pc.take(vocabulary, pa.array(np.where(ids < len(vocabulary), ids, 0)))
    if len(ids) and int(ids.max()) >= len(vocabulary):
        return b"".join(p for p, i in zip(found.to_pylist(), ids, strict=True) if i < len(vocabulary))
    offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    return found.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(ids) else b""


# the shuffle's rows ------------------------------------------------------------------------------


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(chunk, doc_ids, texts), chunks numbered over all tasks."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def _asked(encoder: Encoder, texts: list[str], buckets: int) -> list[list[str]]:
    """The distinct words of the texts in a fixed order, by the bucket that encodes them."""
    seen: set[str] = set()
    for text in texts:
        seen.update(encoder.words(text))
    out: list[list[str]] = [[] for _ in range(buckets)]
    for word in sorted(seen):
        out[zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets].append(word)
    return out


def _packed(items: list[bytes]) -> bytes:
    """Items with their lengths in front, compressed."""
    lengths = np.fromiter(map(len, items), np.uint32, len(items)).tobytes()
    return zstandard.ZstdCompressor(1).compress(struct.pack("<I", len(items)) + lengths + b"".join(items))


def _unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64).tolist()
    body, begin, out = memoryview(raw)[4 + 4 * n :], 0, []
    for end in ends:
        out.append(bytes(body[begin:end]))
        begin = end
    return out


def _blob(columns: list[tuple[str, list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in columns], names=[n for n, _, _ in columns])


def encode_chunks(docs: DataFrame, tokenizer_json: str, finish: Callable, schema: str) -> DataFrame:
    """`finish(doc_ids, ids_of_each)` for the documents of each chunk, where ids are arrays of numbers.

    It gives a record batch of `schema`.
    """
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    buckets = max(8, 2 * docs.rdd.getNumPartitions())

    def ask(batches):
        encoder = encoder_of(sent.value)
        for chunk, _, texts in _chunks(batches):
            for k, asked in enumerate(_asked(encoder, texts, buckets)):
                if asked:
                    yield _blob([("bucket", [k], pa.int32()), ("chunk", [chunk], pa.int64()), ("words", [_packed([w.encode("utf-8", "surrogatepass") for w in asked])], pa.binary())])

    def answer(batches):
        # rows come sorted by bucket: the table of distinct words lasts for one bucket
        encoder, bucket, ids = encoder_of(sent.value), None, {}
        for batch in batches:
            for k, chunk, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != bucket:
                    bucket, ids = k, {}
                asked = _unpacked(blob)
                for word in asked:
                    if word not in ids:
                        ids[word] = encoder.word(word.decode("utf-8", "surrogatepass"))
                check = zlib.crc32(b"\0".join(asked))
                yield _blob([("chunk", [chunk], pa.int64()), ("bucket", [k], pa.int32()), ("check", [check], pa.int64()), ("ids", [_packed([ids[w] for w in asked])], pa.binary())])

    def pack(batches):
        for chunk, ids, texts in _chunks(batches):
            held = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as writer:
                writer.write_batch(held)
            yield _blob([("chunk", [chunk], pa.int64()), ("docs", [zstandard.ZstdCompressor(3).compress(sink.getvalue())], pa.binary())])

    def put(held: pa.Table, answers: pa.Table) -> pa.Table:
        encoder = encoder_of(sent.value)
        out = []
        for blob in held.column("docs").to_pylist():
            raw = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
            texts = raw.column("text").to_pylist()
            answered = {k: (check, _unpacked(b)) for k, check, b in zip(answers.column("bucket").to_pylist(), answers.column("check").to_pylist(), answers.column("ids").to_pylist(), strict=True)}
            ids: dict[str, bytes] = {}
            for k, asked in enumerate(_asked(encoder, texts, buckets)):
                if asked:
                    check, found = answered.get(k, (None, []))
                    if check != zlib.crc32(b"\0".join(w.encode("utf-8", "surrogatepass") for w in asked)):
                        raise ValueError("the documents came in another order than before; store them first")
                    ids.update(zip(asked, found, strict=True))
            kind = np.dtype(f"<u{encoder.width}")
            out.append(finish(raw.column("doc_id").to_pylist(), (np.frombuffer(b"".join(map(ids.__getitem__, encoder.words(t))), kind) for t in texts)))
        return pa.Table.from_batches(out)

    asked = docs.mapInArrow(ask, "bucket int, chunk long, words binary")
    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    answers = dealt.mapInArrow(answer, "chunk long, bucket int, check long, ids binary")
    held = docs.mapInArrow(pack, "chunk long, docs binary")
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(put, schema)


def encode(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of `docs`."""

    def finish(doc_ids, ids_of_each):
        values = [x.astype(np.int32) for x in ids_of_each]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(values, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encode_chunks(docs, tokenizer_json, finish, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id and text of each row of doc_id and ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)

    def texts(batches):
        vocabulary = pieces(sent.value)
        for batch in batches:
            out = [decode_ids(np.asarray(x or [], np.int64), vocabulary).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, for each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kept: dict = {}

    def finish(doc_ids, ids_of_each):
        if not kept:
            kept["pieces"] = pieces(sent.value)
            kept["decimal"] = [str(i) for i in range(len(kept["pieces"]))]
        rows = []
        for doc_id, ids in zip(doc_ids, ids_of_each, strict=True):
            decimal = ",".join(map(kept["decimal"].__getitem__, ids.tolist()))
            decoded = decode_ids(ids, kept["pieces"]).decode("utf-8", "replace")
            rows.append((doc_id, len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        ids, counts, a, b = zip(*rows, strict=True) if rows else ([], [], [], [])
        return _blob([("doc_id", list(ids), pa.int64()), ("n_tokens", list(counts), pa.int64()), ("ids_sha256", list(a), pa.string()), ("decoded_sha256", list(b), pa.string())])

    return encode_chunks(docs, tokenizer_json, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_tokenizer())
