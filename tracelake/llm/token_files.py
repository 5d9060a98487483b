"""Token-ID files: one shared zstandard dictionary, one compressed frame a document.

A shard file holds, in ascending doc_id order,

    magic, SHA-256 of the dictionary, width of an id
    the frame of each document: its ids, little-endian, compressed alone with the dictionary
    the index: doc_id, whether it is null, offset and size of the frame, number of ids
    offset of the index, number of documents, magic

so that one short document is read with the footer, the index and its frame. The dictionary
(``dictionary.bin``) and the manifest of shards lie beside the shards. Shards are written by tasks
under names of their own attempt; only those the manifest lists count, so a lost or repeated task
leaves at most an unlisted file.

Defined results: null and empty texts give a document with the end id alone; repeated doc_ids
stand side by side, ordered by text; a null doc_id comes first; an empty table gives no shards.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, total_bytes
from .textkernel import TokenCache, slices

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"TLIDS\x00\x01\n"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u4")])
#: The dictionary is trained on at most so many documents, of each at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 64 << 10
SHARD_BYTES = 32 << 20
LEVEL = 3


#: Segments that go to the tokenizer as one text.
JOINED = 500


def _joins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which segments start with a blank, start for certain with something else, and end so."""
    first, last, before = data[starts], data[ends - 1], data[np.maximum(ends - 2, starts)]
    blank = (first == 32) | ((first >= 9) & (first <= 13))
    head = ((first >= 0x21) & (first <= 0x7E)) | ((first >= 0xC3) & (first <= 0xDF)) | ((first >= 0xE4) & (first <= 0xEF))
    return blank, head, ((last >= 0x21) & (last <= 0x7E)) | ((last >= 0x80) & (ends - starts > 1) & (before >= 0xC3) & (before <= 0xDF))


@lru_cache(2)
def _encoder(path: str) -> TokenCache:
    """The vocabulary's encoder and cache, kept by the Python worker from task to task.

    Many segments are encoded as one text, and the ids dealt out by the bytes they stand for: a call
    for every segment costs more than its ids. The tokenizer always splits before a segment with a
    blank; before others goes a line feed, which stands alone and whose id is dropped again.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    width = np.array([len(tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
    added = tokenizer.get_added_tokens_decoder()
    for i, token in added.items():
        width[i] = len(token.content.encode())  # its own text; other ids have a character a byte
    alone = [token.content.encode() for token in added.values()]

    def encode(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(segments)
        data = np.frombuffer(raw, dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, segments), dtype=np.int64, count=len(segments)))
        blank, head, tail = _joins(data, np.concatenate([[0], ends[:-1]]), ends)
        if any(x in raw for x in alone):  # a segment with an added token goes alone
            plain = np.array([not any(x in s for x in alone) for s in segments])
            blank, head, tail = blank & plain, head & plain, tail & plain
        fed = np.concatenate([[False], head[1:] & tail[:-1]])
        first = np.flatnonzero(np.concatenate([[True], ~(tail[:-1] & (blank | head)[1:])]))  # of each text
        place = np.arange(len(segments)) - np.repeat(first, np.diff(np.append(first, len(segments))))
        first = np.flatnonzero(place % JOINED == 0)
        raw = b"".join([b"\n" + s if f else s for s, f in zip(segments, fed.tolist(), strict=True)])
        ends += np.cumsum(fed)
        bounds = np.concatenate([[0], ends[first[1:] - 1], [len(raw)]]).tolist()
        got = tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)], add_special_tokens=False)
        ids = [np.array(e.ids, dtype=np.uint32) for e in got]
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
        reached = np.searchsorted(np.cumsum(width[flat]), ends, side="left") + 1
        sizes = np.diff(reached, prepend=0)
        return np.delete(flat, (reached - sizes)[fed]), sizes - fed

    return TokenCache(encode, whole=alone)


def _vocabulary_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _documents(batches: Iterator[pa.RecordBatch], cache: TokenCache, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with the end id) of every row."""
    for batch in batches:
        for a, b, offsets, data in slices(batch.column("text")):
            ids, bounds = cache.ids(offsets, data)
            for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                yield batch.column("doc_id")[a + i].as_py(), np.append(ids[s:e], np.uint32(end_id))


def train_dictionary(docs: DataFrame, path: str, end_id: int = 0) -> bytes:
    """A dictionary from a bounded sample: the documents whose doc_id hashes lowest.

    Where the sample is too small to train on, its serialized ids themselves are the dictionary.
    """
    sample = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(SAMPLE_DOCS).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if _vocabulary_width(path) == 2 else "<u4"
        samples = [ids.astype(kind).tobytes() for _, ids in _documents(batches, _encoder(path), end_id)]
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            data = b"".join(samples)[-DICTIONARY_BYTES:]
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    got = sample.mapInArrow(run, "data binary").first()
    return bytes(got[0]) if got else b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


MANIFEST = "path string, first_doc long, first_null boolean, n_docs long, n_ids long, n_bytes long"


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> DataFrame:
    """Writes all documents to shards under folder (a URI all executors reach); returns the manifest."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    data = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(data).digest()
    shards = max(1, total_bytes(docs, "text") // SHARD_BYTES)
    ordered = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _vocabulary_width(path)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data)).compress
        first, index, out, uri, at = None, [], None, f"{folder}/shard-{uuid.uuid4().hex}.ids", 0
        for doc_id, ids in _documents(batches, _encoder(path), end_id):
            if out is None:
                store, name = fs.FileSystem.from_uri(uri)
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                first, out = doc_id, store.open_output_stream(name)
                out.write(MAGIC + digest + bytes([width]))
                at = len(MAGIC) + len(digest) + 1
            frame = compress(ids.astype(f"<u{width}").tobytes())
            out.write(frame)
            index.append((doc_id or 0, doc_id is None, at, len(frame), len(ids)))
            at += len(frame)
        if out is None:
            return
        table = np.array(index, dtype=INDEX)
        out.write(table.tobytes() + at.to_bytes(8, "little") + len(table).to_bytes(8, "little") + MAGIC)
        out.close()
        row = [[uri], [first], [first is None], [len(table)], [int(table["n"].sum())], [at + table.nbytes + 16 + len(MAGIC)]]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["path", "first_doc", "first_null", "n_docs", "n_ids", "n_bytes"])

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    store, name = fs.FileSystem.from_uri(f"{folder}/dictionary.bin")
    with store.open_output_stream(name) as f:
        f.write(data)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Shard:
    """Reads one shard; document(i) touches only that document's frame."""

    def __init__(self, uri: str, dictionary: bytes):
        store, name = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(name)
        head = self.file.read(len(MAGIC) + 33)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) : -1] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a shard of this dictionary")
        self.kind = f"<u{head[-1]}"
        size = self.file.size()
        self.file.seek(size - len(MAGIC) - 16)
        tail = self.file.read(16 + len(MAGIC))
        at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        if tail[16:] != MAGIC:
            raise ValueError(f"{uri}: truncated")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * INDEX.itemsize), dtype=INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def document(self, i: int) -> np.ndarray:
        self.file.seek(int(self.index["offset"][i]))
        return np.frombuffer(self.unpack(self.file.read(int(self.index["size"][i]))), dtype=self.kind).astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document, found by binary search in the index."""
        nulls = int(self.index["null"].sum())
        i = nulls + int(np.searchsorted(self.index["doc_id"][nulls:], doc_id))
        return self.document(i) if i < len(self.index) and self.index["doc_id"][i] == doc_id else None


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """All documents of the manifest's shards, with the number of ids before each."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    order = Window.orderBy(F.col("first_null").desc(), "first_doc").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = fs.FileSystem.from_uri(f"{folder}/dictionary.bin")
        with store.open_input_stream(name) as f:
            dictionary = f.read()
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(uri, dictionary)
                starts = base + np.cumsum(shard.index["n"].astype(np.int64)) - shard.index["n"]
                for a in range(0, len(starts), 1000):
                    part = shard.index[a : a + 1000]
                    docs = [shard.document(i) for i in range(a, a + len(part))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part["doc_id"].astype(np.int64), mask=part["null"].astype(bool)),
                            pa.array(starts[a : a + 1000]),
                            pa.array([len(d) for d in docs], pa.int64()),
                            pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                            pa.array([d.astype(np.int32) if ids else None for d in docs], pa.list_(pa.int32())),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return based.select("path", "base").repartition(n).mapInArrow(run, READ)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract query: writes all documents and reads the files back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "token-files")
    write(docs, folder, public_tokenizers.path(VOCABULARY))
    return read(spark, folder, ids=False).drop("ids")
