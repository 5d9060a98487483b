"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes (normalised: a strict mask below the normal chunk length, a
loose one above it, hard least and most lengths) sets chunk boundaries, so an edit moves only the
boundaries near it. A document's fingerprint is the set of its chunks' digests with the bytes each
covers. The query's likeness (near_edited, near_next) is containment: the shared weight over the
weight of the document's own chunks. ``likeness`` is the symmetric form, over the weight of both.

Defined results: null and empty texts have an empty fingerprint, contained (1) in an empty one and
not (0) in any other; equal texts have equal fingerprints; a document's follower is the next row by (doc_id,
hash of the text), null doc_ids first, and the last row's is the first; an only row follows
itself; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, total_bytes
from .textkernel import mix

LEAST, NORMAL, MOST = 24, 64, 256
#: Bits that a boundary's hash must have clear: stricter before the normal length than after it.
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xF8000000)
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Text bytes a range of documents should hold.
RANGE_BYTES = 16 << 20
#: Ranges at most; beyond it they grow. A range streams by in order and is never held whole.
MOST_PARTS = 8192


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the last 32 bytes, by doubling the span."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step].copy() << np.uint32(step)
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear(data)
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = loose[(h[loose - 1] & STRICT) == 0]
    out, start = [], 0
    loose_at, strict_at = loose.tolist(), strict.tolist()
    i = j = 0
    while start < n:
        end = min(n, start + MOST)
        while j < len(strict_at) and strict_at[j] < start + LEAST:
            j += 1
        if j < len(strict_at) and strict_at[j] < start + NORMAL:
            end = min(end, strict_at[j])
        else:
            while i < len(loose_at) and loose_at[i] < start + NORMAL:
                i += 1
            if i < len(loose_at):
                end = min(end, loose_at[i])
        out.append(end)
        start = end
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Digest to covered bytes, of a text's chunks."""
    raw = text.encode()
    out: dict[int, int] = {}
    start = 0
    for end in boundaries(np.frombuffer(raw, dtype=np.uint8)):
        digest = xxhash.xxh3_64_intdigest(raw[start:end])
        out[digest] = out.get(digest, 0) + end - start
        start = end
    return out


def serialize(prints: dict[int, int]) -> str:
    return ",".join(f"{d:016x}:{w}" for d, w in sorted(prints.items()))


def parse(prints: str) -> dict[int, int]:
    return {int(d, 16): int(w) for d, w in (x.split(":") for x in prints.split(",") if x)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared weight over all weight (a weighted Jaccard)."""
    total = sum(a.values()) + sum(b.values())
    if not total:
        return 1.0
    shared = sum(min(w, b[d]) for d, w in a.items() if d in b)
    return shared / (total - shared)


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared weight over the weight of a."""
    total = sum(a.values())
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / total if total else float(not b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [serialize(fingerprint(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _bounds(docs: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """Ascending bounds (there, id, tag) that cut the rows into about n parts of equal numbers of rows.

    An id that holds several parts' rows, or the rows without one, are cut by the hash of the text.
    """
    if n == 1:
        return []
    shares = [i / n for i in range(1, n)]
    got = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids"), F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("q")).first()
    nulls = got["rows"] - got["ids"]
    cuts = lambda k: [-(1 << 63) + (j << 64) // k - 1 for j in range(1, k + 1)]
    out = [(False, 0, tag) for tag in cuts(max(1, round(n * nulls / got["rows"])))] if nulls else []
    for i, k in sorted(Counter(got["q"] or []).items()):
        out += [(True, int(i), tag) for tag in cuts(k)]
    return out


def _rank(key: Column, bounds: list[tuple[bool, int, int]]) -> Column:
    """How many bounds are less than a key, by binary search in one literal array."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*(F.struct(F.lit(t).alias("there"), F.lit(i).cast("long").alias("id"), F.lit(g).cast("long").alias("tag")) for t, i, g in bounds))
    halves = F.array(*(F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))))

    def step(at: Column, size: Column) -> Column:
        return F.when((at + size <= len(bounds)) & (F.get(cuts, at + size - 1) < key), at + size).otherwise(at)

    return F.aggregate(halves, F.lit(0), step)


def with_followers(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, part, guest) of which each part, in order, ends with a guest row.

    Parts are ranges of (doc_id, hash of the text); the guest is a copy of the first row of the
    next part, so a part's rows find their followers without any other part. Only the range
    bounds, at most MOST_PARTS, pass through the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(MOST_PARTS, max(1, total_bytes(docs, "text") // RANGE_BYTES))
    bounds = _bounds(docs, n)
    key = F.struct(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tag"))
    keyed = docs.withColumn("key", key).withColumn("part", let(F.col("key"), lambda k: _rank(k, bounds)))
    firsts = keyed.groupBy("part").agg(F.min("key").alias("key"))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    goes = firsts.select("key", before.alias("to"))  # a row a part
    guests = keyed.drop("part").join(F.broadcast(goes), "key").select("doc_id", "text", F.col("to").alias("part"), "key").dropDuplicates(["part"])
    all_ = keyed.select("doc_id", "text", "part", "key", F.lit(0).alias("guest")).union(guests.select("doc_id", "text", "part", "key", F.lit(1).alias("guest")))
    return all_.repartition(n, "part").sortWithinPartitions("part", "guest", "key").select("doc_id", "text", "part", "guest")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how far each text is contained in its edited form and its follower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        before, own_part = None, None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, part, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest")), strict=True):
                prints = fingerprint(text)
                if before is not None and part == own_part:
                    i, t, p = before
                    k = len(t) // 4
                    edited = t[: len(t) - k] + text[:k]
                    e = fingerprint(edited) if edited != t else p
                    for c, v in zip(out, (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), serialize(p), serialize(e), containment(p, e), containment(p, prints)), strict=True):
                        c.append(v)
                before, own_part = None if guest else (doc_id, text, prints), part
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return with_followers(docs).mapInArrow(run, SCHEMA)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
