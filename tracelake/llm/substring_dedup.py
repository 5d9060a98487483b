"""Substring dedup by relative Lempel-Ziv parsing.

The reference is every document with a smaller doc_id, indexed by its word windows, in two steps:

* a block is what one task gathers (about FLUSH windows). Of the documents in it that hold a window,
  the least refers to other blocks, and the others to the least's first place for it;
* least documents' windows go to an index over all blocks, dealt by window hash; there each refers
  to the first place of the least document of all. A window sends a row a block, however common.

A document is then parsed greedily: at the first window that refers to a place in the reference, a
factor (start, length, source document, source position) takes all following windows that refer to
the place one further, and parsing goes on behind its last word. A factor has at least the
window's words by construction. At its boundary, windows that cross it are checked too: those
that refer to any place extend the duplicate span. Spans are the factors and those windows.

Only hashes (7 bytes a window) and positions are exchanged, packed by bucket; texts move once, to
meet the places found. Windows are compared by a 64-bit hash.

Defined results: null and blank texts have no words, hence no spans; a row without doc_id neither
gives nor loses spans; rows that repeat a doc_id don't remove each other's words; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import total_bytes
from .hashbuckets import FLUSH, bucket_count, bucket_of, eight, pack, seven, steps, unpack, unsteps
from .textkernel import slices, windows, words

WINDOW = 13
#: Text bytes that one group of documents holds when the places found meet their texts.
GROUP_BYTES = 4 << 20

_PACKED = "kind int, bucket int, blob binary"
_PACKED_KINDS = (pa.int32(), pa.int32(), pa.binary())
#: Rows for the index, and places found for a group of documents.
ASKED, FOUND = 0, 1


def _group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document, as F.crc32 of its doc_id gives it."""
    one, back = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(str(i).encode()) % groups for i in one.tolist()], dtype=np.int64)[back]


def _by_document(keys: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, blob) for each key: documents, rows of each, and the columns; rows are in order of document."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, doc, columns = keys[order], doc[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(keys, prepend=-1))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(keys)).tolist(), strict=True):
        first = np.append(0, np.flatnonzero(np.diff(doc[a:b])) + 1)
        yield int(keys[a]), pack(*steps(doc[a:b][first]), np.diff(np.append(first, b - a)), *(c[a:b] for c in columns))


def _documents(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document of each row, columns) of a blob."""
    first, d, counts, *columns = unpack(blob)
    return np.repeat(unsteps(first, d), counts), columns


def _parted(doc: np.ndarray, at: np.ndarray, h: np.ndarray, groups: int) -> tuple[Iterator[tuple[int, bytes]], tuple[np.ndarray, ...]]:
    """Of windows: places, packed by group, of all but each hash's least document; and that one's rows.

    A place is the document, the position and a check of the hash there, and the document referred
    to with the position in it.
    """
    order = np.lexsort((at, doc, h))
    doc, at, h = doc[order], at[order], h[order]
    new = np.ones(len(h), dtype=bool)  # identical rows are one
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    doc, at, h = doc[new], at[new], h[new]
    edge = np.append(0, np.flatnonzero(np.diff(h)) + 1)
    lead = np.repeat(edge, np.diff(np.append(edge, len(h))))
    least = doc == doc[lead]
    rest = np.flatnonzero(~least)
    rest = rest[np.lexsort((at[rest], doc[rest]))]
    to = lead[rest]
    return _by_document(_group_of(doc[rest], groups), doc[rest], at[rest], _check(h[rest]), doc[to], at[to]), (doc[least], at[least], h[least])


def _check(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64)


def _blocks(docs: DataFrame, window: int, buckets: int, groups: int) -> DataFrame:
    """Packed rows: windows that ask the index (by bucket), and places found in their own block (by group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            places, (doc, at, h) = _parted(*(np.concatenate(x) for x in zip(*held, strict=True)), groups)
            out = [(FOUND, *x) for x in places]
            order = np.lexsort((at, doc))
            doc, at, h = doc[order], at[order], h[order]
            out += [(ASKED, *x) for x in _by_document(bucket_of(h, buckets), doc, seven(h), at)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _PACKED_KINDS, strict=True)], names=["kind", "bucket", "blob"])

        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text")):
                ids = batch.column("doc_id")[a:b].to_numpy(zero_copy_only=False).astype(np.int64)
                w = words(offsets, data)
                first, h = windows(w, window)
                begin = np.concatenate([[0], np.cumsum(w.counts)])
                held.append((ids[w.row[first]], first - begin[w.row[first]], h))
                count += len(h)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _PACKED)


def _answers(blocks: DataFrame, groups: int) -> DataFrame:
    """Places found, packed by group: those of the blocks as they are, and those over all blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() == FOUND:
            return table.select(["bucket", "blob"]).rename_columns(["q", "blob"])
        docs, hashes, ats = [], [], []
        for blob in table.column("blob").to_pylist():
            doc, (h, at) = _documents(blob)
            docs.append(doc)
            hashes.append(eight(h) | np.uint64(key[1].as_py() % 256))
            ats.append(at)
        places, _ = _parted(*map(np.concatenate, (docs, ats, hashes)), groups)
        out = list(places)
        return pa.table([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["q", "blob"])

    return blocks.groupBy("kind", "bucket").applyInArrow(run, "q int, blob binary")


def factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse of a document: (start, length, source document, source position), in words.

    at, source and place are its windows that refer to the reference, in order of position.
    """
    if not len(at):
        return []
    apart = np.flatnonzero((np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(place) != 1)) + 1
    ends = np.append(apart, len(at)).tolist()
    positions, out, i, run = at.tolist(), [], 0, 0
    while i < len(positions):
        while ends[run] <= i:
            run += 1
        length = ends[run] - i - 1 + window
        out.append((positions[i], length, int(source[i]), int(place[i])))
        i = int(np.searchsorted(at, positions[i] + length))
    return out


def spans(parsed: list[tuple[int, int, int, int]], at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Duplicate spans [start, end): factors, and windows found that cross a factor's end."""
    pieces = [(s, s + n) for s, n, _, _ in parsed]
    for _, end in list(pieces):
        last = int(np.searchsorted(at, end)) - 1  # starts inside, so the window crosses the end
        if last >= 0 and at[last] > end - window:
            pieces.append((int(at[last]), int(at[last]) + window))
    out: list[tuple[int, int]] = []
    for s, e in sorted(pieces):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("position", pa.int64())]))
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>, factors array<struct<start:long,length:long,source:long,position:long>>"
_NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans", "factors")
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _SPANS, _FACTORS)


def dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per document: words, removed words, digest of the kept text, the kept text (if texts), spans, factors."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = total_bytes(docs, "text")
    n, groups = bucket_count(size / 6), max(8, size // GROUP_BYTES)
    found = _answers(_blocks(docs.where("doc_id is not null"), window, n, groups), groups)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held: dict[int, list] = {}
        for blob in right.column("blob").to_pylist():
            first, d, counts, *places = unpack(blob)
            ends = np.cumsum(counts)
            for i, a, b in zip(unsteps(first, d).tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                held.setdefault(i, []).append(tuple(c[a:b] for c in places))
        columns: list[list] = [[] for _ in _NAMES]
        ids = left.column("doc_id").to_pylist()
        repeated = {i for i, n in Counter(ids).items() if n > 1 and i is not None}
        for first, end, offsets, data in slices(left.column("text")):
            w, raw = words(offsets, data), data.tobytes()
            counts = w.counts
            if repeated.intersection(ids[first:end]):
                begins, hashes = windows(w, window)
                bounds = np.searchsorted(w.row[begins], np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                text, n_words = raw[offsets[r] : offsets[r + 1]], int(counts[r])
                own = held.get(ids[first + r])
                parsed, gone = [], []
                if own:
                    at, check, source, place = (np.concatenate(x) for x in zip(*own, strict=True))
                    if ids[first + r] in repeated:  # places of all rows of that id: this row's have its hashes
                        here = _check(hashes[bounds[r] : bounds[r + 1]])
                        mine = np.flatnonzero(at < len(here))
                        mine = mine[here[at[mine]] == check[mine]]
                        at, source, place = at[mine], source[mine], place[mine]
                    at, keep = np.unique(at, return_index=True)
                    parsed = factors(at, source[keep], place[keep], window)
                    gone = spans(parsed, at, window)
                parts, done = text.split(), 0
                if gone:
                    kept = []
                    for s, e in gone:
                        kept += parts[done:s]
                        done = e
                    parts = kept + parts[done:]
                out = b" ".join(parts)
                row = (ids[first + r], n_words, n_words - len(parts), hashlib.sha256(out).hexdigest(), out if texts else None, [{"start": s, "end": e} for s, e in gone], [dict(zip(("start", "length", "source", "position"), f, strict=True)) for f in parsed])
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
        return pa.table([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=list(_NAMES))

    # rows without doc_id meet nothing; they are dealt by their text
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"))
    group = F.pmod(F.crc32(key.cast("binary")), F.lit(groups)).cast("int")
    return docs.withColumn("q", group).groupBy("q").cogroup(found.groupBy("q")).applyInArrow(run, SCHEMA)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM g) WHERE m < doc_id),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM hit) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM d)
  ANTI JOIN (SELECT doc_id, unnest(js) AS j FROM gone) USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
