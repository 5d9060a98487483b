"""Byte-level BPE by monoid tree reduction.

A text is halved until a part has LEAF_CHARS characters or fewer; leaves are encoded alone, and two
encoded neighbours are joined by encoding again a window around the seam, which grows until the
tokens outside it provably stay. Two seams occur:

* between pre-tokens: matching runs left to right without looking behind, and no alternative of the
  pattern looks further than two characters beyond its match, so a pre-token that ends three characters
  before the seam stays; at most three end later, and the last four are matched again. Once a boundary of
  the joined text falls on a boundary of the right part, everything after it stays. A long pre-token that
  the seam cut is joined from the ids of its parts;
* between tokens of one pre-token, which is halved down to LEAF_BYTES bytes: a token sequence is
  the encoding of its bytes if every two neighbours are the encoding of their bytes, so the join
  stops when both ends of the window fit. In a run of one token, bytes that may stand on either side of it
  (as letters of a repeated letter do) are moved behind the run at once, instead of through it.

Distinct short pre-tokens are encoded once a worker. Decoding halves the ids likewise and
concatenates the parts' bytes up the tree.

Defined results: a null or empty text has no ids; repeated rows each get their row; other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textkernel import TokenCache

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of a pre-token, characters of a text, and ids that are a leaf of their tree.
LEAF_BYTES, LEAF_CHARS, LEAF_IDS, STABLE = 16, 512, 256, 4
#: Pre-tokens that are kept, the characters one may have, and parts of long ones that are kept.
MOST_KNOWN, KNOWN_CHARS, MOST_HALVES = 300_000, 64, 4000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Known(dict):
    """Pre-token to its ids, little-endian in 4 bytes each; encodes what it lacks."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= KNOWN_CHARS:
            self[piece] = ids
        return ids


class Bpe:
    """Encodes and decodes with ranks and a pre-token pattern; counts its joins."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {v: k for k, v in ranks.items()}
        self.known = _Known(self.tree)
        self.fits: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.joins = self.text_joins = 0

    # tokens of one pre-token

    def merge(self, data: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until none is left."""
        return self._merge_long(data) if len(data) > 4 * LEAF_BYTES else self._merge_short(data)

    def _merge_short(self, data: bytes) -> list[int]:
        rank_of, none = self.ranks.get, len(self.ranks)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank_of(data[i : i + 2], none) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        n = len(data)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        rank_of = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := rank_of(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := rank_of(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def fit(self, a: int, b: int) -> bool:
        if (got := self.fits.get((a, b))) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            got = self.fits[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int], moving: bool = True) -> list[int]:
        """The encoding of two encoded neighbours."""
        self.joins += 1
        if not left or not right or self.fit(left[-1], right[0]):
            return left + right
        if moving and len(right) > 3 and right[0] == right[3] and (run := self._run(left, right)):
            return run
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            window = self.merge(b"".join(map(self.token.__getitem__, a + b)))
            if (k >= len(left) or self.fit(left[-k - 1], window[0])) and (k >= len(right) or self.fit(window[-1], right[k])):
                return left[: max(0, len(left) - k)] + window + right[k:]
            k *= 2

    def _run(self, left: list[int], right: list[int]) -> list[int] | None:
        """The join where the right part begins with a run of one token that the left part's last ones commute with."""
        m, token = 1, right[0]
        while m < len(right) and right[m] == token:
            m += 1
        unit, j = self.token[token], len(left)
        if m < 4:
            return None
        while j and left[j - 1] != token and (x := self.token[left[j - 1]]) + unit == unit + x:
            j -= 1
        if j == len(left):
            return None
        # the tail's bytes t and the run's r hold t r = r t
        return self.join(self.join(left[:j], right[:m], False), self.join(left[j:], right[m:], False), False)

    def tree(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        if (kept := self.halves.get(data)) is not None:
            return kept
        half = len(data) // 2
        out = self.join(self.tree(data[:half]), self.tree(data[half:]))
        if len(data) <= 4 * LEAF_CHARS:  # parts of a run are alike
            if len(self.halves) > MOST_HALVES:
                self.halves.clear()
            self.halves[data] = out
        return out

    # pre-tokens of a text

    def parts(self, text: str, a: int, b: int) -> tuple[list[str], list[bytes]]:
        """The pre-tokens of text[a:b] and the ids of each."""
        if b - a <= LEAF_CHARS:
            pieces = self.pattern.findall(text, a, b)
            return pieces, list(map(self.known.__getitem__, pieces))
        half = (a + b) // 2
        return self.seam(text, half, b, self.parts(text, a, half), self.parts(text, half, b))

    def seam(self, text: str, at: int, end: int, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """The encoding of two encoded neighbours that meet at a position and end at another."""
        self.text_joins += 1
        pieces, ids = left
        window, held = pieces[-STABLE:], ids[-STABLE:]
        del pieces[-STABLE:], ids[-STABLE:]
        after, i = at, 0  # the right part's boundary that the window has come up to
        for m in self.pattern.finditer(text, at - sum(map(len, window)), end):
            piece, reached, i0 = m[0], m.end(), i
            while after < reached:
                after += len(right[0][i])
                i += 1
            pieces.append(piece)
            ids.append(self.known[piece] if len(piece) <= KNOWN_CHARS else self._cut(piece, at - m.start(), window, held, right, i0, i, after == reached))
            if after == reached:
                break
        pieces += right[0][i:]
        ids += right[1][i:]
        return pieces, ids

    def _cut(self, piece: str, before: int, window: list[str], held: list[bytes], right: tuple[list[str], list[bytes]], i: int, end: int, aligned: bool) -> bytes:
        """The ids of a long piece that begins so many characters before the seam: joined from whole parts' ids, if it has them."""
        j, left = len(window), 0
        while j and left < before:
            j -= 1
            left += len(window[j])
        if not aligned or left != max(before, 0) or not before > 0:
            return self.known[piece]
        out: list[int] = []
        for ids in held[j:] + right[1][i:end]:
            out = self.join(out, np.frombuffer(ids, dtype="<u4").tolist())
        return np.array(out, dtype="<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text, little-endian in 4 bytes each."""
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        return b"".join(self.parts(text, 0, len(text))[1])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def count(self, text: str) -> int:
        return len(self.encode_bytes(text)) // 4

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each segment)."""
        parts = [self.encode_bytes(s.decode()) for s in segments]
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4


@lru_cache(2)
def loaded(path: str) -> tuple[Bpe, TokenCache]:
    """An encoder and its cache, kept by the Python worker from task to task."""
    bpe = Bpe(load_ranks(path))
    return bpe, TokenCache(bpe.encode_segments)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Rows that are turned into texts at once.
ROWS = 256


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(doc_ids, texts) of a few rows at a time; a null text is empty."""
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            yield part.column("doc_id").cast(pa.int64()), [t or "" for t in part.column("text").to_pylist()]


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text, decodes the ids again, and digests both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = loaded(path)
        for doc_ids, texts in _texts(batches):
            ids = [bpe.encode_bytes(t) for t in texts]
            back = [bpe.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string()) for column in (ids, back)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) // 4 for x in ids], pa.int64()), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and the ids of its text, as an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = loaded(path)
        for doc_ids, texts in _texts(batches):
            lists = [np.frombuffer(bpe.encode_bytes(t), dtype="<i4") for t in texts]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", ids])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, `{ids}` array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and the text of an array column of ids; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = loaded(path)
        for batch in batches:
            texts = [bpe.decode(x or []).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", ids).mapInArrow(run, "doc_id long, text string")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS))
