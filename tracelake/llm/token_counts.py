"""Edit-aware token counts over pre-token segment trees.

A text is cut where the pre-token pattern always has a boundary; runs of such segments are the
leaves of a tree whose nodes hold characters and tokens below them. An edit (position, characters
deleted, text inserted) finds its leaves from the sums, takes one leaf on either side as boundary
context, encodes that region alone, and updates the sums on the way up. Cuts outside the region
stay cuts, since nothing beside them changed, so the sums equal those of a full encoding.

Defined results: a null text is empty; edits apply in order, each to the text its predecessor
left; a position beyond the end appends, a deletion beyond it stops there; null edits and null
inserts do nothing; repeated rows each get their row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import RANKS, Bpe, loaded
from .textkernel import TokenCache, slices

#: Segments a leaf holds at first.
LEAF_SEGMENTS = 8


class Tree:
    """Sums over a text's leaves; leaf i is node size + i, and node k has children 2k and 2k + 1.

    Leaf i is the bytes bounds[i] to bounds[i + 1] of the text until an edit replaces it.
    """

    __slots__ = ("bounds", "bpe", "changed", "chars", "encoded", "raw", "size", "tokens")

    def __init__(self, raw: bytes, bounds: list[int], chars: np.ndarray, tokens: np.ndarray, bpe: Bpe):
        self.raw, self.bounds, self.bpe, self.encoded = raw, bounds, bpe, 0
        self.changed: dict[int, str] = {}
        self.size = 1 << max(0, (len(chars) - 1)).bit_length()
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)

    def _sums(self, leaves: np.ndarray) -> list[int]:
        level = np.zeros(self.size, dtype=np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        return np.concatenate([[0], *reversed(levels)]).tolist()

    def leaf(self, i: int) -> str:
        if i in self.changed:
            return self.changed[i]
        return self.raw[self.bounds[i] : self.bounds[i + 1]].decode() if i + 1 < len(self.bounds) else ""

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _leaf(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if position >= before + self.chars[k]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def _set(self, i: int, text: str, tokens: int) -> None:
        self.changed[i] = text
        k = i + self.size
        self.chars[k], self.tokens[k] = len(text), tokens
        while k := k // 2:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, position: int, delete: int, insert: str) -> None:
        n = self.n_chars
        position = min(max(0, position), n)
        delete = min(max(0, delete), n - position)
        first, before = self._leaf(min(position, max(0, n - 1))) if n else (0, 0)
        last, last_before = self._leaf(min(position + max(delete, 1) - 1, n - 1)) if n else (0, 0)
        # a leaf on either side is boundary context; a cut depends on two characters before it
        if before:
            first, before = self._leaf(before - 1)
        end, more = last_before + self.chars[last + self.size], True
        while end < n and (more or end < position + delete + 2):
            last, last_before = self._leaf(end)
            end, more = last_before + self.chars[last + self.size], False
        region = "".join(self.leaf(i) for i in range(first, last + 1))
        at = position - before
        region = region[:at] + insert + region[at + delete :]
        self.encoded += len(region)
        for i in range(first, last + 1):
            if i == first:
                self._set(i, region, self.bpe.count(region))
            elif self.chars[i + self.size]:
                self._set(i, "", 0)

    def text(self) -> str:
        parts, at = [], 0
        for i in sorted(self.changed):
            b = self.bounds[min(i, len(self.bounds) - 1)]
            parts += [self.raw[at:b], self.changed[i].encode()]
            at = max(at, self.bounds[min(i + 1, len(self.bounds) - 1)])
        return b"".join([*parts, self.raw[at:]]).decode()


def trees(column: pa.Array, bpe: Bpe, cache: TokenCache, leaf: int = LEAF_SEGMENTS) -> Iterator[tuple[int, Tree]]:
    """(row, tree) of every text of a batch, from one vectorised pass."""
    for first, _, offsets, data in slices(column):
        starts, row, number = cache.segments(offsets, data)
        tokens, chars = cache.sizes[number], np.cumsum(np.append(0, (data & 0xC0) != 0x80))
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        raw = data.tobytes()
        for r in range(len(offsets) - 1):
            a, b = int(bounds[r]), int(bounds[r + 1])
            heads = np.arange(a, b, leaf)
            at = np.append(starts[heads], offsets[r + 1])
            sums = np.add.reduceat(tokens[a:b], heads - a) if b > a else heads
            yield first + r, Tree(raw[offsets[r] : offsets[r + 1]], (at - offsets[r]).tolist(), np.diff(chars[at]), sums, bpe)


EDIT = "struct<position:long,delete:long,insert:string>"
SCHEMA = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long, edited_sha256 string"


def counts(docs: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """Token counts before and after each document's edits (an array of EDIT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = loaded(path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            ids, todo = batch.column("doc_id").to_pylist(), batch.column(edits).to_pylist()
            out: list[list] = [[] for _ in names]
            for row, tree in trees(batch.column("text"), bpe, cache):
                n = tree.n_tokens
                for e in todo[row] or ():
                    if e is not None:
                        tree.edit(e["position"] or 0, e["delete"] or 0, e["insert"] or "")
                digest = hashlib.sha256(tree.text().encode()).hexdigest()
                for c, v in zip(out, (ids[row], n, tree.n_tokens, tree.n_chars, tree.encoded, digest), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "edited_sha256" else pa.int64()) for c, k in zip(out, names, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", edits).mapInArrow(run, SCHEMA)


def with_edits(docs: DataFrame) -> DataFrame:
    """Documents with the query's three edits: a replacement, an insertion, a deletion."""
    n = F.length(F.coalesce("text", F.lit("")))
    one = lambda at, cut, put: F.struct(F.floor(at).cast("long").alias("position"), F.lit(cut).cast("long").alias("delete"), F.lit(put).alias("insert"))
    return docs.select("doc_id", "text", F.array(one(n / 2, 10, " revised"), one(n / 3, 0, "'s note\n\n"), one(2 * n / 3, 7, "")).alias("edits"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents, counted, edited three times, and counted again from the touched regions."""
    return counts(with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path(RANKS))
