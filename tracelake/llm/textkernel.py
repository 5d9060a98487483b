"""Vectorised text work for Arrow batches: words, word hashes, safe token cuts.

A batch's texts stay one byte buffer with row offsets; everything here is numpy over that buffer,
in slices of about SLICE bytes so that memory stays bounded whatever a batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
U64 = np.uint64
_BASE = 0xD6E8FEB86659FD93
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(_GOLDEN) + U64(seed))


_VALUES = _table(7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE + SLICE // 2) + 1, base, dtype=U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) for runs of whole rows of about limit bytes."""
    offsets, data = flat(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end)."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


@dataclass
class Words:
    """All words of a slice, in order: byte ranges, row of each, hash of each, words a row."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> Words:
    """The words [^\\x20\\x09-\\x0D]+ of each row; lower: with A-Z hashed as a-z."""
    n = len(data)
    solid = ~_BLANK[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return Words(starts, ends, row, range_hashes(_LOWER[data] if lower else data, starts, ends), np.bincount(row, minlength=len(offsets) - 1))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of size consecutive words of one row."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    at = np.flatnonzero(w.row[:n] == w.row[size - 1 :])
    total = np.zeros(n, dtype=U64)
    for k in range(size):
        total = total * U64(_GOLDEN) + w.hash[k : k + n]
    return at, mix(total[at])


#: Bytes that end or begin a character that no Unicode definition counts as a blank.
_GRAPH = np.zeros(256, dtype=bool)
_GRAPH[0x21:0x7F] = True


#: Classes of bytes that are certain: 1 letters, 2 digits, 3 other printed signs. U+00C0 to U+027F are letters but for two signs.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0xC3:0xCA] = 1


def _class_changes(data: np.ndarray) -> np.ndarray:
    """Where letters, digits and other signs meet; an apostrophe may belong to the letters after it."""
    kind = _CLASS[data]
    before, here = data[:-1], data[1:]
    kind[1:][((here & 0xC0) == 0x80) & (before >= 0xC3) & (before <= 0xC9)] = 1
    sign = np.flatnonzero((before == 0xC3) & ((here == 0x97) | (here == 0xB7)))
    kind[sign] = kind[sign + 1] = 0
    change = np.zeros(len(data), dtype=bool)
    change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~((before == 39) & (kind[1:] == 1))
    return change


def cuts(offsets: np.ndarray, data: np.ndarray, fine: bool = False) -> np.ndarray:
    """Byte positions, row starts included, where the pre-token pattern always has a boundary.

    A match never runs from a non-blank into a blank, and a lone blank other than a space stands
    alone between non-blanks; nor does a match look behind. So what stands between two cuts is encoded alike
    alone and in its text. Characters whose class isn't certain from their bytes get no cut.
    fine: also where letters, digits and other signs meet, so that there are fewer distinct segments.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    blank, tail = _BLANK[data], _GRAPH[data].copy()
    more = (data & 0xC0) == 0x80  # continuation bytes
    tail[1:] |= more[1:] & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)  # U+00C0 to U+07FF
    tail[2:] |= more[2:] & more[1:-1] & (data[:-2] >= 0xE4) & (data[:-2] <= 0xEF)  # U+4000 to U+FFFF
    head = _GRAPH[data] | ((data >= 0xC3) & (data <= 0xDF)) | ((data >= 0xE4) & (data <= 0xEF))
    cut = _class_changes(data) if fine else np.zeros(n, dtype=bool)
    cut[1:] |= tail[:-1] & blank[1:]
    cut[2:] |= tail[:-2] & blank[1:-1] & (data[1:-1] != 32) & head[2:]
    first = offsets[:-1]
    cut[first[first < n]] = True
    return np.flatnonzero(cut)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, lengthened by doubling to n elements at least."""
    while len(x) < n:
        x = np.concatenate([x, np.zeros_like(x)])
    return x


class TokenCache:
    """Ids of distinct segments, in one flat array; bounded, and emptied when full.

    encode: from a list of segments (bytes) to (all their ids, number of ids of each).
    whole: texts that no cut may divide; where given, cuts are fine in slices without such texts.
    Segments are found by 64-bit hash, all of a slice at once, and compared with the bytes kept.
    """

    def __init__(self, encode, most: int = 1_200_000, whole: list[bytes] | None = None):
        self.encode, self.most, self.whole = encode, most, whole
        self.clear()

    def clear(self) -> None:
        self.starts, self.sizes, self.used = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64), 0
        self.flat, self.filled = np.zeros(8192, dtype=np.uint32), 0
        self.bytes, self.places, self.written = np.zeros(8192, dtype=np.uint8), np.zeros(1024, dtype=np.int64), 0
        self.keys, self.numbers, self.entered = np.zeros(1 << 16, dtype=U64), np.zeros(1 << 16, dtype=np.int32), 0

    def _add(self, new: list[bytes]) -> np.ndarray:
        """Encodes and keeps segments; their numbers."""
        ids, sizes = self.encode(new)
        n, raw = self.used + len(new), np.frombuffer(b"".join(new), dtype=np.uint8)
        self.starts, self.sizes, self.places = (_room(x, n + 1) for x in (self.starts, self.sizes, self.places))
        self.flat, self.bytes = _room(self.flat, self.filled + len(ids)), _room(self.bytes, self.written + len(raw))
        to = slice(self.used, n)
        self.starts[to], self.sizes[to] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.places[self.used + 1 : n + 1] = self.written + np.cumsum(np.fromiter(map(len, new), dtype=np.int64, count=len(new)))
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.bytes[self.written : self.written + len(raw)] = raw
        self.used, self.filled, self.written = n, self.filled + len(ids), self.written + len(raw)
        return np.arange(to.start, n)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number under each key, or -1: open addressing, a step of all keys at a time."""
        mask = U64(len(self.keys) - 1)
        found, todo, slot = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), keys & mask
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            found[todo[hit]] = self.numbers[slot[hit]]
            go = ~hit & (there != 0)
            todo, keys, slot = todo[go], keys[go], (slot[go] + U64(1)) & mask
        return found

    def _enter(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Puts distinct keys that aren't there."""
        if 2 * (self.entered + len(keys)) > len(self.keys):
            held = self.keys != 0
            keys, numbers = np.concatenate([self.keys[held], keys]), np.concatenate([self.numbers[held], numbers])
            size = 1 << (4 * len(keys) - 1).bit_length()
            self.keys, self.numbers, self.entered = np.zeros(size, dtype=U64), np.zeros(size, dtype=np.int32), 0
        self.entered += len(keys)
        mask = U64(len(self.keys) - 1)
        slot = keys & mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.numbers[slot[won]] = numbers[won]
            keys, numbers, slot = keys[~won], numbers[~won], (slot[~won] + U64(1)) & mask

    def segments(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each segment, its row, its number in this cache)."""
        if self.used > self.most or self.filled > 8 * self.most or self.written > 32 * self.most:
            self.clear()
        raw = data.tobytes()
        starts = cuts(offsets, data, self.whole is not None and not any(x in raw for x in self.whole))
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys = np.maximum(range_hashes(data, starts, ends), U64(1))
        number = self._find(keys)
        if len(new := np.flatnonzero(number < 0)):
            distinct, first = np.unique(keys[new], return_index=True)
            at = new[first]
            self._enter(distinct, self._add([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            number[new] = self._find(keys[new])
        if len(other := self._differing(number, starts, ends, data)):  # of one hash, not of the same bytes
            parts = [raw[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)]
            distinct = list(dict.fromkeys(parts))
            own = dict(zip(distinct, self._add(distinct).tolist(), strict=True))
            number[other] = [own[x] for x in parts]
        return starts, np.searchsorted(offsets, starts, side="right") - 1, number

    def _differing(self, number: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Segments whose bytes aren't those kept under their number."""
        size, place = ends - starts, self.places[number]
        wrong = self.places[number + 1] - place != size
        place[wrong] = 0
        if wrong.any():
            size = np.where(wrong, 0, size)
            at = np.flatnonzero(np.repeat(~wrong, ends - starts))
        else:
            at = slice(None)
        source = np.repeat(place - (np.cumsum(size) - size), size)
        source += np.arange(len(source))
        bad = np.flatnonzero(self.bytes[source] != data[at])
        if len(bad):
            wrong[np.searchsorted(np.cumsum(size), bad, side="right")] = True
        return np.flatnonzero(wrong)

    def ids(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, row offsets into them)."""
        _, row, number = self.segments(offsets, data)
        size = self.sizes[number]
        total = int(size.sum())
        shift = self.starts[number] - (np.cumsum(size) - size)
        out = self.flat[np.repeat(shift, size) + np.arange(total)]
        counts = np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(counts)])
