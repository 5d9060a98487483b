"""Periodic runs of words, by partition refinement.

Two positions of a document are in one class of length k if the same k words start there. Classes
of length 1 are the words; a class of length k + 1 is a part of one of length k whose members'
right neighbours are in one class. Each step takes only the parts that have split off, all but the
largest of each class (the smaller halves), and moves the positions before them; so a position
moves at most log2(n) times, and n words cost O(n log n) moves.

Members of a class are chained in text order. Where a member's next one is k places further at
length k, the k words there follow themselves: a square, whose root is no power of a shorter one,
since else a nearer member stood between. Gaps that change are noted under their width, so that
length k looks at the gaps of k alone. Starts of squares of one width that follow each other are one
maximal run, with that width as smallest period.

Tasks run these steps for some megabytes of documents at once, as arrays; classes never span
documents, and documents never leave their task: nothing is shuffled.

Defined results: null and blank texts have no words, hence no runs; rows that repeat a doc_id, or
have none, each get their row; an empty table gives none; a document is split once and its words
are compared whole, however long it is; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Least length of a run, in words.
LEAST = 12
#: Text bytes whose documents are refined together.
TOGETHER = 4 << 20


class _Classes:
    """Positions by class: chains in text order, sizes, and gaps noted by width."""

    def __init__(self, symbols: np.ndarray, half: np.ndarray):
        n = len(symbols)
        self.half = half  # the widest square that fits in the position's document
        _, self.of = np.unique(symbols, return_inverse=True)
        self.used = int(self.of.max()) + 1 if n else 0
        self.size = np.zeros(2 * n + 64, dtype=np.int64)
        self.size[: self.used] = np.bincount(self.of, minlength=self.used)
        self.head = np.full(2 * n + 64, -1, dtype=np.int64)
        self.next, self.back = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)  # the last takes what is written at -1
        self.slot = np.zeros(2 * n + 64, dtype=np.int64)
        self.wide: dict[int, list[np.ndarray]] = {}
        self.few: dict[int, list[int]] = {}
        order = np.argsort(self.of, kind="stable")
        self._chain(order, self.of[order], 1)

    def _chain(self, members: np.ndarray, of: np.ndarray, least: int) -> None:
        """Chains members, sorted by class and position, anew."""
        if not len(members):
            return
        same = of[1:] == of[:-1]
        a, b = members[:-1], members[1:]
        self.next[members], self.back[members] = -1, -1
        self.next[a[same]], self.back[b[same]] = b[same], a[same]
        first = np.append(True, ~same)
        self.head[of[first]] = members[first]
        self._note(a[same], least)

    def _note(self, at: np.ndarray, least: int) -> None:
        """Notes the gaps behind these positions, if a square of that width can still come."""
        gap = self.next[at] - at
        fits = (gap >= least) & (gap <= self.half[at])
        at, gap = at[fits], gap[fits]
        if len(at) < 48:
            for width, one in zip(gap.tolist(), at.tolist(), strict=True):
                self.few.setdefault(width, []).append(one)
            return
        order = np.argsort(gap, kind="stable")
        at, gap = at[order], gap[order]
        edges = np.flatnonzero(np.diff(gap, prepend=-1))
        for width, part in zip(gap[edges].tolist(), np.split(at, edges[1:]), strict=True):
            self.wide.setdefault(width, []).append(part)

    def squares(self, k: int) -> np.ndarray:
        """Positions whose next class member is k places further, in order."""
        noted, few = self.wide.pop(k, []), self.few.pop(k, None)
        if few:
            noted.append(np.array(few, dtype=np.int64))
        if not noted:
            return np.zeros(0, dtype=np.int64)
        at = np.unique(np.concatenate(noted))
        return at[self.next[at] == at + k]

    def _unchain(self, moved: np.ndarray, of: np.ndarray, least: int) -> None:
        """Takes members, sorted by class and position, out of chains that go on without them."""
        cut = self.next[moved[:-1]] != moved[1:]  # between two stretches of neighbours
        left, right = self.back[moved[np.append(True, cut)]], self.next[moved[np.append(cut, True)]]
        opens = left < 0
        self.head[of[np.append(True, cut)][opens]] = right[opens]
        self.next[left[~opens]] = right[~opens]
        ends = right >= 0
        self.back[right[ends]] = left[ends]
        self._note(left[~opens & ends], least)

    def _members(self, classes: list[int]) -> np.ndarray:
        out, step = [], self.next
        for c in classes:
            at = int(self.head[c])
            while at >= 0:
                out.append(at)
                at = int(step[at])
        return np.array(out, dtype=np.int64)

    def refine(self, small: np.ndarray, k: int) -> np.ndarray:
        """From classes of length k to k + 1; small: the parts that split off last, returned anew."""
        at = small - 1
        at = at[at >= 0]
        at = at[(self.size[self.of[at]] > 1) & (self.half[at] > k)]
        if not len(at):
            return at
        of = self.of[at]
        one = np.arange(len(at))
        self.slot[of] = one
        if (self.slot[of] == one).all():
            return self._part(at, of, k + 1)
        at = np.sort(at)
        key = self.of[at] * self.used + self.of[at + 1]
        order = np.argsort(key, kind="stable")
        key, parts = key[order], at[order]
        edge = np.append(True, key[1:] != key[:-1])  # a part is what moves from one class before one class
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(parts)))
        old = self.of[parts[first]]
        lead = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        each = np.diff(np.append(lead, len(old)))  # parts of each class
        rest = self.size[old[lead]] - np.add.reduceat(count, lead)
        most = np.maximum.reduceat(count, lead)
        splits = (rest > 0) | (each > 1)
        # the parts of classes that split; a class whose members all move alike stays as it is
        wanted = np.repeat(splits, each)
        if not wanted.any():
            return np.zeros(0, dtype=np.int64)
        lead_of = np.repeat(np.arange(len(lead)), each)
        largest = np.zeros(len(count), dtype=bool)
        largest[np.lexsort((-count, lead_of))[lead]] = True  # one part of each class
        new = np.cumsum(wanted) - 1 + self.used
        inside = np.repeat(wanted, count)
        moved, fresh = parts[inside], np.repeat(new, count)[inside]
        goes_on = np.repeat(np.repeat(splits & (rest > 0), each), count)
        if goes_on.any():
            chained = np.sort(parts[goes_on])
            of = self.of[chained]
            by = np.argsort(of, kind="stable")
            self._unchain(chained[by], of[by], k + 1)
        self.size[old[lead][splits]] = rest[splits]
        self._grow(int(wanted.sum()))
        self.size[new[wanted]] = count[wanted]
        self.of[moved] = fresh
        self._chain(moved, fresh, k + 1)
        # the smaller halves: all parts but the largest, and the rest where a part is larger
        leave = largest & np.repeat(rest < most, each)
        out = parts[np.repeat(wanted & ~leave, count)]
        less = splits & (rest > 0) & (rest < most)
        if less.any():
            out = np.concatenate([out, self._members(old[lead][less].tolist())])
        return out

    def _part(self, at: np.ndarray, of: np.ndarray, least: int) -> np.ndarray:
        """One member of each class leaves it: what most steps over long periods come to."""
        left, right = self.back[at], self.next[at]
        self.next[left], self.back[right] = right, left
        self.head[of] = np.where(left < 0, right, self.head[of])
        self.next[at], self.back[at] = -1, -1
        self._note(left[(left >= 0) & (right >= 0)], least)
        self.size[of] -= 1
        new = self.used + np.arange(len(at))
        self._grow(len(at))
        self.size[new], self.of[at] = 1, new
        return at

    def _grow(self, n: int) -> None:
        self.used += n
        if self.used > len(self.size):
            self.size = np.concatenate([self.size, np.zeros(self.used, dtype=np.int64)])
            self.head = np.concatenate([self.head, np.full(self.used, -1, dtype=np.int64)])
            self.slot = np.zeros(len(self.size), dtype=np.int64)


def runs_of(symbols: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, in this order.

    symbols: a number for each word, documents one after the other; lengths: words of each.
    """
    docs = len(lengths)
    begins = np.cumsum(lengths + 1) - lengths - 1  # behind each document stands a mark of its own
    row = np.repeat(np.arange(docs), lengths)
    place = np.arange(len(symbols)) + row
    total = len(symbols) + docs
    key, half = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
    kinds = int(symbols.max()) + 1 if len(symbols) else 1
    key[place] = row * kinds + symbols
    key[begins + lengths] = docs * kinds + np.arange(docs)
    half[place] = (lengths // 2)[row]
    classes = _Classes(key, half)
    found, small, k = [], np.arange(total), 1
    while len(small):
        if len(at := classes.squares(k)):
            found.append((np.full(len(at), k), at))
        small = classes.refine(small, k)
        k += 1
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    period, at = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.flatnonzero(np.append(True, (np.diff(period) != 0) | (np.diff(at) != 1)))
    start, period = at[first], period[first]
    length = np.diff(np.append(first, len(at))) - 1 + 2 * period
    long = length >= least
    start, length, period = start[long], length[long], period[long]
    doc = np.searchsorted(begins, start, side="right") - 1
    order = np.lexsort((period, start, doc))
    return doc[order], (start - begins[doc])[order], length[order], period[order]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string, collapsed_text string"
_KINDS = (pa.int64(), pa.int64(), _RUNS, pa.string(), pa.string())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    kept, done = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if a > done:
            kept += words[done:a]
        done = max(done, b)
    return b" ".join(kept + words[done:] if runs else words)


def find(docs: DataFrame, least: int = LEAST, texts: bool = True) -> DataFrame:
    """Per document: words, its runs by start and period, the text with runs collapsed (if texts) and its digest."""

    def together(ids: list, raw: list[bytes]) -> pa.RecordBatch:
        split = [t.split() for t in raw]  # bytes are split at the six ASCII blanks
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        flat = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
        symbols = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
        for d, *run in zip(*(x.tolist() for x in runs_of(symbols, lengths, least)), strict=True):
            runs[d].append(tuple(run))
        kept = [collapse(w, r) for w, r in zip(split, runs, strict=True)]
        columns = (
            ids, lengths.tolist(), [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs],
            [hashlib.sha256(t).hexdigest() for t in kept], [t.decode() for t in kept] if texts else [None] * len(kept),
        )
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=["doc_id", "n_words", "runs", "collapsed_sha256", "collapsed_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
                ids.append(i.as_py())
                raw.append(t.as_py())
                held += len(raw[-1])
                if held >= TOGETHER:
                    yield together(ids, raw)
                    ids, raw, held = [], [], 0
        if ids:
            yield together(ids, raw)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats its words from some word on.

    With h = crc32 of the decimal doc_id, h % 10 = 0 and g = h / 10: word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8). A null doc_id repeats nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % n
        return let(
            F.struct(words.alias("w"), n.alias("n"), a.alias("a"), (F.floor((n - a) / (3 + g % 8)) + 1).alias("p")),
            lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))), " "),
        )

    words = words_of(F.col("text"))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    found = find(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")), texts=False)
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    wide = found.withColumn("best", best)
    return wide.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.short")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256", "n_words",
    )


#: Pairs of equal words at a distance, as islands: one at least as long as its distance is a run, and
#: the least distance over one stretch is its period. DuckDB has no crc32, so that is folded bit by bit.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
    list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT) AS h FROM documents),
m AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AS planted, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, (h // 10) % 8 AS e FROM d),
t AS (SELECT doc_id, n, CASE WHEN planted AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END]) ELSE ws END AS ws FROM m),
w AS (SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM t),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w AS x JOIN w AS y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e) GROUP BY doc_id, q, g HAVING count(*) >= greatest(q, 12 - q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
o AS (SELECT doc_id, count(*) AS n_runs, arg_min([start, length, period], [-length, start, period]) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256, t.n::BIGINT AS n_words
FROM t LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)
"""
