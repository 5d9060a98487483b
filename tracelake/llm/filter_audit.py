"""What each filter of a chain removes, in every order of the filters.

A document's failures are bits of a mask: A to D from its own text, E if a smaller doc_id has the
same text. Whole texts are compared, routed by fingerprint:

* A map task measures a text, and keeps it in the chain of its xxhash: rows of one text share an
  entry with the least doc_id, and ids that aren't least are emitted at once, without their text.
  So a task sends a text once (and again after HELD bytes), however many copies it reads.
* Entries are partitioned by xxhash; there the same chains tell texts of one hash apart, and emit
  the ids that turn out not to be least; the least ids follow at the end of a partition.
* Masks meet the labels by doc_id, without texts. combineByKey then merges a vector of counts for each
  part (32 masks, good and toxic), and every order is read off that vector.

Partitions grow with the text bytes, so that one holds about PER_PARTITION of distinct texts.

Defined results: a null text is empty (so it fails A alone, and E if not the first), a null source is
the part of the empty string; a row without doc_id never fails E and makes none fail; rows that repeat
doc_id and text are counted each and don't fail E for each other; a document is good (toxic) if
any of its label rows says so, and labels without a document count nowhere; an empty table has no
part; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import total_bytes

#: Bit i of a mask is the i-th filter.
FILTERS = "ABCDE"
SAME = 1 << FILTERS.index("E")
#: Text bytes that a map task's chains hold, and that a partition should hold.
HELD, PER_PARTITION = 64 << 20, 32 << 20
#: Bytes of a text that are split at once.
PIECE = 1 << 20

_BLANK, _SIGN, _NOT_CAPITAL = re.compile(rb"[\x09-\x0D\x20]"), re.compile(rb"[#$%&*|]"), bytes(x for x in range(256) if not 65 <= x <= 90)
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(raw: bytes, n_chars: int) -> int:
    """Bits A to D of a text: under 200 words, few distinct ones, many capitals, a sign."""
    words, distinct, start = 0, set(), 0
    while start < len(raw):
        cut = _BLANK.search(raw, start + PIECE)
        end = cut.start() if cut else len(raw)
        some = raw[start:end].split()  # bytes are split at the six ASCII blanks
        words += len(some)
        distinct.update(some)
        start = end
    capitals = len(raw.translate(None, _NOT_CAPITAL))
    tests = (words < 200, 100 * len(distinct) < 50 * words, 100 * capitals > 2 * n_chars, _SIGN.search(raw) is not None)
    return sum(1 << i for i, failed in enumerate(tests) if failed)


class Chains:
    """By hash, the texts that have it: each with its least doc_id and the rows that have that id."""

    def __init__(self):
        self.by: dict[int, list[list]] = {}
        self.held = 0

    def add(self, h: int, raw: bytes, doc_id: int, mask: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes rows of a text; yields those known to have a smaller one."""
        chain = self.by.setdefault(h, [])
        for entry in chain:
            if entry[0] != raw:
                continue
            if doc_id == entry[1]:
                for part, n in parts.items():
                    entry[3][part] = entry[3].get(part, 0) + n
                return
            if doc_id < entry[1]:
                doc_id, parts, entry[1], entry[3] = entry[1], entry[3], doc_id, parts
            yield from ((doc_id, part, mask | SAME, n) for part, n in parts.items())
            return
        chain.append([raw, doc_id, mask, parts])
        self.held += len(raw)

    def drain(self) -> Iterator[tuple[int, list]]:
        by, self.by, self.held = self.by, {}, 0
        return ((h, entry) for h, chain in by.items() for entry in chain)


def _routed(rows: Iterator) -> Iterator[tuple[int, tuple]]:
    """A map task: (hash, text's entry), and rows that are settled already, dealt by their id."""
    chains = Chains()
    settled = lambda row: (xxhash.xxh64_intdigest(str(row[0])), (None, *row))
    for doc_id, part, text in rows:
        raw = text.encode()
        mask = own_failures(raw, len(text))
        if doc_id is None:
            yield xxhash.xxh64_intdigest(raw), (None, None, part, mask, 1)
            continue
        yield from map(settled, chains.add(xxhash.xxh64_intdigest(raw), raw, doc_id, mask, {part: 1}))
        if chains.held >= HELD:
            yield from ((h, tuple(entry)) for h, entry in chains.drain())
    yield from ((h, tuple(entry)) for h, entry in chains.drain())


def _settled(routed: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """A partition of hashes: (doc_id, part, mask, rows)."""
    chains = Chains()
    for h, (raw, *rest) in routed:
        if raw is None:
            yield tuple(rest)
        else:
            yield from chains.add(h, raw, *rest)
    for _, (_, doc_id, mask, parts) in chains.drain():
        yield from ((doc_id, part, mask, n) for part, n in parts.items())


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: n rows of that document with these failures."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(spark.sparkContext.defaultParallelism, total_bytes(rows, "text") // PER_PARTITION)
    settled = rows.rdd.mapPartitions(_routed).partitionBy(n, lambda h: h).mapPartitions(_settled)
    return spark.createDataFrame(settled, "doc_id long, part string, mask int, n long", verifySchema=False)


def orders(counts: np.ndarray) -> list[tuple]:
    """All orders of the filters, from a part's counts: rows [all, good, toxic], a column a mask."""
    masks = np.arange(counts.shape[1])
    kept_of = {0: counts.sum(axis=1)}  # documents that pass a set of filters, by the set
    for gone in range(1, counts.shape[1]):
        kept_of[gone] = counts[:, masks & gone == 0].sum(axis=1)
    out, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        gone = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            removed = kept_of[gone] - kept_of[gone | bit]
            failing = int(counts[0, masks & bit != 0].sum())
            out.append((name, "".join(order), step, int(kept_of[gone | bit][0]), int(removed[0]), failing - int(removed[0]), int(counts[0, bit]), int(removed[1]), int(removed[2])))
            shapley[name] += int(removed[0])
            gone |= bit
    return [(*rest, shapley[name]) for name, *rest in out]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step."""
    spark = docs.sparkSession
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    masks = failure_masks(docs)
    known = masks.where("doc_id is not null").join(said, "doc_id", "left")
    # rows without doc_id have no labels; in the join they would all meet
    rows = known.select("part", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    rows = rows.union(masks.where("doc_id is null").select("part", "mask", "n", F.lit(False), F.lit(False)))

    def one(counts, row):
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    def first(row):
        return one(np.zeros((3, 1 << len(FILTERS)), dtype=np.int64), row)

    counts = rows.rdd.map(lambda r: (r.part, (r.mask, r.n, r.good, r.toxic))).combineByKey(first, one, lambda a, b: a + b, partitionFunc=xxhash.xxh64_intdigest)
    return spark.createDataFrame(counts.flatMap(lambda x: [(x[0], *row) for row in orders(x[1])]), SCHEMA, verifySchema=False)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Contract query: five filters in all orders over all documents, by source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM d),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x AS a JOIN x AS b ON b.bit <> a.bit JOIN x AS c ON c.bit NOT IN (a.bit, b.bit)
  JOIN x AS d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN x AS e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::INT - bits[step] AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step::INT AS step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
