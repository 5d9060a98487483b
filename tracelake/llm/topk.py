"""Exact top-k by inner product: histograms of all scores locate each query's k-th value.

Components become floor(scale * x), so scores are integers. Every pass scores every query against
every vector, in blocks: a slab of vectors stays in its task, and the queries stream by it.

* A histogram pass looks at BITS more bits of the scores. A slab counts the scores that begin with
  a query's bits so far, and sends the counts from the top down to its own k-th (bins below can't hold
  the global one). Added up over slabs, they say which bin holds the k-th score and how many
  are above it; the next pass refines that bin, till no bits are left: that is the k-th value.
* The last pass sends what is above the value, and of those equal to it the smallest ids that can
  still be wanted; a window by score and id ranks them.

So a slab sends at most k rows a query and pass besides ties of one bin, and scores are never stored.
Products are exact: float64 while no sum can reach 2**53 (by the vectors' norms), int64 beyond.

Defined results: rows without vec_id, and vectors that are null, empty, or hold a null, a NaN or an infinity
take no part; vectors of another length than a query's are no candidates of it; rows that repeat a
vec_id are candidates each, in the ranks of their scores, but never of a query of that id; a query row that
is repeated is answered each time; a query with fewer than k candidates gets them all; an empty table
gives no rows; norms of 2**30 or more raise ValueError, as scores might not fit; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the score that a histogram pass looks at.
BITS = 10
#: Most vectors and bytes of a slab, fewest vectors of one, and scores held at once.
SLAB, SLAB_BYTES, LEAST_SLAB, SCORES = 1 << 16, 64 << 20, 2048, 1 << 20

Emit = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray], Iterator[list[np.ndarray]]]


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v, its whole-number components, of the vectors that take part."""
    whole = F.coalesce(F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False))), F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull() & whole & (F.size("embedding") > 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scored(slabs: DataFrame, queries: DataFrame, parts: int, kind: type, emit: Emit, schema: str) -> DataFrame:
    """Each slab's rows of emit(ids, scores, queries' columns, own) for blocks of queries.

    slabs: slab, vec_id, v. queries: qn, query_id, v, prefix, want; each is sent to every slab. scores
    has a row a query and a column a vector, by vec_id; own marks the query itself.
    """
    c = slabs.select("slab", F.lit(0).alias("role"), F.size("v").alias("dim"), F.lit(0).cast("long").alias("qn"), F.col("vec_id").alias("id"), *(F.lit(0).cast("long").alias(x) for x in ("prefix", "want")), "v")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slab"), F.lit(1).alias("role"), F.size("v").alias("dim"), "qn", F.col("query_id").alias("id"), "prefix", "want", "v")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, waiting, held = None, {}, {}
        for batch in batches:
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("slab", "role", "dim", "qn", "id", "prefix", "want")}
            edges = np.flatnonzero(np.append(True, np.any([np.diff(x[n]) != 0 for n in ("slab", "role", "dim")], axis=0)))
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(x["slab"])).tolist(), strict=True):
                if x["slab"][a] != slab:
                    slab, waiting, held = x["slab"][a], {}, {}
                dim = int(x["dim"][a])
                m = _matrix(batch.column("v").slice(a, b - a), dim)
                if x["role"][a] == 0:
                    waiting.setdefault(dim, []).append((x["id"][a:b], m))
                    continue
                if dim in waiting:
                    ids, rows = (np.concatenate(y) for y in zip(*waiting.pop(dim), strict=True))
                    order = np.argsort(ids, kind="stable")
                    held[dim] = ids[order], np.ascontiguousarray(rows[order].T.astype(kind))
                if dim not in held:
                    continue
                ids, columns = held[dim]
                step = max(1, SCORES // len(ids))
                for s in range(a, b, step):
                    e = min(b, s + step)
                    scores = (m[s - a : e - a].astype(kind) @ columns).astype(np.int64)
                    some = {n: y[s:e] for n, y in x.items()}
                    for out in emit(ids, scores, some, ids[None, :] == some["id"][:, None]):
                        if len(out[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in out], names=names)

    return c.union(q).repartitionById(parts, F.col("slab")).sortWithinPartitions("slab", "role", "dim").mapInArrow(run, schema)


def _histogram(offset: int, shift: int, bits: int) -> Emit:
    """Counts by the next bits of the scores that begin with a query's prefix, from the top to the k-th."""

    def emit(ids, scores, q, own):
        u = (scores + offset) >> shift
        inside = (u >> bits == q["prefix"][:, None]) & ~own
        at = np.flatnonzero(inside)
        row, u = at // len(ids), u.ravel()[at] & ((1 << bits) - 1)
        counts = np.bincount((row << bits) + u, minlength=len(scores) << bits).reshape(len(scores), -1)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        i, bin_ = np.nonzero((counts > 0) & (above < q["want"][:, None]))
        yield [q["qn"][i], q["prefix"][i], q["want"][i], bin_, counts[i, bin_]]

    return emit


def _reached(offset: int) -> Emit:
    """What is above a query's k-th value, and the smallest ids that equal it."""

    def emit(ids, scores, q, own):
        value = (q["prefix"] - offset)[:, None]
        tie = (scores == value) & ~own
        i, c = np.nonzero((scores > value) & ~own | tie & (np.cumsum(tie, axis=1) <= q["want"][:, None]))
        yield [q["qn"][i], q["id"][i], ids[c], scores[i, c]]

    return emit


def _located(counts: DataFrame, bits: int) -> DataFrame:
    """qn, prefix, want: the bin that holds the k-th score (or the last, if there are fewer), and what is wanted of it."""
    summed = counts.groupBy("qn", "prefix", "want", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("qn")
    upto = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = summed.select("qn", "prefix", "bin", "n", F.sum("n").over(upto).alias("upto"), F.least("want", F.sum("n").over(whole)).alias("want"))
    return run.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).select("qn", (F.col("prefix") * (1 << bits) + F.col("bin")).alias("prefix"), (F.col("want") - F.col("upto") + F.col("n")).alias("want"))


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores over the vectors, ties to the smaller vec_id.

    Both tables have vec_id and embedding.
    """
    spark = vectors.sparkSession
    asked, given = quantized(queries, scale), quantized(vectors, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = [df.agg(F.count("*").alias("n"), F.coalesce(F.max(norm), F.lit(0.0)).alias("norm"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first() for df in (asked, given)]
    bound = math.sqrt(size[0].norm) * math.sqrt(size[1].norm) * (1 + 1e-9) + 1  # no sum of products is larger
    if max(size[0].norm, size[1].norm) >= 2.0**60:
        raise ValueError("norms of 2**30 or more: scores might not fit 64 bits")
    each = max(1, min(SLAB, SLAB_BYTES // (8 * size[1].dim)))
    parts = max(1, -(-size[1].n // each), min(-(-size[1].n // LEAST_SLAB), 2 * spark.sparkContext.defaultParallelism))
    # numbers are dealt by row and written, so that every pass sees the same ones
    slabs = materialize(given.withColumn("slab", (F.monotonically_increasing_id() % parts).cast("int")), "slabs")
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("qn"), F.col("vec_id").alias("query_id"), "v"), "queries")
    kind = np.float64 if bound < 2.0**53 else np.int64
    left = bound_bits = math.ceil(math.log2(bound + 1)) + 1
    offset = 1 << (bound_bits - 1)
    found = asked.withColumns({"prefix": F.lit(0).cast("long"), "want": F.lit(k).cast("long")})
    while left:
        bits = min(BITS, left)
        left -= bits
        counts = _scored(slabs, found, parts, kind, _histogram(offset, left, bits), "qn long, prefix long, want long, bin long, n long")
        found = asked.join(materialize(_located(counts, bits), "located"), "qn")
    rows = _scored(slabs, found, parts, kind, _reached(offset), "qn long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk(spark, sf_dir: str) -> DataFrame:
    """Contract query: every fiftieth vector against all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors.where("vec_id % 50 = 0"), vectors, 5, 256)


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
