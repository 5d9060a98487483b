"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the distinct values of the level columns (domain, language, source); a token budget
goes from the root down. At each node the children share the node's budget by weight; a child that
can't use its share (its tokens times the epochs allowed) leaves the rest to its siblings, by
weight again, and only what all of them can't use stays with the ancestor, whose own siblings
take it, since a node's capacity is known before its budget is set. Shares are whole tokens,
rounded down, so less than one token a node is left over.

A leaf takes whole epochs, then the token-prefix of one more in an order seeded by
(seed, epoch, doc_id). The running count behind that prefix is summed by hash range first, so a
hot leaf is spread over all ranges.

Defined results: a null level value and an empty one are the same node; null texts have no tokens
and are taken (with 0 tokens) where their place in the order is before the budget's end; repeated
rows count each; an empty table gives no rows; a leaf of weight 0 gets nothing; other columns of
the input are ignored by ``plan`` and kept by ``select_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_of

#: Documents that one hash range of the seeded order should hold, and salts of a leaf.
RANGE_DOCS, SALTS = 20_000, 32

LEVELS = ("domain", "lang", "source")
#: Weights by level; values that aren't listed weigh 1.
WEIGHTS = ({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {})


def domain_of(source: Column) -> Column:
    """The production rule: four domains by the number that ends a source's name."""
    return F.concat(F.lit("d"), F.coalesce(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")).cast("long") % 4, F.lit(0)).cast("string"))


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
    return out.cast("decimal(38,0)")


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: tuple[dict[str, int], ...], budget: int, max_epochs: int) -> DataFrame:
    """Leaves (levels, avail) with their whole-token budgets."""
    nodes = leaves.select(*levels, "avail", (F.col("avail") * max_epochs).cast("decimal(38,0)").alias("cap")).withColumn("b0", F.lit(budget).cast("decimal(38,0)"))
    for i, level in enumerate(levels):
        up, here = levels[:i], levels[: i + 1]
        family = [f"b{i}", *up]
        kids = nodes.groupBy(*family, level).agg(F.sum("cap").cast("decimal(38,0)").alias("cap")).withColumn("w", _weight(level, weights[i])).where("w > 0")
        # children in the order in which rising shares reach their capacity
        order = Window.partitionBy(*family).orderBy((F.col("cap") / F.col("w")).cast("double"), level)
        kids = kids.select(
            *family, level, "cap", "w",
            F.row_number().over(order).alias("k"),
            (F.col(f"b{i}") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(38,0)").alias("rest"),
            F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)").alias("ws"),
        )
        open_ = (F.col("cap").cast("double") * F.col("ws").cast("double")) > (F.col("w").cast("double") * F.col("rest").cast("double"))
        first = F.min(F.when(open_, F.struct("k", "rest", "ws"))).over(Window.partitionBy(*family))
        share = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("cap")).otherwise(F.floor(F.greatest(F.col("first.rest"), F.lit(0)) * F.col("w") / F.col("first.ws")).cast("decimal(38,0)"))
        kids = kids.withColumn("first", first).select(*family[1:], level, F.least("cap", share).cast("decimal(38,0)").alias(f"b{i + 1}"))
        nodes = nodes.join(kids, list(here))
    return nodes.select(*levels, "avail", F.col(f"b{len(levels)}").cast("long").alias("budget"))


def plan(docs: DataFrame, levels: tuple[str, ...] = LEVELS, weights: tuple[dict[str, int], ...] = WEIGHTS, percent: int = 60, max_epochs: int = 2, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """(doc_id, tag, levels, epoch, n_tokens, n_taken): what is taken of each document, by epoch.

    The budget is percent of all tokens; tokens are words unless another count is given.
    """
    tokens = F.size(words_of(F.col("text"))) if tokens is None else tokens
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in levels), tokens.cast("long").alias("n_tokens"))
    rows = materialize(rows, "mix")
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("avail"), F.count("*").alias("n_docs")), "leaves")
    total = leaves.agg(F.sum("avail"), F.sum("n_docs")).first()
    budget, ranges = int(total[0] or 0) * percent // 100, 1 << max(4, math.ceil(math.log2(max(1, int(total[1] or 0) / RANGE_DOCS))))
    given = budgets(leaves, levels, weights, budget, max_epochs)
    # whole epochs, then what is left for the last one
    given = given.select(*levels, F.when(F.col("avail") > 0, F.expr("budget div avail")).otherwise(0).cast("int").alias("full"), F.when(F.col("avail") > 0, F.col("budget") % F.col("avail")).otherwise(0).cast("long").alias("rest"))
    salted = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*levels, "salt"]).drop("salt")
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("r", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32 * ranges).cast("int"))
    leaf = [*levels, "r"]
    sums = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("here"))
    before = F.sum("here").over(Window.partitionBy(*levels).orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    based = sums.select(*leaf, F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("h", "tag").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(based, leaf)
    placed = placed.withColumn("start", F.col("base") + F.col("inside")).withColumn("last", F.when(F.col("start") < F.col("rest"), F.col("full")).otherwise(F.col("full") - 1))
    taken = placed.where("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    part = F.when(F.col("epoch") < F.col("full"), F.col("n_tokens")).otherwise(F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))
    return taken.select("doc_id", "tag", *levels, F.col("epoch").cast("long"), "n_tokens", part.alias("n_taken"))


def select_documents(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs that a plan takes at least in part."""
    keys = chosen.select(F.col("doc_id").alias("_mix_id"), F.col("tag").alias("_mix_tag"))
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["_mix_id"]) & (F.xxhash64(docs["text"]) == keys["_mix_tag"]), "left_semi")


def with_domain(docs: DataFrame) -> DataFrame:
    """Documents with the production domain; a column of that name is replaced."""
    return docs.drop("domain").withColumn("domain", domain_of(F.col("source")))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, production weights, 60 % of the tokens, at most two epochs."""
    return plan(with_domain(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("tag")


def _level_sql(i: int, columns: tuple[str, ...]) -> str:
    level, up = columns[i], columns[:i]
    part = ", ".join((f"b{i}", *up))
    cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in WEIGHTS[i].items())
    weight = f"CASE {level} {cases} ELSE 1 END" if cases else "1"
    return f"""
k{i} AS (SELECT {part}, {level}, sum(cap)::HUGEINT AS cap, ({weight})::HUGEINT AS w FROM n{i} GROUP BY ALL),
o{i} AS (SELECT *, row_number() OVER x AS k, b{i} - coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM k{i} WINDOW x AS (PARTITION BY {part} ORDER BY cap::DOUBLE / w::DOUBLE, {level})),
f{i} AS (SELECT *, min(CASE WHEN cap * ws > w * rest THEN {{'k': k, 'rest': rest, 'ws': ws}} END) OVER (PARTITION BY {part}) AS first FROM o{i}),
n{i + 1} AS (SELECT n{i}.*, g.b{i + 1} FROM n{i} JOIN (SELECT {", ".join((*up, level))},
  least(cap, CASE WHEN first IS NULL OR k < first.k THEN cap ELSE (greatest(first.rest, 0) * w) // first.ws END)::HUGEINT AS b{i + 1} FROM f{i}) AS g USING ({", ".join((*up, level))}))"""


def _sql(table: str, percent: int, epochs: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, 'd' || coalesce(try_cast(nullif(regexp_extract(source, '[0-9]{{1,9}}$'), '') AS BIGINT) % 4, 0) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {table}),
n0 AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS avail, sum(n_tokens)::HUGEINT * {epochs} AS cap, (SELECT sum(n_tokens)::HUGEINT * {percent} // 100 FROM d) AS b0 FROM d GROUP BY ALL),
{",".join(_level_sql(i, LEVELS) for i in range(3))},
g AS (SELECT domain, lang, source, CASE WHEN avail > 0 THEN (b3 // avail)::BIGINT ELSE 0 END AS f, CASE WHEN avail > 0 THEN (b3 % avail)::BIGINT ELSE 0 END AS rest FROM n3),
p AS (SELECT d.*, g.f, g.rest, (coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || g.f || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM d JOIN g USING (domain, lang, source))
SELECT doc_id, domain, lang, source, epoch, n_tokens, CASE WHEN epoch < f THEN n_tokens ELSE least(n_tokens, rest - start) END AS n_taken
FROM (SELECT *, unnest(range(0, CASE WHEN start < rest THEN f + 1 ELSE f END)) AS epoch FROM p)
"""


OP5_SQL = _sql("documents", 60, 2)
