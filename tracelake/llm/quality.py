"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for a document; the ledger keeps its measurements and one failure
bit a rule. Policies are versioned masks over those bits, so another policy, or an ablation, is
bitwise arithmetic on the ledger and never reads a text again.

Defined results: a null text counts as empty (no words, so few_words fails); repeated rows each
get their row; an empty table gives an empty ledger; other columns of the input are ignored, or
kept untouched by ``keep``. Windows within one text are compared by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, let, materialize, words_of

#: Bit i of the ledger's mask is rule i.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")


@dataclass(frozen=True)
class Thresholds:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: int = 1
    max_dup_line_percent: int = 60
    min_mean_word: int = 2
    max_mean_word: int = 20


@dataclass(frozen=True)
class Policy:
    """A document passes if at most ``allowed`` of the rules in ``rules`` fail."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


#: base is the contract's base rule; v1 is the production policy.
POLICIES = (Policy("base", ("few_words", "repeated_words")), Policy("v1", RULES), Policy("lenient", RULES[2:], 1))


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more."""

    def marked(pairs: Column) -> Column:
        twin = lambda e, k: F.coalesce(F.get(pairs, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda e, k: twin(e, k - 1) | twin(e, k + 1)), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, marked), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows, of))


def measurements(text: Column) -> Column:
    """One struct of all counts the rules need."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    counted = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            counted.alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


def failed_mask(m: Column, t: Thresholds) -> Column:
    """The failure bits of measured counts."""
    tests = (
        m["n_words"] < t.min_words,
        m["n_repeat_words"] * 100 > m["n_words"] * t.max_repeat_percent,
        m["n_symbols"] > m["n_words"] * t.max_symbols_per_word,
        m["lines"]["n_dup_lines"] * 100 > m["lines"]["n_lines"] * t.max_dup_line_percent,
        (m["word_chars"] < m["n_words"] * t.min_mean_word) | (m["word_chars"] > m["n_words"] * t.max_mean_word),
    )
    mask = F.lit(0).cast("long")
    for bit, failed in enumerate(tests):
        mask = mask + F.when(failed, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def ledger(docs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """doc_id, the measurements and failed_mask: one row a document."""
    m = docs.select(F.col("doc_id"), measurements(F.col("text")).alias("m"))
    full = m.select("doc_id", "m", failed_mask(F.col("m"), thresholds).alias("failed_mask"))
    return full.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.lines.n_lines", "m.lines.n_dup_lines", "m.n_repeat_words", "failed_mask")


def verdict(mask: Column, policy: Policy) -> Column:
    """Whether a mask passes a policy."""
    return F.bit_count(mask.bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.allowed


def apply_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One row a document and policy version, from the ledger alone."""
    options = F.array(*(F.struct(F.lit(p.version).alias("version"), verdict(F.col("failed_mask"), p).alias("kept")) for p in policies))
    return book.select("doc_id", "failed_mask", F.explode(options).alias("p")).select("doc_id", "p.version", "failed_mask", "p.kept")


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that pass once it is left out."""
    masks = book.groupBy("failed_mask").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules))
    rows = masks.select("failed_mask", "n", F.explode(rules).alias("r"))
    rest = F.col("failed_mask").bitwiseAND(F.lit(policy.mask).cast("long").bitwiseAND(F.bitwise_not(F.col("r.bit"))))
    passes = F.bit_count(rest) <= policy.allowed
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed_mask").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(passes & ~verdict(F.col("failed_mask"), policy), F.col("n")).otherwise(0)).alias("n_rescued"),
    )


def keep(docs: DataFrame, policy: Policy = POLICIES[1], thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The documents that pass, with their own columns only.

    The mask is computed as the texts stream by: a stored ledger would have to be joined back to
    the texts, which would shuffle all of them.
    """
    name = fresh(docs, "quality_mask")
    masked = docs.withColumn(name, let(measurements(F.col("text")), lambda m: failed_mask(m, thresholds)))
    return masked.where(verdict(F.col(name), policy)).drop(name)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: base counts and the production policy's verdict on all documents, from the stored ledger."""
    book = materialize(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ledger")
    base, policy = POLICIES[0], POLICIES[1]
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(F.col("failed_mask"), base)).alias("base_failed"),
        (verdict(F.col("failed_mask"), base) & verdict(F.col("failed_mask"), policy)).alias("kept"),
        "failed_mask",
    )


#: The ledger in DuckDB SQL; also the pipeline's first stage.
LEDGER_SQL = r"""
SELECT w.doc_id, w.n_words, w.word_chars, w.n_symbols, w.n_lines, w.n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
FROM (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines
  FROM (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents)) AS w
LEFT JOIN (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (
        SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (
          SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents))))
    WHERE c > 1)
  GROUP BY doc_id) AS r ON r.doc_id = w.doc_id
"""

MASK_SQL = """(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)::BIGINT"""

OP8_SQL = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_mask & 3) <> 0 AS base_failed, failed_mask = 0 AS kept, failed_mask
FROM (SELECT *, {MASK_SQL} AS failed_mask FROM ({LEDGER_SQL}))
"""
