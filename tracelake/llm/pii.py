"""PII by bootstrapped contextual extraction, in DataFrame functions only.

A text is a row of slots: words, and runs of up to seven blank-separated groups of digits as one.
A slot's lexical patterns are the word before it, the two words before it, the word after it, and
the words on both sides. Seed entities are slots that hold a base entity (email, ip, card, phone),
and slots that are a hexadecimal key of 32 digits or more (kind secret, see below). On the graph of
patterns and instances, rounds alternate until no new instance is accepted:

* patterns around the instances that are new in this round are counted if SUPPORT different
  instances of a kind carry them. A pattern's confidence for a kind is the number of its slots that
  hold an instance of that kind over the number of all its slots in the corpus plus one, so a word
  that stands before everything has none, however often a seed follows it;
* what stands in a slot of a pattern of CONFIDENCE or more, and isn't a plain word (it has a digit
  or an inner sign), is a candidate. It scores 1 minus the product of (1 - confidence) over its
  patterns and is accepted at ACCEPT or more; its other patterns are the next round's.

Accepted instances, wherever a pattern reaches them, are added to their documents unless they
overlap a base span. A key by its form alone is no entity: it is added only if a pattern reaches it.

Slots of all texts meet the patterns through a sieve, a bit table of SIEVE rows whatever the input,
which is all that is broadcast; what passes it is joined exactly. Positions are code points, end
exclusive. They come from the lengths of the texts between matches, summed by doubling, so cost
stays near linear in matches. Patterns are written so that no input makes them backtrack far.

Defined results: null and empty texts have no spans; repeated rows each get their row; an empty
table gives no rows; other columns of the input are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize

#: The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
SUPPORT, CONFIDENCE, ACCEPT = 4, 0.8, 0.8
#: Rows of a sieve, of 64 bits each; and what a pattern or an instance that many rows share is split into.
SIEVE, SALT = 1 << 14, 16

# The base patterns. They match what the plain forms match, leftmost first; the
# lookbehinds and possessive repeats only keep the engine from trying hopeless starts.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_VALID = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
#: A slot: a run of digit groups, or a word.
_SLOT = r"(?<![^\x20\x09-\x0D])[+(]{0,2}[0-9][0-9().+-]*+(?:\x20[(]?[0-9][0-9().-]*+){1,6}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]++"

SPAN = "struct<start:int,kind:int,stop:int>"


def _doubling(x: Column, join) -> Column:
    """join(value, value a step before) over steps of 1, 2, 4 ... up to any array's size."""

    def stepped(step: int):
        def longer(a: Column) -> Column:
            return F.transform(a, lambda v, i: F.when(i >= step, join(v, F.get(a, i - step))).otherwise(v))

        return lambda a: F.when(F.size(a) <= step, a).otherwise(longer(a))

    for k in range(31):
        x = let(x, stepped(1 << k))
    return x


def prefix_sums(x: Column) -> Column:
    """Running sums of an array, inclusive."""
    return _doubling(x, lambda a, b: a + b)


def running_max(x: Column) -> Column:
    """Running maxima of an array, inclusive."""
    return _doubling(x, F.greatest)


def _spans(text: Column, pattern: str, kind: int, valid) -> Column:
    """All valid matches as SPAN structs."""

    def of(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            def built(ends: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    stop = F.get(ends, i)
                    return F.struct((stop - F.length(m)).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))

                return F.filter(F.transform(found, lambda m, i: F.when(valid(m), one(m, i))), lambda s: s.isNotNull())

            return let(prefix_sums(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))), built)

        return F.when(F.size(found) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(let(F.split(text, pattern, -1), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        def value(i: Column) -> Column:
            v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return v - F.when(v > 9, 9).otherwise(0)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), value), F.lit(0), lambda a, v: a + v)

    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(False))


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    found = (
        F.when(text.contains("@"), _spans(text, _EMAIL, 0, lambda m: F.lit(True))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _spans(text, _IP, 1, lambda m: m.rlike(_IP_VALID))).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _spans(text, _CARD, 2, _luhn)).otherwise(none),
        F.when(text.contains("+"), _spans(text, _PHONE, 3, lambda m: F.length(_digits(m)).between(10, 15))).otherwise(none),
    )
    return F.sort_array(F.concat(*found))


def _core(slot: Column) -> Column:
    """A slot without the signs around it (a leading plus and opening bracket stay); empty if only signs."""
    return F.regexp_extract(slot, r"(?s)^[^\p{L}\p{N}+(]*+(.*[\p{L}\p{N})])", 1)


def _kind(core: Column) -> Column:
    """The kind of seed that a slot is; -1 for none."""
    signs = core.rlike("[0-9@]")
    return F.when(~signs, -1).otherwise(
        F.when(core.rlike(f"^{_EMAIL}$"), 0)
        .when(core.rlike(_IP_VALID), 1)
        .when(core.rlike(f"^{_PHONE}$") & F.length(_digits(core)).between(10, 15), 3)
        .when(core.rlike(f"^{_CARD}$") & _luhn(core), 2)
        .when(core.rlike("^[0-9A-Fa-f]{32,}+$") & core.rlike("[A-Fa-f]"), SECRET)
        .otherwise(-1)
    )


def _slots(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, i, slot, hs): the slots of every text, lower-cased, and the hashes of their patterns.

    Neighbours come from shifted copies of the array, so that hashing runs on exploded rows: in a
    lambda over the array it would be interpreted, and carrying the array would copy it a row.
    """
    slots = docs.select("doc_id", "tag", F.regexp_extract_all(F.lower("text"), F.lit(_SLOT), F.lit(0)).alias("slot")).where(F.size("slot") > 0)
    edge = F.array(F.lit(""))
    shifted = slots.select("doc_id", "tag", "slot", F.concat(edge, "slot").alias("left"), F.concat(edge, edge, "slot").alias("before"), F.slice("slot", 2, F.size("slot")).alias("right"))
    rows = shifted.select("doc_id", "tag", F.posexplode(F.arrays_zip("slot", "left", "before", "right")).alias("i", "z")).where("z.slot is not null")
    left, before, right = (F.coalesce(F.col(f"z.{c}"), F.lit("")) for c in ("left", "before", "right"))
    hs = F.array(
        F.when(left != "", F.xxhash64(F.lit("L"), left)),
        F.when(before != "", F.xxhash64(F.lit("LL"), before, left)),
        F.when(right != "", F.xxhash64(F.lit("R"), right)),
        F.when((left != "") & (right != ""), F.xxhash64(F.lit("B"), left, right)),
    )
    return rows.select("doc_id", "tag", "i", "z.slot", hs.alias("hs"))


def _seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, i, inst, kind, hs) of every slot that is a seed."""
    signs = _slots(docs.where(F.col("text").rlike("[0-9@]"))).where(F.col("slot").rlike("[0-9@]"))
    known = signs.withColumn("core", _core(F.col("slot"))).withColumn("kind", _kind(F.col("core"))).where("kind >= 0")
    return known.select("doc_id", "tag", "i", F.col("core").alias("inst"), "kind", F.array_compact("hs").alias("hs"))


def _sieve(keys: DataFrame) -> DataFrame:
    """A bit table of the hashes h: SIEVE rows at most."""
    word, bit = F.pmod(F.col("h"), F.lit(SIEVE)).cast("int"), F.shiftrightunsigned(F.col("h"), 40).bitwiseAND(F.lit(63)).cast("int")
    return keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _sifted(rows: DataFrame, sieve: DataFrame) -> DataFrame:
    """The rows whose h may be in the sieve."""
    word, bit = F.pmod(F.col("h"), F.lit(SIEVE)).cast("int"), F.shiftrightunsigned(F.col("h"), 40).bitwiseAND(F.lit(63)).cast("int")
    held = F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.join(F.broadcast(sieve), word == F.col("word")).where(held).drop("word", "bits")


def _counts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(h, n): how many slots of the corpus each pattern of keys has."""
    hashes = _slots(docs).select(F.explode("hs").alias("h")).where("h is not null")
    return _sifted(hashes, _sieve(keys)).groupBy("h").agg(F.count("*").alias("n")).join(keys, "h")


def _salted(rows: DataFrame, small: DataFrame, key: str, by: Column) -> DataFrame:
    """The join on a key of which one value may be common: small is repeated SALT times, rows dealt by another column."""
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(by, F.lit(SALT)).cast("int")).join(spread, [key, "_salt"]).drop("_salt")


def _candidates(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, tag, i, inst, h, hs): what isn't a plain word in the slots of the good patterns."""
    plain = r"^[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+$"
    keys = good.select("h").distinct()
    hit = _sifted(_slots(docs).select("*", F.explode("hs").alias("h")).where("h is not null"), _sieve(keys))
    rows = hit.select("doc_id", "tag", "i", "h", _core(F.col("slot")).alias("inst"), F.array_compact("hs").alias("hs"))
    return _salted(rows.where((F.col("inst") != "") & ~F.col("inst").rlike(plain)), keys, "h", F.xxhash64("doc_id", "i"))


def bootstrap(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame | None:
    """(doc_id, tag, i, inst, kind) of slots that hold an accepted instance; docs has doc_id, tag, text.

    None if no pattern is good enough.
    """
    held = materialize(_seeds(docs), "seeds")  # slots that hold an instance, and their patterns
    new = held.select("kind", "inst", F.explode("hs").alias("h"))
    counted = reached = accepted = None
    while True:
        wanted = new.groupBy("h", "kind").agg(F.count_distinct("inst").alias("support")).where(F.col("support") >= support).select("h").distinct()
        if counted is not None:
            wanted = wanted.join(counted.select("h"), "h", "left_anti")
        wanted = materialize(wanted, "patterns")
        if wanted.isEmpty():
            return accepted
        fresh_counts = materialize(_counts(docs, wanted), "counts")
        counted = fresh_counts if counted is None else counted.unionByName(fresh_counts)
        # what a pattern holds changes with every accepted instance
        hits = held.select("kind", F.explode("hs").alias("h")).groupBy("h", "kind").agg(F.count("*").alias("hits"))
        good = materialize(hits.join(counted, "h").select("h", "kind", F.least(F.col("hits") / (F.col("n") + 1), F.lit(0.999)).alias("confidence")).where(F.col("confidence") >= confidence), "good")
        news = good.join(wanted, "h", "left_semi")
        if news.isEmpty():
            return accepted
        got = materialize(_candidates(docs, news), "candidates")
        reached = got if reached is None else reached.unionByName(got)
        pairs = reached.select("inst", "h").distinct()
        graded = _salted(pairs, good, "h", F.xxhash64("inst")).groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = graded.where(F.col("score") >= accept).groupBy("inst").agg(F.max(F.struct("score", -F.col("kind"))).alias("b")).select("inst", (-F.col("b.col2")).alias("kind"))
        slots = reached.groupBy("doc_id", "tag", "i").agg(F.first("inst").alias("inst"), F.first("hs").alias("hs"))
        accepted = materialize(_salted(slots, best, "inst", F.xxhash64("doc_id", "i")), "accepted")
        fresh_ = accepted.join(held.select("doc_id", "tag", "i"), ["doc_id", "tag", "i"], "left_anti").select("doc_id", "tag", "i", "inst", "kind", "hs")
        fresh_ = materialize(fresh_, "found")
        if fresh_.isEmpty():
            return accepted
        held = held.unionByName(fresh_)
        new = held.select("kind", "inst", F.explode("hs").alias("h"))


def _placed(docs: DataFrame, accepted: DataFrame) -> DataFrame:
    """(_id, _tag, more): the spans of accepted slots, by document."""
    wanted = accepted.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set(F.struct("i", "kind")).alias("at"))
    own = docs.dropDuplicates(["doc_id", "tag"]).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    cut = own.select("_id", "_tag", "at", F.regexp_extract_all("text", F.lit(_SLOT), F.lit(0)).alias("slots"), F.split("text", _SLOT, -1).alias("gaps"))
    ends = prefix_sums(F.transform("slots", lambda s, i: F.length(F.get("gaps", i)) + F.length(s)))

    def span(a: Column) -> Column:
        slot = F.get("slots", a["i"])
        head = F.length(F.regexp_extract(slot, r"^[^\p{L}\p{N}+(]*+", 0))
        start = F.get("ends", a["i"]) - F.length(slot) + head
        return F.struct(start.cast("int").alias("start"), a["kind"].cast("int").alias("kind"), (start + F.length(_core(slot))).cast("int").alias("stop"))

    return cut.withColumn("ends", ends).select("_id", "_tag", F.transform("at", span).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, tag, base and spans (arrays of start, kind, stop): one row a document."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    base = read.select("doc_id", "tag", base_spans(F.col("text")).alias("base"))
    accepted = bootstrap(read)
    if accepted is None:
        return base.select("doc_id", "tag", "base", F.col("base").alias("spans"))
    joined = base.join(_placed(read, accepted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    clear = F.filter(F.coalesce("more", F.array().cast(f"array<{SPAN}>")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"])))
    return joined.select("doc_id", "tag", "base", F.sort_array(F.concat("base", clear)).alias("spans"))


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def mask(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; n_chars follows the text."""
    i, tag, marks = (fresh(docs, c) for c in ("pii_id", "pii_tag", "pii_spans"))
    found = find(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("tag").alias(tag), F.col("spans").alias(marks)).distinct()
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[i]) & (F.xxhash64(docs["text"]) == found[tag]), "left")
    names = F.array(*map(F.lit, KINDS))

    def masked(spans: Column) -> Column:
        # how far earlier spans reach, so that overlapping ones leave one mark
        def pieces(reach: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
                gap = F.substring(docs["text"], before + 1, F.greatest(s["start"] - before, F.lit(0)))
                return F.when((s["start"] < before), F.lit("")).otherwise(F.concat(gap, F.lit("["), F.get(names, s["kind"]), F.lit("]")))

            rest = F.substring(docs["text"], F.element_at(reach, -1) + 1, F.length(docs["text"]))
            return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

        return let(running_max(F.transform(spans, lambda s: s["stop"])), pieces)

    text = F.when(F.col(marks).isNull(), docs["text"]).otherwise(masked(F.col(marks)))
    out = {"text": text}
    columns = [out[c].alias(c) if c in out else docs[c] for c in docs.columns]
    done = joined.select(*columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    n = [count(k) for k in range(SECRET)]
    return found.select("doc_id", *n, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))
