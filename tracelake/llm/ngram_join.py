"""N-gram Jaccard self-join by prefix trees.

A document's set is its distinct word n-grams, as 64-bit hashes in one global order (their
value). The order splits into m ranges; two sets of similarity t or more differ in at most
(1-t)/(1+t) of their sizes' sum, so with more ranges than that they hold the same n-grams in at
least one range. Sets that share a range's content (hashed; 7 bytes a range) may link; those
whose sizes and n-gram counts by class rule a link out are told apart on small sketches, and what stays
connected is a family. Every set is in one family at most, and only there are sets compared:

* each family stores its sets in a trie (shared first n-grams once, unary paths compressed);
* a set traverses the trie, carrying the overlap so far from node to children, and leaves a
  subtree as soon as the overlap plus what can still follow, given the remaining lengths, falls
  short of the bound;
* at a leaf the overlap is exact, and the pair is linked or not. Nothing else decides a link.

Equal sets are one entry; a task sends the signatures of each set once. A family is split into
parts: within a part all sets are compared, the family's least set (in every part) among them;
across parts every set is compared with those that their own part did not link to the least set
(what is linked to it is in one component already). Those visit the other parts in parts of their
own, so no task ever holds more than two parts. Components of the links, by least doc_id, are the
result.

Defined results: null and blank texts have an empty set, link with nothing and are their own
component; repeated rows have equal sets, hence one component; a row without doc_id links but
never names a component unless alone (then null); other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, total_bytes
from .components import components
from .hashbuckets import FLUSH, bucket_count, eight, pack, seven, steps, unpack, unsteps
from .textkernel import U64, Words, mix, slices, windows, words

#: Sets in a part of a family: compared by n-grams, and by sketches; classes of a sketch.
PART, BLOCK, SKETCH = 256, 512, 128
#: Salts of joins on a family, so that a large one is dealt over tasks.
SALTS = 32
#: A set with more than one in so many rows is broadcast to them.
HOT = 1024


class Bands:
    """Size bands, ranges a band, and the bounds of a similarity num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        self._ranges: dict[int, tuple[int, int]] = {}

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * self.den // self.num)))
        return bisect_right(self.low, n) - 1

    def ranges(self, b: int) -> tuple[int, int]:
        """(number of ranges, empty ranges that a set may ignore) of band b joined with b and b+1."""
        if b not in self._ranges:
            while len(self.low) < b + 2:
                self.band(self.low[-1])
            most = self.low[b + 1] - 1
            differ = (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            spare = 1 + differ // 24
            self._ranges[b] = (differ + 1 + spare, spare)
        return self._ranges[b]

    def needed(self, a: int, b: int) -> int:
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.den + self.num))


def sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each row; a shorter row is one n-gram as a whole."""
    at, h = windows(w, n)
    row = w.row[at]
    bounds = np.searchsorted(row, np.arange(len(w.counts) + 1))
    begin = np.concatenate([[0], np.cumsum(w.counts)])
    for r, count in enumerate(w.counts.tolist()):
        if count >= n:
            yield np.unique(h[bounds[r] : bounds[r + 1]])
        elif count:
            whole = np.array([count], dtype=U64)
            for k in range(begin[r], begin[r + 1]):
                whole = mix(whole * U64(3) + w.hash[k : k + 1])
            yield whole
        else:
            yield np.zeros(0, dtype=U64)


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch_of(s: np.ndarray) -> bytes:
    """How many n-grams fall into each class; sets differ at least as much as these counts.

    Classes are a power of two, at least SKETCH and a quarter of the set, so that long sets are told
    apart as well; counts for fewer classes are sums of these.
    """
    classes = SKETCH
    while 4 * classes < len(s):
        classes *= 2
    return np.minimum(np.bincount((s % U64(classes)).astype(np.int64), minlength=classes), 255).astype(np.uint8).tobytes()


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """A hash for the content of each range of each band that the set is compared in."""
    total = np.zeros(len(s) + 1, dtype=U64)
    np.cumsum(mix(s), out=total[1:])
    own, out = bands.band(len(s)), []
    for b in (own, own - 1):
        if b < 0:
            continue
        m, spare = bands.ranges(b)
        edges = np.searchsorted(s, (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(U64))
        edges = np.concatenate([[0], edges, [len(s)]])
        filled = np.diff(edges) > 0
        which = np.flatnonzero(filled) if m - filled.sum() <= spare else np.arange(m)
        # an empty range is left out only where, that few being empty, some shared one is not
        out.append(mix(mix(total[edges[which + 1]] - total[edges[which]]) + which.astype(U64) * U64(0x9E3779B97F4A7C15) + U64((b + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))))
    return np.concatenate(out)


PROFILE = "doc_id long, tag long, n long, set_key binary, sketch binary, bucket int, blob binary"
_PROFILE_NAMES = ["doc_id", "tag", "n", "set_key", "sketch", "bucket", "blob"]
_PROFILE_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())


def _profiles(docs: DataFrame, n: int, bands: Bands, lower: bool, buckets: int) -> DataFrame:
    """One row a document (doc_id, tag, n, set_key), and rows of packed signatures (bucket, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bands(bands.num, bands.den)
        held: list[tuple[int, np.ndarray]] = []
        count, sent = 0, set()

        def flush() -> pa.RecordBatch:
            doc, h = np.repeat(np.array([i for i, _ in held]), [len(x) for _, x in held]), np.concatenate([x for _, x in held])
            bucket = (h % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            doc, bucket, h = doc[order], bucket[order], h[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            out = []
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(h)).tolist(), strict=True):
                first = np.append(0, np.flatnonzero(np.diff(doc[a:b])) + 1)
                out.append(pack(*steps(doc[a:b][first]), np.diff(np.append(first, b - a)), seven(h[a:b])))
            none = [None] * len(out)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((none, none, none, none, none, bucket[edges].tolist(), out), _PROFILE_KINDS, strict=True)], names=_PROFILE_NAMES)

        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text")):
                sizes, keys, sketches = [], [], []
                ids, tags = batch.column("doc_id")[a:b].to_pylist(), batch.column("tag")[a:b].to_pylist()
                for s in sets(words(offsets, data, lower), n):
                    sizes.append(len(s))
                    keys.append(key_of(s) if len(s) else None)
                    sketches.append(sketch_of(s) if len(s) else None)
                    if len(s) and keys[-1] not in sent:
                        sent.add(keys[-1])
                        signs = signatures(s, own)
                        i = ids[len(sizes) - 1]
                        held.append((tags[len(sizes) - 1] if i is None else i, signs))
                        count += len(signs)
                none = [None] * (b - a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("tag")[a:b], *(pa.array(c, k) for c, k in zip((sizes, keys, sketches, none, none), _PROFILE_KINDS[2:], strict=True))], names=_PROFILE_NAMES)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return docs.mapInArrow(run, PROFILE)


def _families(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(leader, set_key): sets that share a range, under the least id that shares it.

    Signatures carry doc_ids (a row without one its tag), which pack well; where rows repeat one,
    all its sets come along.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, hashes = [], []
        for data in table.column("blob").to_pylist():
            first, d, counts, h = unpack(data)
            ids.append(np.repeat(unsteps(first, d), counts))
            hashes.append(eight(h))
        doc, h = np.concatenate(ids), np.concatenate(hashes)
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        edge = np.append(0, np.flatnonzero(np.diff(h)) + 1)
        size = np.diff(np.append(edge, len(h)))
        leader, shared = np.repeat(doc[edge], size), np.repeat(size > 1, size)
        leader, doc = leader[shared], doc[shared]
        order = np.lexsort((doc, leader))
        leader, doc = leader[order], doc[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (np.diff(leader) != 0) | (np.diff(doc) != 0)
        return pa.table({"leader": pa.array(leader[new], pa.int64()), "member": pa.array(doc[new], pa.int64())})

    pairs = packed.groupBy("bucket").applyInArrow(run, "leader long, member long").distinct()
    known = profiles.where("set_key is not null").select(F.coalesce("doc_id", "tag").alias("member"), "set_key").distinct()
    return materialize(pairs.join(known, "member").select("leader", "set_key").distinct(), "families")


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the columns of their leader's group, where there is one; a large group's rows stay dealt."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("set_key", F.lit(1)), F.lit(SALTS)).cast("int")).join(salted, ["leader", "salt"], "left").drop("salt")


def _forest(families: DataFrame, payload: DataFrame, compare, size: int) -> DataFrame:
    """Edges (a, b) that connect what compare links in each family (leader, set_key).

    compare takes a table of set_key, role (0 the least set, 1 a member, 2 a visitor) and the
    payload's columns; without visitors it compares all, else visitors with the others. It returns
    edges, and rows (a, null) for what it does not connect to the least set.
    """
    counts = families.groupBy("leader").agg(F.count("*").alias("n"), F.min("set_key").alias("lead")).where("n > 1")
    big = counts.where(F.col("n") > size).select("leader", "lead", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("set_key"), F.col("parts"))).cast("int")
    own = _joined(families, big).where("lead is null or set_key <> lead").select("leader", "set_key", part.alias("part"), F.lit(0).alias("tile"), F.lit(1).alias("role"))
    leads = big.select("leader", F.col("lead").alias("set_key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("tile"), F.lit(0).alias("role"))
    placed = materialize(own.union(leads), "placed")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = compare(table)
        n = len(a)
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int32())], names=["a", "b", "leader", "part"])

    def compared(rows: DataFrame) -> DataFrame:
        full = rows.join(payload, "set_key")
        return materialize(full.groupBy("leader", "part", "tile").applyInArrow(run, "a binary, b binary, leader string, part int"), "links")

    first = compared(placed)
    edges = first.where("b is not null").select("a", "b")
    lone = _joined(first.where("b is null").select("leader", F.col("a").alias("set_key"), F.col("part").alias("home")), big).where("parts is not null").select("leader", "set_key", "home")
    lone = materialize(lone, "lone")
    if lone.isEmpty():
        return edges
    tiles = big.join(lone.groupBy("leader").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles")), "leader").select("leader", "parts", "tiles")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visitors = _joined(lone, tiles).withColumn("tile", F.pmod(F.xxhash64("set_key"), F.col("tiles")).cast("int")).withColumn("part", every("parts")).where("part <> home").select("leader", "set_key", "part", "tile", F.lit(2).alias("role"))
    hosts = _joined(placed.drop("tile"), tiles).where("tiles is not null").withColumn("tile", every("tiles")).select("leader", "set_key", "part", "tile", "role")
    return edges.union(compared(hosts.union(visitors)).where("b is not null").select("a", "b"))


def _stars(keys: list[bytes], roles: list[int], tops: list[int]) -> tuple[list, list]:
    """Edges from each connected member to its tree's least, and (a, null) for those away from role 0.

    The least is not the set of role 0, which is in every part: it gets one edge a part.
    """
    trees: dict[int, list[int]] = {}
    for i, top in enumerate(tops):
        trees.setdefault(top, []).append(i)
    lead = next((tops[i] for i, r in enumerate(roles) if r == 0), None)
    a, b = [], []
    for top, members in trees.items():
        hub = min((i for i in members if roles[i]), key=lambda i: keys[i], default=members[0])
        a += [keys[i] for i in members if i != hub]
        b += [keys[hub]] * (len(members) - 1)
        if top != lead:
            away = [keys[i] for i in members if roles[i] == 1]
            a, b = a + away, b + [None] * len(away)
    return a, b


def _near(table: pa.Table, bands: Bands) -> tuple[list, list]:
    """Connects what sizes and sketches allow to link."""
    keys, roles, n = table.column("set_key").to_pylist(), np.array(table.column("role").to_pylist()), table.column("n").to_numpy()
    counts = [np.frombuffer(x, dtype=np.uint8) for x in table.column("sketch").to_pylist()]
    classes = np.array([len(c) for c in counts])
    label = np.arange(len(keys))
    visit = (roles == 2).any()
    for level in np.unique(classes).tolist():
        # pairs of which the coarser sketch has this many classes
        rows = np.flatnonzero(classes >= level)
        folded = np.stack([counts[i].reshape(-1, level).sum(axis=0, dtype=np.int16) for i in rows])
        coarse = classes[rows] == level
        for at, i in enumerate(rows.tolist()):
            if visit and roles[i] != 2:
                continue
            rest = np.flatnonzero(roles[rows] < 2) if visit else np.arange(at + 1, len(rows))
            rest = rest[(label[rows[rest]] != label[i]) & (coarse[rest] | coarse[at])]
            other = n[rows[rest]]
            rest = rest[np.minimum(other, n[i]) * bands.den >= np.maximum(other, n[i]) * bands.num]
            differ = np.abs(folded[rest] - folded[at]).sum(axis=1, dtype=np.int64)
            near = rest[differ * (bands.den + bands.num) <= (n[rows[rest]] + n[i]) * (bands.den - bands.num)]
            for k in rows[near].tolist():
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
    return _stars(keys, roles.tolist(), label.tolist())


class Trie:
    """Sets in their global order; shared beginnings are stored and counted once."""

    __slots__ = ("bands", "nodes", "sets")

    def __init__(self, members: list[np.ndarray], bands: Bands):
        self.sets, self.bands = members, bands
        order = sorted(range(len(members)), key=lambda i: members[i].astype(">u8").tobytes())
        #: (first, end of the n-grams, a set that has them, children, sets that end here, least and most size below)
        self.nodes: list[tuple] = []
        self._build(order, 0)

    def _build(self, order: list[int], depth: int) -> int:
        """The node of sets (sorted) that share everything before depth."""
        a, b = self.sets[order[0]], self.sets[order[-1]]
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:k] != b[depth:k])
        end = depth + int(differ[0]) if len(differ) else k
        ends = [i for i in order if len(self.sets[i]) == end]
        children, at = [], len(ends)
        while at < len(order):
            token, to = self.sets[order[at]][end], at + 1
            while to < len(order) and self.sets[order[to]][end] == token:
                to += 1
            children.append(self._build(order[at:to], end))
            at = to
        sizes = [len(self.sets[i]) for i in order]
        self.nodes.append((depth, end, order[0], children, ends, min(sizes), max(sizes)))
        return len(self.nodes) - 1

    def linked(self, probe: np.ndarray, skip) -> Iterator[int]:
        """Sets with enough overlap; skip(i): those that needn't be compared."""
        needed, n = self.bands.needed, len(probe)
        stack = [(len(self.nodes) - 1, 0, 0)]
        while stack:
            node, overlap, used = stack.pop()
            first, end, holder, children, ends, least, most = self.nodes[node]
            if len(ends) == 1 and not children and skip(ends[0]):
                continue
            if least * self.bands.den < n * self.bands.num and most * self.bands.den < n * self.bands.num or least * self.bands.num > n * self.bands.den:
                continue
            bound, here = needed(n, least), self.sets[holder]
            while first < end:  # in steps, so that unlike sets part early
                to = min(end, first + 128)
                part = here[first:to]
                at = np.searchsorted(probe, part)
                inside = at < n
                overlap += int((probe[at[inside]] == part[inside]).sum())
                used, first = int(np.searchsorted(probe, part[-1], side="right")), to
                if overlap + min(n - used, most - to) < bound:
                    break
            else:
                for i in ends:
                    if overlap >= needed(n, len(self.sets[i])) and not skip(i):
                        yield i
                if overlap + min(n - used, most - end) >= bound:
                    stack.extend((c, overlap, used) for c in children)


def _compare(table: pa.Table, bands: Bands) -> tuple[list, list]:
    """Connects what has enough n-grams in common, by way of the trie."""
    keys, roles = table.column("set_key").to_pylist(), table.column("role").to_pylist()
    members = [np.frombuffer(x, dtype="<u8") for x in table.column("ngrams").to_pylist()]
    stored = [i for i, r in enumerate(roles) if r < 2]
    top = list(range(len(keys)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    visit = len(stored) < len(keys)
    if stored:
        trie = Trie([members[i] for i in stored], bands)
        for i in [i for i, r in enumerate(roles) if r == 2] if visit else range(len(keys)):
            for k in trie.linked(members[i], lambda k, i=i: find(stored[k]) == find(i)):
                top[find(i)] = find(stored[k])
    return _stars(keys, roles, [find(i) for i in range(len(keys))])


def _ngrams(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """(set_key, ngrams) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text")):
                got = [s.astype("<u8").tobytes() for s in sets(words(offsets, data, lower), n)]
                yield pa.RecordBatch.from_arrays([batch.column("set_key")[a:b], pa.array(got, pa.binary())], names=["set_key", "ngrams"])

    return docs.select("set_key", "text").mapInArrow(run, "set_key binary, ngrams binary")


def jaccard_components(docs: DataFrame, n: int = 5, similarity: Fraction | str = "0.8", lower: bool = True) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, component_id: one row a document."""
    similarity = Fraction(similarity)
    bands = Bands(similarity.numerator, similarity.denominator)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    share = 4 * (bands.den - bands.num) / (bands.den + bands.num)
    buckets = bucket_count(total_bytes(docs, "text") / 6 * share)
    both = materialize(_profiles(docs, n, bands, lower, buckets), "profiles")
    profiles = both.where("bucket is null").select("doc_id", "tag", "n", "set_key", "sketch")
    families = _families(both.where("bucket is not null").select("bucket", "blob"), profiles).withColumn("leader", F.col("leader").cast("string"))
    sketches = profiles.where("set_key is not null").select("set_key", "n", "sketch").dropDuplicates(["set_key"])
    # what sketches don't tell apart: every set that may link is in one cluster
    near = components(_forest(families, sketches, lambda table: _near(table, bands), BLOCK))
    families = materialize(near.select(F.lower(F.hex("component")).alias("leader"), F.col("node").alias("set_key")), "clusters")
    holders = profiles.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("one"), F.min("doc_id").alias("doc_id"))
    wanted = families.select("set_key").distinct().join(holders, "set_key").select("set_key", F.col("one.doc_id").alias("doc_id"), F.col("one.tag").alias("tag"))
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("tag").cast("string")).alias("row")
    texts = docs.select(row, "text").join(wanted.select(row, "set_key"), "row").dropDuplicates(["row"])
    ngrams = materialize(_ngrams(texts, n, lower), "ngrams")
    labels = components(_forest(families, ngrams, lambda table: _compare(table, bands), PART))
    least = holders.select("set_key", F.col("doc_id").alias("least"))
    linked = labels.select(F.col("node").alias("set_key"), F.col("component").alias("leader")).join(least, "set_key")
    linked = _joined(linked, linked.groupBy("leader").agg(F.min("least").alias("component_id"))).select("set_key", "component_id", F.lit(True).alias("in"))
    by_set = least.join(linked, "set_key", "left").select("set_key", F.when(F.col("in"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    empty = profiles.where("set_key is null").select("doc_id", "tag", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # a set of many rows (there are fewer than HOT such sets) is sent to its rows, not they to one task
    filled = profiles.where("set_key is not null")
    hot = filled.groupBy("set_key").count().where(F.col("count") * HOT > profiles.count()).select("set_key")
    by_set = materialize(by_set.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "set_key", "left"), "by_set")
    few = F.broadcast(by_set.where("hot").select("set_key", "component_id"))
    rest = filled.join(few.select("set_key"), "set_key", "left_anti").join(by_set.where("hot is null").select("set_key", "component_id"), "set_key")
    columns = ("doc_id", "tag", F.col("n").alias("n_shingles"), "component_id")
    return filled.join(few, "set_key").select(*columns).union(rest.select(*columns)).union(empty)


def keep_one(docs: DataFrame, n: int = 5, similarity: Fraction | str = "0.8") -> DataFrame:
    """Of each component the row of least (doc_id, hash of text) stays, with its own columns only.

    Rows that have no component id (no doc_id, linked to nothing) all stay, once each.
    """
    groups = materialize(jaccard_components(docs, n, similarity), "groups")
    first = groups.where("component_id is not null").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("k")).select("k.doc_id", "k.tag")
    alone = groups.where("component_id is null").select("doc_id", "tag")
    row = lambda d, t: F.concat_ws(":", d.cast("long").cast("string"), t.cast("string"))
    name = fresh(docs, "row_key")
    keys = first.union(alone).select(row(F.col("doc_id"), F.col("tag")).alias(name))
    keyed = docs.withColumn(name, row(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))))
    return keyed.join(keys, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles, similarity 0.9, all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, "0.9").drop("tag")


#: Components over distinct texts: equal sets first, then links, then reachability.
COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table}),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], ' ')) END)) AS g FROM d),
r AS (SELECT min(doc_id) AS r, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT r, n, unnest(g) AS k FROM r),
k AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb FROM (SELECT x.* FROM x SEMI JOIN k USING (k)) a
  JOIN (SELECT x.* FROM x SEMI JOIN k USING (k)) b ON a.k = b.k AND a.r <> b.r AND {den} * a.n >= {num} * b.n AND {den} * b.n >= {num} * a.n GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p WHERE {den} * o >= {num} * (na + nb - o)),
w AS (SELECT r AS a, r AS b FROM r UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
c AS (SELECT a, min(b) AS c FROM w GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
FROM s LEFT JOIN r ON r.g = s.g LEFT JOIN c ON c.a = r.r
"""
OP4_SQL = COMPONENTS_SQL.format(table="documents", n=3, num=9, den=10)
