"""Operators 11 to 13 against brute force, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import filter_audit, periodic_runs, topk
from tracelake.llm.common import materialize

LONG = "Ab " * 250_000 + "x" * 1_500_000 + " # end"
PROSE = " ".join(f"word{i}" for i in range(220))
TEXTS = [
    (1, PROSE, "a"), (2, PROSE, "a"), (3, PROSE, None), (3, PROSE, "b"), (3, PROSE, "b"), (4, None, "a"), (5, "", ""), (6, " \n\t\x0b  ", "c"), (7, "AB " * 300, "a"), (8, "same # same", "b"),
    (None, PROSE, "a"), (None, "no id", None), (9, "日本語 🙂 É " * 80, "c"), (10, LONG, "c"), (11, LONG, "c"), (12, "a b " * 100, "a"), (14, "x " + "p q r s t u v " * 9 + "y", "a"), (15, "one", "b"), (-3, PROSE + " ", "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (7, None, 1), (99, 1, 1), (None, 1, 1), (14, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    clash = ("part", "mask", "n", "words", "runs", "h", "a", "w", "best", "good", "toxic")
    return materialize(df.withColumns({c: F.lit("clash") for c in clash}).repartition(3), "docs")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def audited(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    parts = {}
    for i, t, s in rows:
        t, w = t or "", words(t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])
        parts.setdefault(s or "", []).append(({c for c, x in zip("ABCDE", tests, strict=True) if x}, i in good, i in toxic))
    out = []
    for part, held in parts.items():
        got, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(held)
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[0]]
                total[f] += len(removed)
                left = [d for d in left if f not in d[0]]
                failing = [d for d in held if f in d[0]]
                got.append((f, "".join(order), step, len(left), len(removed), len(failing) - len(removed), sum(d[0] == {f} for d in held), sum(d[1] for d in removed), sum(d[2] for d in removed)))
        out += [(part, *r, total[f]) for f, *r in got]
    return sorted(out)


def test_audit(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == audited(TEXTS, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs.where("doc_id = 8"), labels.limit(0)).where("kept = 0").count() > 0


def test_audit_chains_tell_texts_of_one_hash_apart():
    chains = filter_audit.Chains()
    rows = [(5, b"x", 9), (5, b"y", 3), (5, b"x", 4), (5, b"x", 4), (5, b"y", 8), (5, b"x", 2)]
    settled = [(i, p, m) for h, t, i in rows for i, p, m, _ in chains.add(h, t, i, 0, {"s": 1})]
    assert settled == [(9, "s", 16), (8, "s", 16), (4, "s", 16)]
    assert sorted((e[0], e[1]) for _, e in chains.drain()) == [(b"x", 2), (b"y", 3)]


def test_audit_flushes(monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 10)
    rows = [(i, "s", "text number one" if i % 3 else "") for i in range(30)]
    got = sorted(filter_audit._settled(filter_audit._routed(iter(rows))))
    assert [i for i, _, m, _ in got if not m & 16] == [0, 1] and sum(n for *_, n in got) == 30


def brute_runs(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                out.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_random():
    rng = random.Random(5)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n = rng.randint(0, 120)
            w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        x, y = "a", "ab"
        while len(y) < 150:
            x, y = y, y + x
        docs.append([ord(c) for c in y])  # a word of many overlapping runs
        got = [[] for _ in docs]
        flat, sizes = np.array([x for w in docs for x in w], dtype=np.int64), np.array([len(w) for w in docs])
        for d, *run in zip(*(x.tolist() for x in periodic_runs.runs_of(flat, sizes)), strict=True):
            got[d].append(tuple(run))
        assert got == [brute_runs(w) for w in docs]


def test_runs_of_documents(docs):
    got = {}
    for r in periodic_runs.find(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed_text, r.collapsed_sha256))
    assert sum(map(len, got.values())) == len(TEXTS)
    for i, t, _ in TEXTS:
        w = words(t)
        runs = [(0, 250_000, 1)] if t == LONG else brute_runs(w)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (len(w), runs, kept, hashlib.sha256(kept.encode()).hexdigest()) in got[i]
    assert got[12][0][1] == [(0, 200, 2)] and got[14][0][1] == [(1, 63, 7)]
    assert periodic_runs.find(docs.limit(0)).count() == 0


def test_planted_runs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 60))) for i in range(400)] + [(None, "a b c"), (20, None)]
    got = sorted((str(r.doc_id), words(r.text)) for r in periodic_runs.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = []
    for i, t in rows:
        w = words(t)
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        want.append((str(i), w))
    assert got == sorted(want)


VECTORS = [(i, [math.sin(i * 7 + j) if i % 3 else math.cos(j) for j in range(8)]) for i in range(200)]
VECTORS += [(200, None), (201, []), (202, [1.0, None] * 4), (250, [float("nan")] * 8), (251, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (300, [1.0, 2.0]), (301, [-0.001, 0.5]), (350, [3.0]), (100, [0.5] * 8), (7, [0.25] * 8), (400, [1e4] * 8)]


def top(rows, k, every, scale=256):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in rows:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [10, 3])
def test_topk(spark, monkeypatch, bits):
    monkeypatch.setattr(topk, "BITS", bits)
    monkeypatch.setattr(topk, "LEAST_SLAB", 32)
    monkeypatch.setattr(topk, "SCORES", 200)
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("qn", "slab", "v", "want", "score", "rank")}).repartition(3)
    assert sorted(map(tuple, topk.search(v.where("vec_id % 50 = 0"), v, 5).collect())) == top(VECTORS, 5, 50)
    assert topk.search(v.where("vec_id % 50 = 0"), v.limit(0)).count() == 0 and topk.search(v.limit(0), v).count() == 0


def test_topk_beyond_doubles(spark):
    rows = [(i, [1e5 + i / 512, float(i * 1000)]) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(v.where("vec_id % 50 = 0"), v, 3).collect())) == top(rows, 3, 50)
    with pytest.raises(ValueError):
        topk.search(v, spark.createDataFrame([(1, [1e9, 1.0])], "vec_id long, embedding array<double>"))
