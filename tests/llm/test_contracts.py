"""Each operator against a brute-force version, on a table of awkward rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import bpe, chat, fingerprints, mixing, ngram_join, pii, quality, substring_dedup, token_counts, token_files
from tracelake.llm.common import materialize, scratch

PASSAGE = " ".join(f"w{i % 37}x{i % 11}" for i in range(60))
PROSE = " ".join(f"word{i} and then other{i * 7 % 13}" for i in range(40))
PII_TEXT = "write to a.b@c-d.example.org or +1 (310) 555-4510, host 10.0.0.1 and 300.1.1.1, card 4444 4444 4444 4448; x@y @z a@b.c%x@d.e 1.2.3.4.5.6.7.8"
ROWS = [
    (1, PASSAGE, "en", "src1"),
    (2, PASSAGE + " tail", "en", "src1"),
    (3, "lead " + PASSAGE, None, "src0"),
    (4, None, "en", "src0"),
    (5, "", "de", None),
    (6, " \n\t \x0b", "de", "src2"),
    (7, PII_TEXT, "en", "src0"),
    (8, "one two", "en", "src0"),
    (9, "two one", "en", "src0"),
    (10, PROSE, "fr", "src3"),
    (11, PROSE.upper(), "fr", "src3"),
    (11, PROSE.upper(), "fr", "src3"),
    (12, "\n".join(["same line here"] * 30), "en", "src0"),
    (13, "日本語 テキスト 🙂 é" * 20, "en", "src0"),
    (14, "a" * 3000 + "=" * 500, "en", "src0"),
    (15, (PROSE + " ") * 200, "en", "src0"),
    (None, "no id " + PASSAGE, "en", "src0"),
    (17, PROSE.replace("word20", "other"), "fr", "src3"),
    (18, "## $$ %% " * 40, "en", "src0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    # extra columns with names that operators use themselves
    return materialize(df.withColumns({c: F.lit("clash") for c in ("tag", "n_words", "part", "key", "row_key", "quality_mask", "bucket", "h", "domain", "n_chars", "base", "spans")}).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path(bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_quality(docs, empty):
    def brute(t):
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = {j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + 3)} if len(g) < 3000 else set(range(len(w)))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)

    book = quality.ledger(docs)
    same(book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect(), [(i, *brute(t)) for i, t, *_ in ROWS])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3} and not {4, 5, 6, 8, 12, 18} & {r.doc_id for r in kept.collect()}
    assert quality.apply_policies(book).count() == len(ROWS) * len(quality.POLICIES)
    gone = {r.rule: r for r in quality.ablations(book, quality.POLICIES[1]).collect()}
    assert gone["few_words"].n_failed == book.where("failed_mask & 1 <> 0").count()
    assert quality.ledger(empty).count() == 0


def spans_of(t):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return (True, k == 1 and all(int(p) <= 255 for p in m.split(".")), k == 2 and 14 <= len(d) <= 19 and luhn(d), k == 3 and 10 <= len(d) <= 15)[k]

    return sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t or "") if ok(k, m[0]))


def test_pii(docs, empty):
    got = {(r.doc_id, r.tag): [tuple(s) for s in r.base] for r in pii.find(docs).collect()}
    assert sorted(map(str, got.values())) == sorted(str(spans_of(t)) for i, t, *_ in dict.fromkeys(ROWS))
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[7].startswith("write to [email] or [phone], host [ip] and 300.1.1.1, card [card]; x@y") and masked[1] == PASSAGE and masked[4] is None
    assert pii.mask(docs).columns == docs.columns and pii.mask(docs).count() == len(ROWS)
    assert pii.find(empty).count() == 0


def test_pii_bootstrap_finds_unseen(spark):
    seeds = [f"please mail reach me at user{i}@site{i}.example.com today friend" for i in range(12)]
    hidden = ["please mail reach me at hidden99(at)place today friend", "numbers like 123456x stand alone here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(seeds + hidden)], "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs).collect()}
    at = hidden[0].index("hidden99")
    assert found[12] == [(at, 0, at + len("hidden99(at)place"))] and found[13] == []
    assert all(len(found[i]) == 1 for i in range(12))


def test_pii_bootstrap_widens(spark):
    """Identifiers without digits, in groups of digits, and reached only over patterns of found ones."""
    seeds = [f"please mail reach me at user{i}@site{i}.example.com today friend" for i in range(40)]
    seeds += [f"ring my desk on +1 (310) 555-{4000 + i} before noon" for i in range(40)]
    hidden = ["please mail reach me at jane(at)example.org today friend", "ring my desk on 555 010 2334 before noon"]
    # these share one side with the seeds, and carry a new context that others then need
    bridge = [f"reach me at who{i}(at)nowhere today since old alias was" for i in range(6)]
    clean = ["please mail reach me at the today friend", "numbers like 123456x stand alone here", "a commit 0123456789abcdef0123456789abcdef01234567 by hand"]
    keys = [f'set token = "{i:x}0123456789abcdef0123456789abcdef" here' for i in range(10, 16)]
    rows = seeds + hidden + bridge + clean + keys
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}

    def at(k, kind, what):
        return [(rows[k].index(what), pii.KINDS.index(kind), rows[k].index(what) + len(what))]

    n = len(seeds)
    assert found[n] == at(n, "email", "jane(at)example.org") and found[n + 1] == at(n + 1, "phone", "555 010 2334")
    assert all(len(found[i]) == 1 for i in range(n))
    assert all(found[n + 2 + i] == at(n + 2 + i, "email", f"who{i}(at)nowhere") for i in range(6))
    assert all(found[n + 8 + i] == [] for i in range(3))
    assert all(found[n + 11 + i] == at(n + 11 + i, "secret", f"{10 + i:x}0123456789abcdef0123456789abcdef") for i in range(6))


def test_pii_added_spans(spark, sf_dir):
    """On the supplied documents the method adds the keys after 'token =', and nothing in other texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, f'note {i} token = "{i:040x}"'.replace("0000", "a1b2")) for i in range(8)], "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find(docs).collect():
        more = sorted(tuple(s) for s in r.spans if s not in r.base)
        keys = [(m.start(1), pii.SECRET, m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{32,})"', text[r.doc_id])]
        assert more == keys, r.doc_id


def test_bpe(docs, empty, reference):
    def brute(t):
        ids = reference.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    path = public_tokenizers.path(bpe.RANKS)
    same(bpe.encode_digests(docs, path).collect(), [(i, *brute(t)) for i, t, *_ in ROWS])
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in ROWS)
    assert bpe.encode_digests(empty, path).count() == 0


def test_bpe_tree(spark, sf_dir, reference):
    """Every supplied text of two leaves or more is halved and joined, and comes out as it should."""
    encoder = bpe.Bpe(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for t in [*texts, "x" * 5000, "ab" * 40 + " " * 700 + "c", "1" * 2000 + "\n" * 900, "'" * 1500 + "s", "é " * 900]:
        before = encoder.text_joins
        ids = encoder.encode(t)
        assert ids == reference.encode_ordinary(t) and encoder.decode(ids) == t.encode()
        assert (encoder.text_joins > before) == (len(t) > bpe.LEAF_CHARS)
    assert encoder.text_joins > len(texts) and encoder.joins > 0


def test_token_counts_random_edits(reference):
    rng = random.Random(5)
    path = public_tokenizers.path(bpe.RANKS)
    encoder, cache = bpe.loaded(path)
    alphabet = ["a", "Bc", " ", "  ", "\n", "\t", "é", "語", "1", "23", "'s", "'", "!?", " the", "_", "\u00a0", "🙂"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 400))) for _ in range(300)]
    for row, tree in token_counts.trees(pa.array(texts), encoder, cache):
        t = texts[row]
        assert tree.n_tokens == len(reference.encode_ordinary(t))
        for _ in range(4):
            at, cut, put = rng.randint(0, len(t) + 3), rng.randint(0, 12), "".join(rng.choices(alphabet, k=rng.randint(0, 6)))
            tree.edit(at, cut, put)
            at = min(at, len(t))
            t = t[:at] + put + t[at + cut :]
            assert (tree.text(), tree.n_chars, tree.n_tokens) == (t, len(t), len(reference.encode_ordinary(t)))


def test_token_counts(docs, empty, reference):
    expected = []
    for i, t, *_ in ROWS:
        t = t or ""
        n, before = len(t), len(reference.encode_ordinary(t))
        for p, d, put in ((n // 2, 10, " revised"), (n // 3, 0, "'s note\n\n"), (2 * n // 3, 7, "")):
            t = t[: min(p, len(t))] + put + t[p + d :]
        expected.append((i, before, len(reference.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()))
    path = public_tokenizers.path(bpe.RANKS)
    got = token_counts.counts(token_counts.with_edits(docs), path)
    same(got.select("doc_id", "n_tokens", "n_tokens_edited", "edited_sha256").collect(), expected)
    long = got.where("doc_id = 15").first()
    assert long.n_chars_encoded < long.n_chars_edited / 10  # only touched regions
    assert token_counts.counts(token_counts.with_edits(empty), path).count() == 0


def shingles(t, n):
    w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def components(rows, n, num, den):
    s = [shingles(t, n) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and den * both >= num * len(s[i] | s[j]):
                top = [top[i] if x == top[j] else x for x in top]
    least = {c: min((r[0] for r, x in zip(rows, top, strict=True) if x == c and r[0] is not None), default=None) for c in set(top)}
    return [(r[0], len(x), least[c]) for r, x, c in zip(rows, s, top, strict=True)]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, docs, empty, n, num, den):
    got = ngram_join.jaccard_components(docs, n, f"{num / den}").drop("tag").collect()
    same(got, components([(i, t) for i, t, *_ in ROWS], n, num, den))


def test_ngram_join_large_group(spark, monkeypatch):
    """Families of several parts and blocks; chains of links; sets just below and at the bound."""
    monkeypatch.setattr(ngram_join, "PART", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"t{i}" for i in range(70)]
    rows = []
    for k in range(40):
        w = list(base)
        for j in range(k % 5):
            w[(k * 3 + j * 11) % 70] = f"edit{k}_{j}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(base[k:] + [f"s{j}" for j in range(k)])) for k in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.jaccard_components(df, 3, "0.9").drop("tag").collect(), components(rows, 3, 9, 10))
    kept = ngram_join.keep_one(df, 3, "0.9")
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in components(rows, 3, 9, 10)}


def test_keep_one_repeats(docs, empty):
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    assert kept.count(11) + kept.count(10) == 1 and kept.count(1) == 1 and 2 not in kept
    assert ngram_join.keep_one(empty).count() == 0


def test_mixing(docs, empty):
    plan = mixing.plan(mixing.with_domain(docs), percent=50, max_epochs=2)
    rows = plan.collect()
    total = sum(len(words(t)) for _, t, *_ in ROWS)
    taken = sum(r.n_taken for r in rows)
    assert taken <= total // 2 and taken >= total // 2 - 100
    assert all(0 <= r.n_taken <= r.n_tokens and r.epoch in (0, 1) for r in rows)
    assert mixing.plan(mixing.with_domain(empty)).count() == 0
    chosen = mixing.select_documents(docs, plan)
    assert chosen.columns == docs.columns and {r.doc_id for r in chosen.collect()} == {r.doc_id for r in rows}


def test_budget_redistribution(spark):
    """A short leaf's rest goes to its siblings first, then to the parent's siblings."""
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 20), ("c", "w", 5000)], "d string, l string, avail long")
    got = {(r.d, r.l): r.budget for r in mixing.budgets(leaves, ("d", "l"), ({}, {}), 900, 1).collect()}
    # b can give 20 of its 300; a and c share the rest: 440 each; in a, x has 10 and y takes 430
    assert got == {("a", "x"): 10, ("a", "y"): 430, ("b", "z"): 20, ("c", "w"): 440}


def check_nodes(spark, folder, rows):
    """Every distinct beginning is emitted once, and ancestors' intervals give what stands before it."""
    encoder, _ = bpe.loaded(public_tokenizers.path(bpe.RANKS))
    convs = {}
    for i, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(i, []).append(chat.render(r or "", x or "")[0])
    begun = {"".join(c[:k]) for c in convs.values() for k in range(1, len(c) + 1)}
    nodes = spark.read.parquet(f"{folder}/nodes").where("leaf is null").orderBy("pack", "seq").collect()
    streams = {}
    for r in nodes:
        stream = streams.setdefault(r.pack, [])
        assert r.start == len(stream) and r.position == sum(i["stop"] - i["start"] for i in r.attends)
        stream += r.ids
        before = [x for i in r.attends for x in stream[i["start"] : i["stop"]]]
        assert encoder.decode(before + r.ids).decode() in begun
        if r.loss_start is not None:
            assert encoder.decode(r.ids[r.loss_start : r.loss_end]).decode() == chat.escape(chat.parse(encoder.decode(r.ids).decode())[1])
    own = [r for r in nodes if not r.carried]
    assert len(own) == len(begun)
    return len(streams), len(nodes) - len(own)


def test_chat_shared_turns(spark, monkeypatch):
    """Deep shared stems over several packs: each turn is emitted once, and carried once a pack at most."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"s{t}" if t < 80 else f"stem{c % 2} {t}" if t < 120 else f"own {c}") for c in range(20) for t in range(121)]
    for turns in (50, 1 << 20):
        monkeypatch.setattr(chat, "PACK_TURNS", turns)
        folder = scratch(spark, "chat-shared")
        chat.write(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), folder)
        packs, carried = check_nodes(spark, folder, rows)
        assert carried <= 120 * (packs - 1) and (packs > 1) == (turns == 50)
        assert sorted((r.conv_id, r.n_turns) for r in chat.read(spark, folder).collect()) == [(c, 121) for c in range(20)]


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
        (4, 0, "user", "<|im_end|><|im_start|>assistant ok"), (4, 1, "assistant", "a <\\| b <|x <\\\\|y"), (5, None, None, None), (5, 1, "assistant", ""), (6, 0, "sys\ntem\\n", "x"),
        (None, 0, "user", "no id"), (7, 0, "user", "hi"), (8, 1, "user", "b"), (8, 1, "user", "a"), (8, 1, "user", "a"),
    ] + [(9, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(200)] + [(10, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit("clash")).repartition(4)
    folder = scratch(spark, "chat-test")
    chat.write(df, folder)
    got = chat.read(spark, folder)
    expected = []
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        whole = "".join(chat.render(r, x)[0] for _, r, x in own)
        expected.append((c, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
    same(got.collect(), expected)
    check_nodes(spark, folder, rows)
    for text in ("<|", "<\\|", "a<\\\\|b", "<<||>", ""):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    chat.write(df.limit(0), scratch(spark, "chat-none"))


def chunked(text):
    """Chunks of a text by a gear hash that rolls byte by byte."""
    gear = [int(x) for x in fingerprints._GEAR]
    raw, out, start = text.encode(), [], 0
    h = 0
    for i, x in enumerate(raw):
        h = ((h << 1) + gear[x]) & 0xFFFFFFFF
        size = i + 1 - start
        strict, loose = h & int(fingerprints.STRICT) == 0, h & int(fingerprints.LOOSE) == 0
        if size >= fingerprints.MOST or fingerprints.LEAST <= size < fingerprints.NORMAL and strict or size >= fingerprints.NORMAL and loose:
            out.append(raw[start : i + 1])
            start = i + 1
    return out + [raw[start:]] if start < len(raw) else out


def test_chunks_against_a_rolling_hash(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()] + [PROSE * 20, "a" * 3000, "é" * 200, "x" * 24, "y" * 25, ""]
    for t in texts:
        want = {}
        for c in chunked(t):
            d = xxhash.xxh3_64_intdigest(c)
            want[d] = want.get(d, 0) + len(c)
        assert fingerprints.fingerprint(t) == want


def test_followers_with_common_ids(spark, monkeypatch):
    """A third of the rows without an id, a third with one and the same: parts stay small, followers right."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 600)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * 10) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    parts = fingerprints.with_followers(df).groupBy("part").agg(F.count("*").alias("n")).collect()
    assert len(parts) > 30 and max(r.n for r in parts) < 60
    tag = {t: h for t, h in df.select("text", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tag[r[1]]))
    want = {t: hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest() for (_, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    got = fingerprints.edited_fingerprints(df).collect()
    assert len(got) == 300 and {r.edited_sha256 for r in got} == set(want.values())


def test_fingerprints(docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4000)
    rows = [(i, t or "") for i, t, *_ in ROWS]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        p, q = fingerprints.fingerprint(t), fingerprints.fingerprint(e)
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.serialize(p), fingerprints.serialize(q), fingerprints.containment(p, q), fingerprints.containment(p, fingerprints.fingerprint(n))))
    same(fingerprints.edited_fingerprints(docs).collect(), expected)
    assert fingerprints.parse(fingerprints.serialize(fingerprints.fingerprint(PROSE))) == fingerprints.fingerprint(PROSE)
    moved = fingerprints.likeness(fingerprints.fingerprint(PROSE * 10), fingerprints.fingerprint("shifted " + PROSE * 10))
    assert moved > 0.8
    assert fingerprints.edited_fingerprints(empty).count() == 0


def removed(rows):
    """(doc_id, words, removed, digest) by brute force."""
    texts = [(i, words(t)) for i, t in rows]
    least = {}
    for i, w in texts:
        if i is not None:
            for p in range(len(w) - 12):
                g = tuple(w[p : p + 13])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in texts:
        gone = {j for p in range(len(w) - 12) if i is not None and least[tuple(w[p : p + 13])] < i for j in range(p, p + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def parsed(rows):
    """The greedy parse by brute force: each window refers to its first place in the least smaller document."""
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), (i, p))
    out = {}
    for i, t in rows:
        w, at, out[i] = words(t), 0, []

        def place(p, w=w, i=i):
            got = first[tuple(w[p : p + 13])] if p + 13 <= len(w) else (i, p)
            return got if got[0] < i else None

        while at < len(w):
            if (source := place(at)) is None:
                at += 1
                continue
            n = 13
            while place(at + n - 12) == (source[0], source[1] + n - 12):
                n += 1
            out[i].append((at, n, *source))
            at += n
    return out


def test_substring_dedup(docs, empty):
    got = substring_dedup.dedup(docs)
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), removed([r[:2] for r in ROWS]))
    assert {r.doc_id: r.kept_text for r in got.collect()}[2] == " ".join(words(PASSAGE + " tail")[60:])
    assert substring_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_substring_factors(spark, monkeypatch, parts):
    """Factors point at their words in smaller documents; in one block they are the brute-force parse."""
    monkeypatch.setattr(substring_dedup, "FLUSH", 1 << 20 if parts == 1 else 200)
    rng = random.Random(3)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(13, 40))] for k in range(6)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(5):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            w += p[a : a + rng.randint(10, 40)] + [f"x{rng.randint(0, 50)}" for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1] + " " + rows[3][1]), (101, " ".join(["again"] * 60)), (102, " ".join(["again"] * 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts)
    got = {r.doc_id: r for r in substring_dedup.dedup(df).collect()}
    same([got[i][:4] for i in got], removed(rows))
    texts = dict(rows)
    for i, r in got.items():
        end = 0
        for f in r.factors:
            assert f.source < i and f.length >= 13 and f.start >= end
            assert words(texts[i])[f.start : f.start + f.length] == words(texts[f.source])[f.position : f.position + f.length]
            end = f.start + f.length
        covered = {j for s in r.spans for j in range(s.start, s.end)}
        assert len(covered) == r.n_removed and covered >= {j for f in r.factors for j in range(f.start, f.start + f.length)}
    if parts == 1:
        assert {i: [tuple(f) for f in r.factors] for i, r in got.items()} == parsed(rows)


def test_substring_repeated_ids(spark):
    """Rows of one doc_id with different texts each lose their own words only."""
    other = " ".join(f"o{i}" for i in range(40))
    rows = [(1, PASSAGE), (5, "a b " + PASSAGE), (5, other), (5, PASSAGE), (9, other)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), removed(rows))


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    folder = scratch(spark, "ids-test")
    token_files.write(docs, folder, path)
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    by_id = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in ROWS}
    start = 0
    for r in got:
        ids = by_id[r.doc_id]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    uri = spark.read.parquet(f"{folder}/manifest").where("n_docs > 3").first()["path"]
    dictionary = open(f"{folder}/dictionary.bin".removeprefix("file://"), "rb").read()
    shard = token_files.Shard(uri, dictionary)
    assert shard.find(10).tolist() == by_id[10] and shard.find(999) is None
    with pytest.raises(ValueError):
        token_files.Shard(uri, b"another")
    none = scratch(spark, "ids-none")
    token_files.write(empty, none, path)
    assert token_files.read(spark, none).count() == 0


def test_token_files_keep_added_token(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    texts = ["plain text", f"one {end} two", f"{end}{end}", f"a  {end}\n b{end}c  d", f"tail \t{end} ", "<|endoftext |>"]
    folder = scratch(spark, "ids-added")
    token_files.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, path)
    got = [r.ids for r in token_files.read(spark, folder).orderBy("start").collect()]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert got[2] == [tokenizer.token_to_id(end)] * 2 + [0]


def test_bpe_on_long_runs(reference):
    """Seams inside one pre-token join the halves' ids; runs of a million signs take seconds."""
    own = bpe.Bpe(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)))
    rng = random.Random(11)
    texts = [c * n for c in ("x", "-", "0", " ", "é", "日") for n in (63, 513, 5000)] + ["abcdefghij" * 3000, "ab" * 2001 + " " + "-=" * 999, "x" * 700 + "'ll" * 400]
    texts += ["".join(rng.choice(["aaaa", "bb", " ", "1234", "---", "'ll", "\n\n"]) * rng.randint(1, 200) for _ in range(8)) for _ in range(60)]
    for t in texts:
        assert own.encode(t) == reference.encode(t), t[:40]
    for c in "x-0 ":
        ids = own.encode(c * 1_500_000)
        assert own.decode(ids) == (c * 1_500_000).encode() and len(ids) < 1_500_001
