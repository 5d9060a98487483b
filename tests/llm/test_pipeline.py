"""The pipeline's stages against brute force and DuckDB, on the smallest supplied table."""

import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_contracts import components, reference, spans_of, words  # noqa: F401
from tracelake.llm import mixing, pii
from tracelake.llm.common import materialize


def test_stages(spark, sf_dir, reference):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "t")
        out[name] = docs
        assert name == "byte_bpe" or docs.columns == columns

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    from tracelake.llm.quality import OP8_SQL

    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP8_SQL}) WHERE kept").fetchall()}
    assert {r.doc_id for r in out["quality_rules"].collect()} == kept

    own = [(i, rows[i].text) for i in sorted(kept)]
    one = {i for (i, _), (_, _, c) in zip(own, components(own, 5, 4, 5), strict=True) if i == c}
    assert {r.doc_id for r in out["ngram_jaccard"].collect()} == one

    def masked(t):
        got, at = "", 0
        for start, kind, stop in spans_of(t):
            if start >= at:
                got += t[at:start] + f"[{pii.KINDS[kind]}]"
            at = max(at, stop)
        return got + t[at:]

    texts = {r.doc_id: r.text for r in out["pii"].collect()}
    assert texts == {i: masked(rows[i].text) for i in one}

    table = out["pii"].toPandas()  # noqa: F841  read by DuckDB
    con.register("masked", table)
    chosen = {r[0] for r in con.execute(mixing._sql("masked", 80, 1)).fetchall()}
    assert {r.doc_id for r in out["source_mixing"].collect()} == chosen and 0 < len(chosen) <= len(one)

    for r in out["byte_bpe"].collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert all(words(t) for t in texts.values())


AWKWARD = [
    # (doc_id, text, lang, source): nulls in any column, empty, blank, long and repeated texts
    (1, "TEXT", "en", "web"),
    (1, "TEXT", "en", "web"),
    (2, "TEXT", None, None),
    (3, None, "en", "web"),
    (4, "", None, "web"),
    (5, " \n\t ", "en", None),
    (6, "LONG", "en", "books"),
    (None, "TEXT more", "en", "web"),
    (None, None, None, None),
    (7, "OTHER", "de", "web"),
    (8, "OTHER", "de", "web"),
    (9, "mail", "en", "web"),
]


def awkward_docs(spark):
    prose = lambda seed, n: " ".join(f"w{(i * i + seed) % 977}" for i in range(n))
    texts = {"TEXT": prose(1, 80), "TEXT more": prose(1, 80) + " and a tail", "OTHER": prose(5, 90), "LONG": prose(3, 60) + " " + "x" * 100_000 + " " + prose(11, 20_000), "mail": prose(9, 90) + " write to a.b@example.org or +1 310 555 4510"}
    rows = [(i, texts.get(t, t), lang, source) for i, t, lang, source in AWKWARD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    clash = ("tag", "row_key", "quality_mask", "pii_id", "pii_tag", "pii_spans", "domain", "key", "part", "n_tokens", "component_id", "_id", "r")
    return materialize(df.withColumns({c: F.lit("clash") for c in clash}).repartition(3), "awkward")


def test_stages_on_awkward_rows(spark, sf_dir):
    """Rejected rows go; of equal texts one row stays; every stage keeps all columns and their values."""
    docs = awkward_docs(spark)
    columns, count = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        got = materialize(stage(spark, docs, sf_dir), "t")
        rows = got.collect()
        count[name] = len(rows)
        if name != "byte_bpe":
            assert got.columns == columns and {r[c] for r in rows for c in columns[5:]} == {"clash"}
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        if name == "quality_rules":
            assert all(r.text and len(r.text.split()) >= 50 for r in rows)
            assert sum(r.doc_id == 1 for r in rows) == 2
        if name == "ngram_jaccard":
            ids = [r.doc_id for r in rows]
            assert ids.count(1) == 1 and ids.count(7) == 1 and ids.count(9) == 1 and 2 not in ids and 8 not in ids and len(ids) == len(set(ids))
        if name == "pii":
            mail = next(r.text for r in rows if r.doc_id == 9)
            assert mail.endswith("write to [email] or [phone]")
        docs = got
    assert count["ngram_jaccard"] == count["pii"] >= count["source_mixing"] == count["byte_bpe"]


def test_every_stage_takes_awkward_rows_alone(spark, sf_dir):
    """Each stage over the raw awkward table, and over none of its rows."""
    docs = awkward_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert 0 < stage(spark, docs, sf_dir).count() <= len(AWKWARD)
        none = materialize(stage(spark, docs.limit(0), sf_dir), "t")
        assert none.count() == 0 and (name == "byte_bpe" or none.columns == docs.columns)
