"""Commits of the ledger, the guard on the parse tree, transactions, parsers' metadata and sanitising."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tracelake.functions import lateral
from tracelake.functions import normalize as N
from tracelake.operators import casesql, custody, threats
from tracelake.sources import logs

EVIDENCE = "evidence_id string, hash_value string, created_at string"


def evidence(spark, *ids, when="2024"):
    return spark.createDataFrame([(i, "a" * 64, when) for i in ids], EVIDENCE)


def test_two_writers_of_one_id(spark, tmp_path):
    path, won, lost = f"file://{tmp_path}/ledger", [], []
    custody.Ledger(spark, path).append(evidence(spark, "e0"))

    def write(k):
        try:
            custody.Ledger(spark, path).append(evidence(spark, "same", f"own{k}"))
            won.append(k)
        except ValueError:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 2
    ledger = custody.Ledger(spark, path)
    assert sorted(r.evidence_id for r in ledger.read().collect()) == ["e0", f"own{won[0]}", "same"]
    assert [n for n, _ in ledger.commits()] == [1, 2]
    assert [r.evidence_id for r in ledger.listing().collect()][0] == "e0"


def test_a_killed_writer_leaves_no_row(spark, tmp_path, monkeypatch):
    ledger = custody.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.append(evidence(spark, "e1"))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(custody.Ledger, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            ledger.append(evidence(spark, "e2"))
    assert len(os.listdir(tmp_path / "ledger" / "rows")) == 2 and ledger.count() == 1
    assert ledger.append(evidence(spark, "e2")) == 1 and ledger.count() == 2


def test_audit_verdict(spark):
    rows = spark.createDataFrame([("INTACT",), ("INTACT",), ("MISSING",)], "status string")
    assert tuple(custody.audit_verdict(rows).first()) == (3, 2, 0, 1, None, "COMPROMISED")
    whole = rows.where("status = 'INTACT'")
    assert tuple(custody.audit_verdict(whole, "AA", " aa ").first()) == (2, 2, 0, 0, True, "VALID")
    assert custody.audit_verdict(whole, "ab", "aa").first().verdict == "COMPROMISED" and custody.audit_verdict(rows.limit(0)).first().verdict == "VALID"


def test_leaves_are_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(custody, "RANGE_ROWS", 50)
    rows = [(f"k{i % 40:02d}", f"{i:03d}") for i in range(300)]
    got = custody.number_leaves(spark.createDataFrame(rows, "name string, hash string").repartition(4), "name").orderBy("idx").collect()
    assert [(r.name, r.hash) for r in got] == sorted(rows) and [r.idx for r in got] == list(range(300))


# the guard

SEEN = {
    "SELECT * FROM incidents": {"incidents"},
    "SELECT i.id FROM `incidents` i JOIN main.suspects s ON i.id = s.incident_id": {"incidents", "main.suspects"},
    "SELECT id FROM incidents WHERE id IN (SELECT incident_id FROM evidences WHERE id > (SELECT max(id) FROM victims))": {"incidents", "evidences", "victims"},
    "WITH a AS (SELECT * FROM incidents), b AS (WITH c AS (SELECT * FROM hidden) SELECT * FROM c JOIN a) SELECT * FROM b": {"incidents", "hidden"},
    "SELECT (SELECT count(*) FROM secret.tokens t) FROM incidents UNION ALL SELECT 1 FROM (SELECT * FROM users) u": {"incidents", "secret.tokens", "users"},
    "SELECT id FROM incidents i WHERE EXISTS (SELECT 1 FROM passwords p WHERE p.id = i.id)": {"incidents", "passwords"},
    "INSERT INTO evidences (id, item) SELECT id, name FROM stolen": {"evidences", "stolen"},
    "SELECT * FROM incidents, LATERAL (SELECT * FROM inner_one) x": {"incidents", "inner_one"},
}


def test_relations_of_the_tree(spark):
    for sql, names in SEEN.items():
        assert casesql.tree_of(spark, sql)[1] == names, sql
    with pytest.raises(casesql.GuardError):
        casesql.tree_of(spark, "SELEC id FROM incidents")


def test_the_store_refuses_what_the_tree_shows(spark):
    store = casesql.CaseStore(spark)
    bad = ("SELECT * FROM range(10)", "SELECT id FROM incidents WHERE id IN (SELECT id FROM hidden)", "WITH incidents AS (SELECT 1 AS id) SELECT * FROM incidents", "SELECT id FROM incidents LATERAL VIEW explode(array(1)) t AS x JOIN other")
    for sql in bad:
        with pytest.raises(casesql.GuardError):
            store.query(sql)
            pytest.fail(sql)
    assert store.query('SELECT id FROM "incidents" WHERE summary <> \'FROM hidden\'').count() == 0


def test_statements_run_together_or_not_at_all(spark):
    store = casesql.CaseStore(spark)
    add = casesql.Statement("INSERT", "incidents", "INSERT INTO incidents (id, incident_type, risk_level) VALUES (:id, :kind, 'Alto')", {"id": 1, "kind": "robo"})
    got = store.execute_many([add, "INSERT INTO evidences (id, incident_id, item) VALUES (1, 1, 'x'), (2, 1, 'y')", "SELECT id, item FROM evidences ORDER BY id", "INSERT INTO victims (id, incident_id, name_or_identity) SELECT id, incident_id, item FROM evidences"])
    assert got[0] == 1 and got[1] == 2 and got[3] == 2 and [tuple(r) for r in got[2].collect()] == [(1, "x"), (2, "y")]
    assert store.query("SELECT name_or_identity, injury_status FROM victims ORDER BY id").collect()[0][:] == ("x", None)
    before = {k: df.count() for k, df in store.frames.items()}
    for last in ("INSERT INTO evidences (id, incident_id, item) VALUES (4, 1, NULL)", "DROP TABLE incidents", "SELECT nothing FROM incidents", "INSERT INTO evidences (id, unknown) VALUES (5, 1)"):
        with pytest.raises(Exception):  # noqa: B017  the guard's, or Spark's
            store.execute_many(["INSERT INTO evidences (id, incident_id, item) VALUES (3, 1, 'z')", last])
        assert {k: df.count() for k, df in store.frames.items()} == before
    assert store.execute("SELECT count(*) AS n FROM evidences").first().n == 2


def test_ids_of_children_do_not_clash(spark):
    kids = "array<struct<alias_or_name:string,physical_description:string,status:string>>"
    schema = f"id long, incident_type string, date_approx string, location string, risk_level string, summary string, created_at timestamp, suspects {kids}, evidences array<struct<item:string,location_found:string,evidence_type:string>>, victims array<struct<name_or_identity:string,injury_status:string,statement_summary:string>>"
    rows = [(i, "a", None, None, "Alto", None, None, [(f"s{j}", None, "Detenido") for j in range(1500)], [("x", None, None)], []) for i in (1, 2, 3)]
    out = casesql.explode_reports(spark.createDataFrame(rows, schema))
    assert out["suspects"].select("id").distinct().count() == 4500 and out["evidences"].count() == 3 and out["victims"].count() == 0
    assert out["suspects"].where("id <= 0").isEmpty()


# parsers

LINES = [
    '{"ts": 1700000000, "src_ip": "10.0.0.1", "username": "ana", "duration": 2.5, "proto": "tcp", "is_anomaly": true, "event_type": "network_flow"}',
    "<34>1 2026-03-04T09:10:11Z gw app 77 ID9 - Failed password for root from 10.0.0.2 port 22 ssh2",
    "2026-03-04T09:10:11Z gw sudo[5]: bob : TTY=pts/1 ; PWD=/home ; USER=root ; COMMAND=/bin/ls -l",
    "Mar  4 09:10:11 gw cron[9]: job done",
    "{not json",
    "",
]


def test_security_metadata(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "i int, value string")
    got = {r.i: r for r in logs.parse_security(df, 2026).collect()}
    assert (got[0].user, got[0].duration, got[0].metadata, got[0].is_anomaly) == ("ana", 2.5, {"proto": "tcp"}, True)
    assert (got[1].event_type, got[1].metadata) == ("ssh_auth_fail", {"pri": "34", "procid": "77", "msgid": "ID9"})
    assert got[2].metadata == {"host": "gw", "pid": "5", "tty": "pts/1", "pwd": "/home", "target_user": "root", "command": "/bin/ls -l"}
    assert got[3].metadata == {"host": "gw", "pid": "9"} and got[3].duration == 0.0
    assert (got[4].event_type, got[4].status, got[4].metadata) == ("malformed", "json_parse_error", {}) and got[5].status == "empty"
    hinted = {r.i: r for r in logs.parse_security(df, 2026, "json").collect()}
    assert hinted[3].status == "json_parse_error" and hinted[0].user == "ana"
    with pytest.raises(ValueError):
        logs.parse_security(df, 2026, "xml")


def test_nested_sanitising(spark):
    text = '{"user": "ana", "Token": "abc", "n": 5, "more": {"password": "x", "note": "pwd=abc done", "list": ["secret: s1", "ok"]}, "headers": {"API_KEY": "k", "via": "Bearer abcdefghijklmnop12"}}'
    schema = "user string, Token string, n int, more struct<password: string, note: string, list: array<string>>, headers map<string,string>"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = df.select(N.sanitize_json(F.col("t"), schema).alias("t")).collect()
    assert got[0].t == '{"user":"ana","Token":"[REDACTED]","n":5,"more":{"password":"[REDACTED]","note":"pwd=[REDACTED] done","list":["secret=[REDACTED]","ok"]},"headers":{"API_KEY":"[REDACTED]","via":"Bearer [REDACTED]"}}'
    pairs = spark.createDataFrame([({"PASSWORD": "x", "note": "token=abc", "none": None},)], "m map<string,string>")
    assert pairs.select(N.sanitize_map(F.col("m")).alias("m")).first().m == {"PASSWORD": "[REDACTED]", "note": "token=[REDACTED]", "none": None}


def test_lateral_functions(spark):
    lateral.register(spark)
    lines = spark.createDataFrame([(1, '[a@1 x="1" x="2" y="z"] text [b@2 k="v"]'), (2, "none"), (3, None)], "i int, value string")
    got = spark.sql("SELECT i, element, name, s.value FROM {lines} l, LATERAL structured_data(l.value) s", lines=lines)
    assert sorted(map(tuple, got.collect())) == [(1, "a@1", "x", "2"), (1, "a@1", "y", "z"), (1, "b@2", "k", "v")]
    blobs = spark.createDataFrame([(1, b"..\xff\xd8\xff\xe0ab\xff\xd9"), (2, None)], "i int, content binary")
    assert [(r.i, r.at, r.size, r.format) for r in spark.sql("SELECT b.i, c.* FROM {blobs} b LEFT JOIN LATERAL carved(b.content) c ON c.at > 0 ORDER BY 1", blobs=blobs).collect()] == [(1, 2, 8, "JPEG"), (2, None, None, None)]


def test_weights_of_the_hybrid_score(spark):
    rows = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(60)], "a double, b double")
    model = threats.fit_model(rows, ["a", "b"], trees=4, sample=16, weights=(1.0, 0.0, 0.0))
    got = threats.score(rows, model).collect()
    assert all(r.anomaly == pytest.approx(min(1.0, r.isolation)) for r in got)
