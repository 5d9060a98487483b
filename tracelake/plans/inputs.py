"""The engine's record types derived from the supplied tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table; makes sure that checkpoint() has a folder (the session's, if it names one)."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-tracelake-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money from customers' nations to suppliers' nations, in whole cents: one edge a pair."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = joined.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").cast("double").alias("weight"), (F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))) / 100) / 100.0).alias("amount"))
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    return sums.select(name("c_nationkey").alias("source"), name("s_nationkey").alias("target"), F.lit("TRANSFER").alias("relation_type"), "weight", "amount", F.lit(None).cast("string").alias("timestamp"), (F.col("c_nationkey") * 25 + F.col("s_nationkey")).cast("long").alias("seq"))


TRANSFERS_SQL = """t AS (SELECT 'N' || c_nationkey AS source, 'N' || s_nationkey AS target, count(*)::DOUBLE AS weight,
  floor(sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::BIGINT / 100) / 100.0::DOUBLE AS amount, (c_nationkey * 25 + s_nationkey)::BIGINT AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey)"""


def all_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transfer between two nations."""
    return transfers(spark, sf_dir).where("source <> target")


ALL_SQL = TRANSFERS_SQL + """, s AS (SELECT source, target, weight, amount, seq FROM t WHERE source <> target)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, customers and suppliers as graph nodes; risk is the balance's distance from zero, capped."""
    t = lambda n: table(spark, sf_dir, n)
    risk = lambda c: F.round(F.least(F.lit(1.0), F.abs(F.col(c)) / 10000.0), 4).alias("risk_score")
    one = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string")).alias("id")
    a = t("nation").select(one("N", "n_nationkey"), F.lit("LOCATION").alias("entity_type"), F.col("n_name").alias("label"), F.lit(0.5).alias("risk_score"))
    b = t("customer").select(one("C", "c_custkey"), F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("label"), risk("c_acctbal"))
    c = t("supplier").select(one("S", "s_suppkey"), F.lit("ORGANIZATION").alias("entity_type"), F.col("s_name").alias("label"), risk("s_acctbal"))
    return a.union(b).union(c)


NODES_SQL = """n AS (SELECT 'N' || n_nationkey AS id, 'LOCATION' AS entity_type, n_name AS label, 0.5::DOUBLE AS risk_score FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'PERSON', c_name, round(least(1.0::DOUBLE, abs(c_acctbal) / 10000.0), 4) FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'ORGANIZATION', s_name, round(least(1.0::DOUBLE, abs(s_acctbal) / 10000.0), 4) FROM supplier)"""


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("entity_type = 'LOCATION'")


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier edges, weighted by lines."""
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"), "weight")


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region: a fixed partition."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").cast("long").alias("community"))


COMMUNITIES_SQL = "c AS (SELECT 'N' || n_nationkey AS id, n_regionkey::BIGINT AS community FROM nation)"


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part edges."""
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return e.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"))


SUPPLIES_SQL = "e AS (SELECT DISTINCT 'S' || l_suppkey AS source, 'P' || l_partkey AS target FROM lineitem)"


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as security events."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    typed = F.when((kind == "error") & (k % 4 == 0), "sudo_auth_fail").when(kind == "error", "ssh_auth_fail").when(kind == "signup", "ssh_invalid_user").when(kind == "click", "ssh_auth_success").when(kind == "view", "sudo_command").otherwise("network_flow")
    status = F.when(kind.isin("error", "signup"), "failed").otherwise("success")
    buys = kind == "purchase"
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), typed.alias("event_type"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("src_ip"),
        F.when(buys, F.concat(F.lit("192.0.2."), (k % 50).cast("string"))).alias("dst_ip"), (1000 + k).alias("src_port"), F.when(buys, k).alias("dst_port"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), status.alias("status"), F.when(buys, F.floor(F.col("value") * 100000)).otherwise(0).cast("long").alias("bytes_sent"),
        F.when(buys, F.floor(F.col("value") * 1000)).otherwise(0).cast("long").alias("bytes_recv"), F.col("value").alias("duration"),
    )


EVENTS_SQL = """ev AS (SELECT event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'sudo_auth_fail' WHEN event_type = 'error' THEN 'ssh_auth_fail' WHEN event_type = 'signup' THEN 'ssh_invalid_user' WHEN event_type = 'click' THEN 'ssh_auth_success' WHEN event_type = 'view' THEN 'sudo_command' ELSE 'network_flow' END AS event_type,
  '10.0.0.' || (user_id % 7) AS src_ip, CASE WHEN event_type = 'purchase' THEN '192.0.2.' || (k % 50) END AS dst_ip, 1000 + k AS src_port, CASE WHEN event_type = 'purchase' THEN k END AS dst_port, 'u' || user_id AS "user",
  CASE WHEN event_type IN ('error', 'signup') THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_type = 'purchase' THEN floor(value * 100000)::BIGINT ELSE 0 END AS bytes_sent,
  CASE WHEN event_type = 'purchase' THEN floor(value * 1000)::BIGINT ELSE 0 END AS bytes_recv, value AS duration FROM (SELECT *, (props::JSON->>'k')::INT AS k FROM events))"""

WIDTH_S, STEP_S = 6 * 3600, 3 * 3600

WINDOWS_SQL = EVENTS_SQL + f""", f AS (SELECT min(us) AS first_us FROM ev),
w AS (SELECT ev.*, unnest(range(greatest(0, ceil((us - first_us - {WIDTH_S}000000) / {STEP_S}000000.0)::BIGINT), floor((us - first_us) / {STEP_S}000000.0)::BIGINT + 1)) AS k, src_ip AS entity FROM ev, f)"""


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a timeline of five files, one an event type, whose clocks jump back twice."""
    from pyspark.sql import Window

    action = F.when(F.col("event_type") == "error", "SSH_LOGIN_FAILED").when(F.col("event_type") == "signup", "INVALID_USER").when(F.col("event_type") == "click", "SSH_LOGIN_SUCCESS").when(F.col("event_type") == "view", "SUDO_COMMAND").otherwise("AUTH_EVENT")
    severity = F.when(F.col("event_type") == "error", "WARNING").when(F.col("event_type") == "signup", "ERROR").when(F.col("event_type") == "click", "NOTICE").otherwise("INFO")
    line = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("event_id") % 3, "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.concat("event_type", F.lit(".log")).alias("source_file"), line.alias("line_number"), F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("client_ip"),
        action.alias("action"), severity.alias("severity"), F.col("props").alias("message"), F.concat_ws(" ", "event_type", "props").alias("raw_log"),
    )


TIMELINE_SQL = """tl AS (SELECT epoch_us(ts) AS us, event_type || '.log' AS source_file, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 3, event_id) AS line_number, event_id::VARCHAR AS event_id,
  'h' || (user_id % 3) AS host, 'u' || user_id AS "user", '10.0.0.' || (user_id % 7) AS client_ip,
  CASE event_type WHEN 'error' THEN 'SSH_LOGIN_FAILED' WHEN 'signup' THEN 'INVALID_USER' WHEN 'click' THEN 'SSH_LOGIN_SUCCESS' WHEN 'view' THEN 'SUDO_COMMAND' ELSE 'AUTH_EVENT' END AS action,
  CASE event_type WHEN 'error' THEN 'WARNING' WHEN 'signup' THEN 'ERROR' WHEN 'click' THEN 'NOTICE' ELSE 'INFO' END AS severity, props AS message, event_type || ' ' || props AS raw_log FROM events)"""
