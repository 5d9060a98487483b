"""All queries over the reference's own operators, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import lateral
from tracelake.functions import normalize as N
from tracelake.operators import binary, carving, casesql, custody, graph, threats, timeline
from tracelake.plans import inputs as I
from tracelake.sinks import reports
from tracelake.sources import logs, ranges
from tracelake.tables import Tables, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# graph


@query(f"""WITH {I.TRANSFERS_SQL}, i AS (SELECT target AS id, count(*) AS n_in, sum(amount) AS a FROM t GROUP BY target), o AS (SELECT source AS id, count(*) AS n_out, sum(amount) AS b FROM t GROUP BY source),
x AS (SELECT *, abs(a - b) / greatest(a, b) AS r FROM i JOIN o USING (id) WHERE n_in >= 3 AND n_out >= 3)
SELECT id, n_in, n_out, round(a, 2) AS total_in, round(b, 2) AS total_out, round(r, 6) AS ratio, round((1 - r) * least(1.0::DOUBLE, (n_in + n_out) / 10.0), 6) AS velocity,
CASE WHEN r <= 0.05 AND n_in + n_out >= 6 THEN 'CRITICAL' WHEN r <= 0.15 THEN 'HIGH' WHEN r <= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x WHERE r <= 0.6""")
def mule_accounts(spark, d):
    return graph.mule_accounts(I.transfers(spark, d), 3, 0.6)


def _fan(hub: str, spoke: str, kind: str) -> str:
    return f"SELECT '{kind}' AS kind, {hub} AS hub, count(DISTINCT {spoke}) AS n_spokes, count(*) AS n_tx, round(sum(amount), 2) AS volume, round(sum(amount) / count(*), 6) AS average FROM s GROUP BY {hub} HAVING count(DISTINCT {spoke}) >= 4"


@query(f"WITH {I.ALL_SQL} {_fan('target', 'source', 'FAN_IN')} UNION ALL {_fan('source', 'target', 'FAN_OUT')}")
def smurfing_patterns(spark, d):
    return graph.smurfing_patterns(I.all_transfers(spark, d), 4)


@query(f"WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL} SELECT id, round(coalesce(i, 0) / 24.0, 6) AS in_degree, round(coalesce(o, 0) / 24.0, 6) AS out_degree, round((coalesce(i, 0) + coalesce(o, 0)) / 24.0, 6) AS degree FROM c LEFT JOIN (SELECT target AS id, count(*) AS i FROM s GROUP BY target) USING (id) LEFT JOIN (SELECT source AS id, count(*) AS o FROM s GROUP BY source) USING (id)")
def degree_centrality(spark, d):
    got = graph.degree_centrality(I.nation_nodes(spark, d), I.all_transfers(spark, d))
    return got.select("id", *(F.round(c, 6).alias(c) for c in ("in_degree", "out_degree", "degree")))


@query(f"WITH {I.SUPPLIES_SQL}, p AS (SELECT a.source AS source, b.source AS target, count(*) AS weight FROM e a JOIN e b ON a.target = b.target AND a.source <> b.source GROUP BY ALL) SELECT * FROM p")
def bipartite_projection(spark, d):
    e = I.supplies(spark, d)
    return graph.project_bipartite(e, e.select(F.col("source").alias("id")).distinct())


@query(f"WITH {I.ALL_SQL}, b AS (SELECT source AS a, target AS z FROM s UNION SELECT target, source FROM s), r1 AS (SELECT 'N3' AS id UNION SELECT z FROM b WHERE a = 'N3'), r2 AS (SELECT id FROM r1 UNION SELECT z FROM b WHERE a IN (SELECT id FROM r1)) SELECT source, target, amount FROM s WHERE source IN (SELECT id FROM r2) AND target IN (SELECT id FROM r2)")
def ego_graph_r2(spark, d):
    return graph.ego_graph(I.all_transfers(spark, d), "N3", 2)[1].select("source", "target", "amount")


@query("SELECT true AS supplies, false AS transfers")
def is_bipartite(spark, d):
    a, b = graph.is_bipartite(I.supplies(spark, d)), graph.is_bipartite(I.transfers(spark, d))
    return spark.range(1).select(F.lit(a).alias("supplies"), F.lit(b).alias("transfers"))


@query("SELECT 'C' || c_custkey AS source, 'N' || c_nationkey AS target FROM customer")
def subgraph_entity(spark, d):
    edges = I.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("target"))
    more = I.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    return graph.subgraph_by_entity_types(I.nodes(spark, d), edges.union(more), ["PERSON", "LOCATION"])[1]


@query(f"WITH {I.TRANSFERS_SQL} SELECT source, target, amount FROM t WHERE seq % 3 = 0")
def subgraph_relation(spark, d):
    e = I.transfers(spark, d).withColumn("relation_type", F.when(F.col("seq") % 3 == 0, "TRANSACTION").otherwise("CALL"))
    return graph.subgraph_by_relation_types(e, ["TRANSACTION", "TRANSFER"]).select("source", "target", "amount")


@query(f"WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL} SELECT source, target, a.community AS source_community, b.community AS target_community, amount FROM s JOIN c a ON a.id = source JOIN c b ON b.id = target WHERE a.community <> b.community")
def inter_community_links(spark, d):
    return graph.inter_community_links(I.all_transfers(spark, d), I.communities(spark, d))


@query(f"WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL}, b AS (SELECT source AS id, target AS other FROM s UNION SELECT target, source FROM s UNION SELECT source, source FROM s UNION SELECT target, target FROM s) SELECT b.id, count(DISTINCT community) AS span FROM b JOIN c ON c.id = other GROUP BY b.id HAVING count(DISTINCT community) > 1")
def cross_community_brokers(spark, d):
    return graph.community_brokers(I.all_transfers(spark, d), I.communities(spark, d))


@query(f"""WITH RECURSIVE {I.ALL_SQL}, p AS (SELECT source AS st, target AS en, [source, target] AS path, [amount] AS am FROM s WHERE target > source
UNION ALL SELECT st, s.target, list_append(path, s.target), list_append(am, s.amount) FROM p JOIN s ON s.source = en AND s.target > st AND NOT list_contains(path, s.target) WHERE len(path) < 4),
r AS (SELECT path, list_append(am, s.amount) AS am FROM p JOIN s ON s.source = en AND s.target = st WHERE len(path) >= 3)
SELECT len(path)::BIGINT AS length, array_to_string(path, '>') AS ring, round(list_sum(am), 2) AS total, round(list_min(am), 2) AS least, round(list_max(am), 2) AS most, round((round(list_sum(am), 2) / len(am))::DECIMAL(24, 4), 2)::DOUBLE AS average FROM r""")
def circular_transfers(spark, d):
    return graph.circular_transfers(I.all_transfers(spark, d), 3, 4)


_UNDIRECTED = "u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, arg_max(weight, seq) AS w FROM s GROUP BY ALL)"


@query(f"""WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL}, {_UNDIRECTED}, p AS (SELECT w, x.community AS ca, y.community AS cb FROM u JOIN c x ON x.id = a JOIN c y ON y.id = b), m AS (SELECT sum(w) AS m FROM p),
i AS (SELECT ca AS c, sum(w) AS l FROM p WHERE ca = cb GROUP BY ca), e AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, w FROM p UNION ALL SELECT cb, w FROM p) GROUP BY c)
SELECT round(sum(coalesce(l, 0) / m - pow(k / (2 * m), 2)), 6) AS modularity FROM e LEFT JOIN i USING (c), m""")
def modularity_fixed_partition(spark, d):
    return graph.modularity(I.all_transfers(spark, d), I.communities(spark, d)).select(F.round("modularity", 6).alias("modularity"))


@query(f"""WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL}, {_UNDIRECTED}, p AS (SELECT w, x.community AS ca FROM u JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.community = y.community AND a <> b)
SELECT community, n AS size, coalesce(e, 0) AS n_edges, CASE WHEN n > 1 THEN round(2 * coalesce(e, 0) / (n * (n - 1)), 6) ELSE 0.0 END AS density, coalesce(w, 0.0::DOUBLE) AS weight FROM (SELECT community, count(*) AS n FROM c GROUP BY community) LEFT JOIN (SELECT ca AS community, count(*) AS e, sum(w) AS w FROM p GROUP BY ca) USING (community)""")
def criminal_cells(spark, d):
    return graph.cells(I.nation_nodes(spark, d), I.all_transfers(spark, d), I.communities(spark, d)).withColumn("density", F.round("density", 6))


@query(f"""WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL}, {_UNDIRECTED}, p AS (SELECT x.community, unnest([a, b]) AS id FROM u JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.community = y.community AND a <> b)
SELECT * FROM (SELECT community, id, count(*) AS degree, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, id) AS rank FROM p GROUP BY community, id) WHERE rank <= 3""")
def cell_leaders(spark, d):
    return graph.cell_leaders(I.all_transfers(spark, d), I.communities(spark, d))


_PR = ", ".join(f"p{i} AS (SELECT o.id, 0.85 * (coalesce(sum(p.r * s.weight / g.w), 0) + (SELECT coalesce(sum(r), 0) FROM p{i - 1} WHERE id NOT IN (SELECT source FROM g)) / 25.0) + 0.15 / 25.0 AS r FROM c o LEFT JOIN s ON s.target = o.id LEFT JOIN g ON g.source = s.source LEFT JOIN p{i - 1} p ON p.id = s.source GROUP BY o.id)" for i in range(1, 11))


@query(f"WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL}, g AS (SELECT source, sum(weight) AS w FROM s GROUP BY source), p0 AS (SELECT id, 1.0::DOUBLE / 25 AS r FROM c), {_PR} SELECT id, round(r, 8) AS rank FROM p10")
def pagerank_10_iters(spark, d):
    return graph.pagerank(I.nation_nodes(spark, d), I.all_transfers(spark, d), iterations=10, tolerance=None).select("id", F.round("rank", 8).alias("rank"))


@query(f"""WITH RECURSIVE {I.ALL_SQL}, {I.COMMUNITIES_SQL}, q AS (SELECT id AS o, id AS v, 0 AS h FROM c UNION SELECT o, s.source, h + 1 FROM q JOIN s ON s.target = v WHERE h < 25),
m AS (SELECT o, v, min(h) AS h FROM q GROUP BY o, v) SELECT o AS id, round(CASE WHEN sum(h) > 0 THEN (count(*) - 1)::DOUBLE / sum(h) * ((count(*) - 1) / 24.0) ELSE 0.0 END, 8) AS closeness FROM m GROUP BY o""")
def closeness_centrality(spark, d):
    return graph.closeness(I.nation_nodes(spark, d), I.all_transfers(spark, d)).select("id", F.round("closeness", 8).alias("closeness"))


# shortest paths of up to 4 hops between nations: q pairs by hops, m the least, g1 to g4 how many paths
_PATHS = ("q AS (SELECT id AS o, id AS v, 0 AS h FROM c UNION SELECT o, s.target, h + 1 FROM q JOIN s ON s.source = v WHERE h < 4), m AS (SELECT o, v, min(h) AS h FROM q GROUP BY o, v), g0 AS (SELECT o, v, h, 1.0::DOUBLE AS n FROM m WHERE h = 0), "
  + ", ".join(f"g{i} AS (SELECT m.o, m.v, m.h, sum(g.n) AS n FROM m JOIN s ON s.target = m.v JOIN g{i - 1} g ON g.o = m.o AND g.v = s.source WHERE m.h = {i} GROUP BY ALL)" for i in range(1, 5))
  + ", g AS (" + " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(5)) + """), bw AS (SELECT c.id, coalesce(b, 0.0::DOUBLE) / (24 * 23) AS betweenness FROM c LEFT JOIN (SELECT x.v AS id, sum(x.n * y.n / z.n) AS b FROM g x JOIN g y ON y.o = x.v JOIN g z ON z.o = x.o AND z.v = y.v AND z.h = x.h + y.h WHERE x.o <> x.v AND y.v <> x.v GROUP BY x.v) USING (id))""")
# PageRank to its fixed point, within rounding
_PR_END = _PR + ", " + ", ".join(f"p{i} AS (SELECT o.id, 0.85 * (coalesce(sum(p.r * s.weight / g.w), 0) + (SELECT coalesce(sum(r), 0) FROM p{i - 1} WHERE id NOT IN (SELECT source FROM k)) / 25.0) + 0.15 / 25.0 AS r FROM c o LEFT JOIN s ON s.target = o.id LEFT JOIN k g ON g.source = s.source LEFT JOIN p{i - 1} p ON p.id = s.source GROUP BY o.id)" for i in range(11, 41))
_PR_END = "k AS (SELECT source, sum(weight) AS w FROM s GROUP BY source), " + _PR_END.replace("FROM g)", "FROM k)").replace("LEFT JOIN g ON g.source", "LEFT JOIN k g ON g.source")
_DEGREES = "dg AS (SELECT id, (coalesce(i, 0) + coalesce(o, 0)) / 24.0 AS degree FROM c LEFT JOIN (SELECT target AS id, count(*) AS i FROM s GROUP BY target) USING (id) LEFT JOIN (SELECT source AS id, count(*) AS o FROM s GROUP BY source) USING (id))"
_SCORES = f"WITH RECURSIVE {I.ALL_SQL}, {I.COMMUNITIES_SQL}, {_PATHS}, p0 AS (SELECT id, 1.0::DOUBLE / 25 AS r FROM c), {_PR_END}, {_DEGREES}"


@query(f"WITH RECURSIVE {I.ALL_SQL}, {I.COMMUNITIES_SQL}, {_PATHS} SELECT id, round(betweenness, 8) AS betweenness FROM bw")
def betweenness_centrality(spark, d):
    return graph.betweenness(I.nation_nodes(spark, d), I.all_transfers(spark, d)).select("id", F.round("betweenness", 8).alias("betweenness"))


@query()
def louvain_communities(spark, d):
    return graph.louvain(I.nation_nodes(spark, d), I.all_transfers(spark, d))


@query(f"""WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL}, {_UNDIRECTED}, p AS (SELECT w, x.community AS ca, y.community AS cb FROM u JOIN c x ON x.id = a JOIN c y ON y.id = b), m AS (SELECT sum(w) AS m FROM p),
i AS (SELECT ca AS c, sum(w) AS l FROM p WHERE ca = cb GROUP BY ca), e AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, w FROM p UNION ALL SELECT cb, w FROM p) GROUP BY c)
SELECT round(sum(coalesce(l, 0) / m - pow(k / (2 * m), 2)), 6) AS regions, true AS not_worse, true AS never_falls FROM e LEFT JOIN i USING (c), m""")
def louvain_quality(spark, d):
    """Modularity of the regions (in SQL as well); that Louvain's communities aren't worse, and that no round lost."""
    e = I.all_transfers(spark, d).checkpoint()
    regions = graph.modularity(e, I.communities(spark, d))
    place, history = graph.louvain_rounds(I.nation_nodes(spark, d), e)
    own = graph.modularity(e, place).select(F.col("modularity").alias("own"))
    values = [q for *_, q in history]
    rises = all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False))
    return regions.crossJoin(own).select(F.round("modularity", 6).alias("regions"), (F.col("own") >= F.col("modularity")).alias("not_worse"), F.lit(rises).alias("never_falls"))  # a row each


@query(f"""WITH e AS (SELECT 'C' || o_custkey AS source, 'S' || l_suppkey AS target, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey)
SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT sum(weight) FROM e) AS weight, true AS positive""")
def louvain_customers_suppliers(spark, d):
    """Communities of all customers and suppliers, as what SQL can tell of them: nodes, edges, weight, and modularity over 0."""
    e = Tables(spark).put("links", I.trade_links(spark, d)).withColumn("seq", F.lit(0))
    place, history = graph.louvain_rounds(I.nodes(spark, d).where("entity_type <> 'LOCATION'"), e)
    return place.agg(F.count("*").alias("n_nodes")).crossJoin(e.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))).withColumn("positive", F.lit(history[-1][2] > 0))  # a row each


@query(f"""{_SCORES}, x AS (SELECT n.id, risk_score, p.r, bw.betweenness AS b, dg.degree AS d FROM (SELECT id, 0.5::DOUBLE AS risk_score FROM c) n JOIN p40 p USING (id) JOIN bw USING (id) JOIN dg USING (id)), y AS (SELECT max(r) AS mr, max(b) AS mb, max(d) AS md FROM x)
SELECT id, round(0.35 * r / mr + CASE WHEN mb > 0 THEN 0.25 * b / mb ELSE 0 END + 0.2 * d / md + 0.2 * risk_score, 4) AS risk FROM x, y""")
def composite_risk(spark, d):
    n, e = I.nation_nodes(spark, d), I.all_transfers(spark, d).checkpoint()
    return graph.composite_risk(n, graph.pagerank(n, e, tolerance=1e-12), graph.betweenness(n, e), graph.degree_centrality(n, e))


@query(f"""WITH RECURSIVE {I.TRANSFERS_SQL}, s AS (SELECT source, target, amount FROM t WHERE source <> target), p AS (SELECT source AS st, target AS en, [source, target] AS path, amount AS total FROM s WHERE target > source
UNION ALL SELECT st, s.target, list_append(path, s.target), total + s.amount FROM p JOIN s ON s.source = en AND s.target > st AND NOT list_contains(path, s.target) WHERE len(path) < 4),
r AS (SELECT total + s.amount AS total FROM p JOIN s ON s.source = en AND s.target = st WHERE len(path) >= 3),
i AS (SELECT target AS id, count(*) AS n_in, sum(amount) AS a FROM s GROUP BY target), o AS (SELECT source AS id, count(*) AS n_out, sum(amount) AS b FROM s GROUP BY source),
x AS (SELECT *, abs(a - b) / greatest(a, b) AS r FROM i JOIN o USING (id) WHERE n_in >= 2 AND n_out >= 2), y AS (SELECT * FROM x WHERE r <= 0.25),
f AS (SELECT target FROM s GROUP BY target HAVING count(DISTINCT source) >= 3 UNION ALL SELECT source FROM s GROUP BY source HAVING count(DISTINCT target) >= 3)
SELECT (SELECT count(*) FROM r) AS ring_count, (SELECT count(*) FROM y) AS mule_count, (SELECT count(*) FROM f) AS smurfing_count, (SELECT count(*) FROM y WHERE r <= 0.05 AND n_in + n_out >= 6) AS critical_mules,
round((coalesce((SELECT sum(total) FROM r), 0) + coalesce((SELECT sum(a) FROM y), 0)) / 1e6, 3) AS suspicious_millions""")
def detect_all_summary(spark, d):
    got = graph.detect_all(I.nation_nodes(spark, d), I.all_transfers(spark, d), 3, 4)["summary"]
    return got.select(*got.columns[:-1], F.round(F.col("suspicious_volume") / 1e6, 3).alias("suspicious_millions"))


@query(f"""{_SCORES}, z AS (SELECT 'KINGPIN_CANDIDATE' AS role, id, r AS score FROM p40 UNION ALL SELECT 'BROKER_FACILITATOR', id, betweenness FROM bw UNION ALL SELECT 'OPERATIONAL_HUB', id, degree FROM dg)
SELECT role, id, round(score, 7) AS score FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY round(score, 9) DESC, id) AS k FROM z) WHERE k <= 5""")
def node_roles(spark, d):
    n, e = I.nation_nodes(spark, d), I.all_transfers(spark, d).checkpoint()
    nine = lambda df, c: df.select("id", F.round(c, 9).alias(c))  # noqa: E731  ties are ties in SQL too
    got = graph.roles(nine(graph.pagerank(n, e, tolerance=1e-12), "rank"), nine(graph.betweenness(n, e), "betweenness"), nine(graph.degree_centrality(n, e), "degree"))
    return got.withColumn("score", F.round("score", 7))


_TRADE_SQL = """e AS (SELECT CASE WHEN (o_custkey + l_suppkey) % 2 = 1 THEN 'C' || o_custkey ELSE 'S' || l_suppkey END AS source, CASE WHEN (o_custkey + l_suppkey) % 2 = 1 THEN 'S' || l_suppkey ELSE 'C' || o_custkey END AS target,
count(*)::DOUBLE AS weight, (sum(round(l_extendedprice * 100)::BIGINT) / 100)::DOUBLE AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey HAVING count(*) >= 2)"""


def _repeated_trade(spark, d):
    """Customers and suppliers that traded more than once; money goes to the supplier or comes back, by their keys."""
    o, li = I.table(spark, d, "orders").select("o_orderkey", "o_custkey"), I.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100).alias("amount")).where("weight >= 2")
    c, x = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    there = (F.col("o_custkey") + F.col("l_suppkey")) % 2 == 1
    return pairs.select(F.when(there, c).otherwise(x).alias("source"), F.when(there, x).otherwise(c).alias("target"), "weight", "amount")


@query(f"""WITH RECURSIVE {_TRADE_SQL}, p AS (SELECT source AS st, target AS en, [source, target] AS path, [amount] AS am FROM e WHERE target > source
UNION ALL SELECT st, e.target, list_append(path, e.target), list_append(am, e.amount) FROM p JOIN e ON e.source = en AND e.target > st AND NOT list_contains(path, e.target) WHERE len(path) < 4),
r AS (SELECT path, list_append(am, e.amount) AS am FROM p JOIN e ON e.source = en AND e.target = st WHERE len(path) >= 3)
SELECT len(path)::BIGINT AS length, array_to_string(path, '>') AS ring, round(list_sum(am), 2) AS total, round(list_min(am), 2) AS least, round(list_max(am), 2) AS most FROM r""")
def rings_repeated_trade(spark, d):
    return graph.circular_transfers(_repeated_trade(spark, d), 3, 4).drop("average")


@query(f"""WITH RECURSIVE {_TRADE_SQL}, w AS (SELECT source AS o, target AS v FROM e UNION SELECT o, e.target FROM w JOIN e ON e.source = v), c AS (SELECT a.o AS id, least(a.o, min(a.v)) AS component FROM w AS a JOIN w AS b ON b.o = a.v AND b.v = a.o GROUP BY a.o HAVING count(*) > 1)
SELECT component, count(*) AS n FROM c GROUP BY component""")
def strong_components_trade(spark, d):
    return graph.strong_components(_repeated_trade(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@query(f"WITH {I.ALL_SQL}, {I.COMMUNITIES_SQL} SELECT count(*) AS n_edges, round(sum(amount) / 1e6, 3) AS millions FROM s JOIN c a ON a.id = source JOIN c b ON b.id = target WHERE a.community <> b.community")
def inter_community_sums(spark, d):
    got = graph.inter_community_summary(graph.inter_community_links(I.all_transfers(spark, d), I.communities(spark, d)))
    return got.select("n_edges", F.round(F.col("volume") / 1e6, 3).alias("millions"))


@query(f"WITH {I.NODES_SQL}, m AS (SELECT 'N' || n_nationkey AS id, n_regionkey::BIGINT AS community FROM nation UNION ALL SELECT 'C' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'S' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT community, entity_type, count(*) AS n FROM m JOIN n USING (id) GROUP BY ALL")
def cell_types(spark, d):
    n = I.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("community"))
    own = lambda t, p, k, nation: I.table(spark, d, t).join(n, F.col(nation) == F.col("n_nationkey")).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), "community")
    members = I.communities(spark, d).union(own("customer", "C", "c_custkey", "c_nationkey")).union(own("supplier", "S", "s_suppkey", "s_nationkey"))
    return graph.cell_types(I.nodes(spark, d), members)


_LINKS_SQL = "SELECT 'C' || o_custkey AS source, 'S' || l_suppkey AS target, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey"


@query(f"WITH e AS ({_LINKS_SQL}), n AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) - 1 AS n), d AS (SELECT id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT source AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e UNION ALL SELECT 'C' || c_custkey, 0, 0 FROM customer UNION ALL SELECT 'S' || s_suppkey, 0, 0 FROM supplier) GROUP BY id) SELECT id, round(i / n, 10) AS in_degree, round(o / n, 10) AS out_degree FROM d, n")
def degree_customers_suppliers(spark, d):
    got = graph.degree_centrality(I.nodes(spark, d).where("entity_type <> 'LOCATION'"), I.trade_links(spark, d))
    return got.select("id", F.round("in_degree", 10).alias("in_degree"), F.round("out_degree", 10).alias("out_degree"))


_PR_LINKS = ", ".join(f"p{i} AS (SELECT o.id, 0.85 * (coalesce(sum(p.r * e.weight / g.w), 0) + (SELECT coalesce(sum(r), 0) FROM p{i - 1} WHERE id NOT IN (SELECT source FROM g)) / any_value(k)) + 0.15 / any_value(k) AS r FROM o CROSS JOIN k LEFT JOIN e ON e.target = o.id LEFT JOIN g ON g.source = e.source LEFT JOIN p{i - 1} p ON p.id = e.source GROUP BY o.id)" for i in range(1, 6))


@query(f"WITH e AS ({_LINKS_SQL}), o AS (SELECT 'C' || c_custkey AS id FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier), k AS (SELECT count(*)::DOUBLE AS k FROM o), g AS (SELECT source, sum(weight) AS w FROM e GROUP BY source), p0 AS (SELECT id, 1.0::DOUBLE / k AS r FROM o, k), {_PR_LINKS} SELECT id, round(r, 10) AS rank FROM p5")
def pagerank_customers_suppliers(spark, d):
    return graph.pagerank(I.nodes(spark, d).where("entity_type <> 'LOCATION'"), I.trade_links(spark, d), iterations=5, tolerance=None).select("id", F.round("rank", 10).alias("rank"))


@query("""SELECT 'N' || n_nationkey AS id, CASE WHEN n_name LIKE '% %' THEN array_to_string(list_transform(string_split(n_name, ' '), lambda w: CASE WHEN length(w) > 1 THEN w[1] || '***' ELSE '***' END), ' ')
WHEN length(n_name) > 3 THEN n_name[1] || '***' || n_name[-1] ELSE '***' END AS label FROM nation""")
def redact_nodes(spark, d):
    return graph.redact(I.nation_nodes(spark, d)).select("id", "label")


@query(f"WITH {I.NODES_SQL} SELECT id, risk_score FROM n ORDER BY risk_score DESC, id LIMIT 10")
def topk_risk(spark, d):
    return graph.top_k(I.nodes(spark, d).select("id", "risk_score"), "risk_score", 10)


@query("""SELECT 'C' || o_custkey AS source, o_orderstatus AS target, arg_max(o_orderpriority, o_orderkey) AS relation_type, arg_max(o_totalprice, o_orderkey) AS weight,
arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS amount, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey, o_orderstatus""")
def edge_upsert_merge(spark, d):
    o = I.table(spark, d, "orders")
    e = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderstatus").alias("target"), F.col("o_orderpriority").alias("relation_type"), F.col("o_totalprice").alias("weight"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("amount"), F.lit(None).cast("string").alias("timestamp"), F.col("o_orderkey").alias("seq"))
    return graph.upsert_edges(e).drop("timestamp")


@query(f"WITH {I.TRANSFERS_SQL} SELECT least(source, target) AS a, greatest(source, target) AS b, arg_max(weight, seq) AS weight FROM t GROUP BY ALL")
def undirected_collapse(spark, d):
    return graph.undirected(I.transfers(spark, d))


@query("""SELECT c_custkey, CASE WHEN length(trim(c_name)) = 0 THEN '[REDACTED]' WHEN length(c_name) > 3 THEN c_name[1] || '***' || c_name[-1] ELSE '***' END AS name, '[PHONE-***' || right('555' || c_custkey, 4) || ']' AS phone,
CASE WHEN length('ES91' || c_custkey || '00012345') >= 8 THEN left('ES91' || c_custkey || '00012345', 4) || '****' || right('ES91' || c_custkey || '00012345', 4) END AS account, '10.' || (c_nationkey % 250) || '.*.*' AS ip FROM customer""")
def pii_mask(spark, d):
    c = I.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    return c.select("c_custkey", graph.mask_pii(F.col("c_name")).alias("name"), graph.mask_pii(F.concat(F.lit("555"), key), "phone").alias("phone"), graph.mask_pii(F.concat(F.lit("ES91"), key, F.lit("00012345")), "iban").alias("account"), graph.mask_pii(F.concat(F.lit("10."), (F.col("c_nationkey") % 250).cast("string"), F.lit(".1.2")), "ip").alias("ip"))


# threats


@query(f"WITH {I.WINDOWS_SQL} SELECT k, entity, count(*) AS n FROM w GROUP BY k, entity")
def sliding_windows(spark, d):
    return threats.sliding_windows(I.log_events(spark, d), I.WIDTH_S, I.STEP_S).groupBy("k", "entity").agg(F.count("*").alias("n"))


@query(f"""WITH {I.WINDOWS_SQL}, g AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(0.0::DOUBLE, (us - p) / 1e6) END AS gap FROM (SELECT *, lag(us) OVER (PARTITION BY k, entity ORDER BY us, event_id) AS p FROM w)),
v AS (SELECT k, entity, entropy("user") AS user_entropy, max(n) AS max_user_events FROM (SELECT k, entity, "user", count(*) OVER (PARTITION BY k, entity, "user") AS n FROM w) GROUP BY k, entity),
p AS (SELECT k, entity, count(DISTINCT x) AS unique_ports FROM (SELECT k, entity, unnest([src_port, dst_port]) AS x FROM w) WHERE x <> 0 GROUP BY k, entity),
q AS (SELECT k, entity, count(DISTINCT x) AS unique_ips FROM (SELECT k, entity, unnest([src_ip, dst_ip]) AS x FROM w) GROUP BY k, entity),
a AS (SELECT k, entity, count(*) AS event_count, count(*) FILTER (status = 'failed') + count(*) FILTER (event_type = 'ssh_invalid_user') AS failed_auth_count, count(*) FILTER (status <> 'failed') AS success_auth_count,
 count(*) FILTER (event_type = 'ssh_invalid_user') AS invalid_user_count, count(DISTINCT "user") AS unique_users, sum(bytes_sent)::BIGINT AS bytes_sent, sum(bytes_recv)::BIGINT AS bytes_recv, avg(duration) AS mean_duration, stddev_pop(duration) AS std_duration,
 coalesce(avg(gap), 0) AS mean_gap, coalesce(stddev_pop(gap), 0) AS sg, count(*) FILTER (event_type LIKE 'sudo%') AS sudo_count, count(DISTINCT dst_ip) AS unique_dst_ips, greatest((max(us) - min(us)) / 1e6, 1.0::DOUBLE) AS span FROM g GROUP BY k, entity)
SELECT k, entity, event_count, failed_auth_count, success_auth_count, invalid_user_count, unique_users, unique_ips, unique_ports, bytes_sent, bytes_recv, sudo_count, max_user_events, round(event_count / span, 6) AS events_per_second,
round(failed_auth_count / event_count, 6) AS failed_auth_ratio, round((bytes_sent + 1.0) / (bytes_recv + 1.0), 4) AS bytes_ratio, round(mean_duration, 7) AS mean_duration, round(std_duration, 4) AS std_duration, round(user_entropy, 4) AS user_entropy, round(mean_gap, 3) AS mean_gap, round(sg / (mean_gap + 1e-6), 4) AS gap_cv, unique_dst_ips, round(span, 6) AS span_seconds
FROM a JOIN v USING (k, entity) JOIN p USING (k, entity) JOIN q USING (k, entity)""")
def window_features(spark, d):
    f = threats.window_features(threats.sliding_windows(I.log_events(spark, d), I.WIDTH_S, I.STEP_S))
    whole = ("event_count", "failed_auth_count", "success_auth_count", "invalid_user_count", "unique_users", "unique_ips", "unique_ports", "bytes_sent", "bytes_recv", "sudo_count", "max_user_events", "unique_dst_ips")
    places = {"span_seconds": 6, "events_per_second": 6, "failed_auth_ratio": 6, "bytes_ratio": 4, "mean_duration": 7, "std_duration": 4, "user_entropy": 4, "mean_gap": 3, "gap_cv": 4}
    return f.select("k", "entity", *(F.col(c).cast("long").alias(c) for c in whole), *(F.round(c, p).alias(c) for c, p in places.items()))


@query("SELECT event_type, round(entropy(user_id), 6) AS entropy FROM events GROUP BY event_type")
def user_entropy(spark, d):
    return threats.categorical_entropy(I.table(spark, d, "events"), "event_type", "user_id").select("event_type", F.round("entropy", 6).alias("entropy"))


_COUNTS = I.WINDOWS_SQL + """, fu AS (SELECT k, entity, "user", count(*) AS n FROM w WHERE event_type IN ('ssh_auth_fail', 'ssh_invalid_user') GROUP BY ALL), fx AS (SELECT k, entity, count("user") AS u, max(n) AS mx FROM fu GROUP BY k, entity),
rc AS (SELECT w.k, w.entity, count(*) FILTER (event_type IN ('ssh_auth_fail', 'ssh_invalid_user')) AS fails, count(*) FILTER (event_type = 'sudo_auth_fail') AS sf, count(*) FILTER (event_type = 'sudo_command') AS sc,
 sum(bytes_sent)::BIGINT AS sent, sum(bytes_recv)::BIGINT AS recv, count(DISTINCT nullif(dst_port, 0)) AS ports, coalesce(any_value(u), 0) AS u, coalesce(any_value(mx), 0) AS mx FROM w LEFT JOIN fx ON fx.k = w.k AND fx.entity = w.entity GROUP BY w.k, w.entity)"""


def _rule_counts(spark, d):
    return threats.rule_counts(threats.sliding_windows(I.log_events(spark, d), I.WIDTH_S, I.STEP_S))


def _rule(name: str, rule, sql: str):
    def run(spark, d):
        got = _rule_counts(spark, d).withColumn("m", rule()).where("m is not null")
        return got.select("k", "entity", F.col("m.severity").alias("severity"), F.round("m.confidence", 6).alias("confidence"))

    query(f"WITH {_COUNTS} {sql}", name)(run)


_rule("rule_brute_force", threats.brute_force, "SELECT k, entity, CASE WHEN fails >= 20 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(least(0.7 + 0.015 * fails, 0.99)::DOUBLE, 6) AS confidence FROM rc WHERE fails >= 5 AND u <= 3")
_rule("rule_password_spray", threats.password_spraying, "SELECT k, entity, CASE WHEN u >= 15 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(least(0.75 + 0.015 * u, 0.99)::DOUBLE, 6) AS confidence FROM rc WHERE u >= 4 AND NOT (mx > 4 AND u < 8)")
_rule("rule_exfiltration", threats.data_exfiltration, "SELECT k, entity, CASE WHEN sent >= 5e7 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(least(0.80::DOUBLE + sent / 1e8::DOUBLE * 0.15::DOUBLE, 0.98::DOUBLE), 6) AS confidence FROM rc WHERE sent >= 5e6 AND (sent + 1.0) / (recv + 1.0) >= 8")
_rule("rule_priv_esc", threats.privilege_escalation, "SELECT k, entity, CASE WHEN sf >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 0.85::DOUBLE AS confidence FROM rc WHERE sf >= 2 OR (sf >= 1 AND sc >= 3)")
_rule("rule_port_scan", threats.port_scan, "SELECT k, entity, 'MEDIUM' AS severity, 0.8::DOUBLE AS confidence FROM rc WHERE ports >= 8")


_MATCHES = """SELECT k, entity, 'ssh_brute_force' AS rule, CASE WHEN fails >= 20 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, least(0.7 + 0.015 * fails, 0.99)::DOUBLE AS confidence FROM rc WHERE fails >= 5 AND u <= 3
UNION ALL SELECT k, entity, 'password_spraying', CASE WHEN u >= 15 THEN 'CRITICAL' ELSE 'HIGH' END, least(0.75 + 0.015 * u, 0.99)::DOUBLE FROM rc WHERE u >= 4 AND NOT (mx > 4 AND u < 8)
UNION ALL SELECT k, entity, 'data_exfiltration', CASE WHEN sent >= 5e7 THEN 'CRITICAL' ELSE 'HIGH' END, least(0.80::DOUBLE + sent / 1e8::DOUBLE * 0.15::DOUBLE, 0.98::DOUBLE) FROM rc WHERE sent >= 5e6 AND (sent + 1.0) / (recv + 1.0) >= 8
UNION ALL SELECT k, entity, 'privilege_escalation', CASE WHEN sf >= 3 THEN 'HIGH' ELSE 'MEDIUM' END, 0.85::DOUBLE FROM rc WHERE sf >= 2 OR (sf >= 1 AND sc >= 3)
UNION ALL SELECT k, entity, 'port_scan', 'MEDIUM', 0.8::DOUBLE FROM rc WHERE ports >= 8"""


@query(f"""WITH RECURSIVE {_COUNTS}, m AS ({_MATCHES}), x AS (SELECT k, entity, round(max(confidence), 4) AS score, max({{'c': confidence, 'r': rule}}).r AS rule, bool_or(severity = 'CRITICAL') AS c, bool_or(severity = 'HIGH') AS h FROM m GROUP BY k, entity),
n AS (SELECT k, entity, score, rule, CASE WHEN c OR score >= 0.85 THEN 'CRITICAL' WHEN h OR score >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, row_number() OVER (PARTITION BY entity ORDER BY k) AS i FROM x),
r AS (SELECT n.*, k AS last, true AS kept FROM n WHERE i = 1 UNION ALL SELECT n.*, CASE WHEN n.severity = 'CRITICAL' OR n.k - r.last >= 8 THEN n.k ELSE r.last END, n.severity = 'CRITICAL' OR n.k - r.last >= 8 FROM r JOIN n ON n.entity = r.entity AND n.i = r.i + 1)
SELECT k, entity, score, severity, rule FROM r WHERE kept""")
def alerts_cooldown(spark, d):
    # a day, eight steps, so that the cooldown shows on this table
    matched = threats.evaluate_rules(_rule_counts(spark, d)).withColumn("anomaly", F.lit(0.0))
    return threats.cooldown(threats.alerts(matched), 8 * I.STEP_S).select("k", "entity", "score", "severity", "rule")


def _alerts(spark, d):
    return threats.alerts(threats.evaluate_rules(_rule_counts(spark, d)).withColumn("anomaly", F.lit(0.0)))


_ALERTS = f"""{_COUNTS}, m AS ({_MATCHES}), x AS (SELECT m.k, m.entity, round(max(confidence), 4) AS score, max({{'c': confidence, 'r': rule}}).r AS rule, bool_or(severity = 'CRITICAL') AS c, bool_or(severity = 'HIGH') AS h,
 string_agg(rule, ',' ORDER BY list_position(['ssh_brute_force', 'password_spraying', 'data_exfiltration', 'privilege_escalation', 'port_scan'], rule)) AS rules FROM m GROUP BY m.k, m.entity),
al AS (SELECT k, entity, score, rule, rules, first_us + k * {I.STEP_S}000000 AS us, CASE WHEN c OR score >= 0.85 THEN 'CRITICAL' WHEN h OR score >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 'Security Alert: ' || rule || ' detected on entity ' || chr(39) || entity || chr(39) || ' (Threat Score: ' || round(score::DECIMAL(6, 4), 2)::DECIMAL(6, 2) || ')' AS summary FROM x, f)"""


@query(f"WITH {_ALERTS} SELECT k, entity, score, severity, rule, rules, summary FROM al")
def alerts_summary(spark, d):
    return _alerts(spark, d).select("k", "entity", "score", "severity", "rule", F.array_join("rules", ",").alias("rules"), "summary")


@query(f"""WITH {_ALERTS} SELECT k, entity, 'CEF:0|tracelake|detector|1.0|' || severity || '|' || summary || '|' || floor(score * 10)::INT || '|msg=' || summary || ' src=' || entity || ' cat=intrusion cs1Label=Rules cs1=' || rules || ' cfp1Label=ThreatScore cfp1='
|| round(score::DECIMAL(6, 4), 2)::DECIMAL(6, 2) || ' rt=' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 <> 0 THEN '.' || lpad((us % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS line FROM al""")
def alerts_cef(spark, d):
    return _alerts(spark, d).select("k", "entity", reports.cef().alias("line"))


@query(f"WITH {I.EVENTS_SQL} SELECT event_id, count(*) OVER (PARTITION BY \"user\" ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n_buffered FROM ev")
def rolling_buffer(spark, d):
    return threats.rolling_buffer(I.log_events(spark, d), "user", 21600).select("event_id", "n_buffered")


_SCALED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(m, 6) AS center, round(CASE WHEN d > 0 THEN d * 1.4826 WHEN s > 0 THEN s ELSE 1.0 END, 6) AS scale FROM (SELECT median({c}) AS m, stddev_pop({c}) AS s FROM lineitem), (SELECT median(abs({c} - x)) AS d FROM lineitem, (SELECT median({c}) AS x FROM lineitem))" for c in _SCALED))
def robust_scale(spark, d):
    got = threats.robust_scale(I.table(spark, d, "lineitem"), list(_SCALED))
    return got.select("feature", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@query("""WITH x AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM (SELECT value > 50 AS p, event_type = 'purchase' AS a FROM events)),
y AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM x)
SELECT tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM y""")
def confusion_matrix(spark, d):
    e = I.table(spark, d, "events").select((F.col("value") > 50).alias("p"), (F.col("event_type") == "purchase").alias("a"))
    return threats.confusion(e, "p", "a")


@query()
def isolation_scores(spark, d):
    columns = ["event_count", "failed_auth_count", "unique_users", "bytes_sent", "mean_duration", "user_entropy"]
    f = threats.window_features(threats.sliding_windows(I.log_events(spark, d), I.WIDTH_S, I.STEP_S)).select("k", "entity", *columns)
    f = f.checkpoint()
    return threats.score(f, threats.fit_model(f, columns)).select("k", "entity", F.round("isolation", 4).alias("isolation"), F.round("mahalanobis", 4).alias("mahalanobis"), F.round("anomaly", 4).alias("anomaly"))


# timeline


@query(f"""WITH {I.TIMELINE_SQL}, r AS (SELECT *, max({{'us': us, 'f': source_file, 'l': line_number, 'e': event_id}}) OVER (PARTITION BY source_file ORDER BY line_number, event_id ROWS UNBOUNDED PRECEDING) AS m FROM tl)
SELECT event_id, row_number() OVER (ORDER BY m.us, m.f, m.l, m.e, line_number) AS position FROM r""")
def timeline_merge(spark, d):
    return timeline.positions(timeline.merge(I.timeline_events(spark, d)).select("event_id"))


@query(f"WITH {I.TIMELINE_SQL} SELECT event_id, source_file FROM tl WHERE severity IN ('WARNING', 'ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY') AND host IN ('h0', 'h1') AND regexp_matches(message || ' ' || action || ' ' || raw_log, '(?i)failed|invalid')")
def timeline_filter(spark, d):
    return timeline.filter_events(I.timeline_events(spark, d), min_severity="WARNING", hosts=["h0", "h1"], pattern="failed|invalid").select("event_id", "source_file")


@query(f"WITH {I.TIMELINE_SQL}, x AS (SELECT source_file, line_number, us - lag(us) OVER (PARTITION BY source_file ORDER BY line_number) AS delta FROM tl) SELECT source_file, line_number, 'NEGATIVE_JUMP' AS kind, 'CRITICAL' AS severity, delta FROM x WHERE delta < 0")
def clock_jumps(spark, d):
    return timeline.clock_anomalies(I.timeline_events(spark, d)).where("kind = 'NEGATIVE_JUMP'")


@query(f"WITH {I.TIMELINE_SQL}, x AS (SELECT source_file, line_number, us - lag(us) OVER (PARTITION BY source_file ORDER BY line_number) AS delta FROM tl) SELECT source_file, line_number, 'ACTIVITY_GAP' AS kind, 'MEDIUM' AS severity, delta FROM x WHERE delta > 3600000000")
def activity_gaps(spark, d):
    return timeline.clock_anomalies(I.timeline_events(spark, d)).where("kind = 'ACTIVITY_GAP'")


@query(f"WITH {I.TIMELINE_SQL}, x AS (SELECT source_file, line_number, us - lag(us) OVER (PARTITION BY source_file ORDER BY line_number) AS delta FROM tl), y AS (SELECT *, CASE WHEN delta < 0 THEN 'NEGATIVE_JUMP' ELSE 'ACTIVITY_GAP' END AS kind FROM x WHERE delta < 0 OR delta > 3600000000) SELECT substr(sha256(source_file || ':' || line_number || ':' || kind), 1, 12) AS anomaly_id, source_file, line_number, kind FROM y")
def anomaly_ids(spark, d):
    got = timeline.clock_anomalies(I.timeline_events(spark, d))
    return got.select(timeline.anomaly_id("source_file", "line_number", "kind").alias("anomaly_id"), "source_file", "line_number", "kind")


@query(f"WITH {I.TIMELINE_SQL}, n AS (SELECT (max(us) - 86400000000)::BIGINT AS now FROM tl) SELECT source_file, line_number, 'FUTURE_TIMESTAMP' AS kind, 'HIGH' AS severity, us - now AS delta FROM tl, n WHERE us > now + 300000000")
def future_events(spark, d):
    e = I.timeline_events(spark, d)
    return timeline.future_events(e, e.agg(F.max("us")).first()[0] - 86_400_000_000)


_HOURLY = "h AS (SELECT source_file, line_number, floor(us / 86400000000.0)::BIGINT AS s FROM tl)"


@query(f"""WITH {I.TIMELINE_SQL}, {_HOURLY}, c AS (SELECT *, sum(CASE WHEN s = p THEN 0 ELSE 1 END) OVER (PARTITION BY source_file ORDER BY line_number) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY source_file ORDER BY line_number) AS p FROM h))
SELECT source_file, min(line_number) AS line_number, 'EVENT_BURST' AS kind, 'LOW' AS severity, count(*) AS n, min(s) AS second FROM c GROUP BY source_file, run HAVING count(*) > 1""")
def burst_runs(spark, d):
    # days stand in for seconds, since the table holds few events a second
    e = I.timeline_events(spark, d).withColumn("us", F.floor(F.col("us") / 86_400_000_000).cast("long") * 1_000_000)
    return _long(timeline.bursts(e, 1), "second")


@query(f"""WITH {I.TIMELINE_SQL}, x AS (SELECT source_file, us - lag(us) OVER (PARTITION BY source_file ORDER BY line_number) AS delta FROM tl)
SELECT CASE WHEN delta < 0 THEN 'NEGATIVE_JUMP' ELSE 'ACTIVITY_GAP' END AS kind, CASE WHEN delta < 0 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, count(*) AS n, count(DISTINCT source_file) AS n_files FROM x WHERE delta < 0 OR delta > 3600000000 GROUP BY 1, 2""")
def integrity_summary(spark, d):
    return timeline.integrity_summary(timeline.clock_anomalies(I.timeline_events(spark, d)))


@query(f"""WITH {I.TIMELINE_SQL}, x AS (SELECT source_file, us - lag(us) OVER (PARTITION BY source_file ORDER BY line_number) AS delta FROM tl), a AS (SELECT source_file, delta < 0 AS j FROM x WHERE delta < 0 OR delta > 3600000000)
SELECT CASE WHEN count(*) > 0 THEN 'COMPROMISED' ELSE 'CLEAN' END AS status, count(*) AS n_anomalies, count(DISTINCT source_file) AS n_files, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS files,
count(*) FILTER (j) AS critical, count(*) FILTER (NOT j) AS medium, count(*) FILTER (j) AS jumps, count(*) FILTER (NOT j) AS gaps FROM a""")
def integrity_verdict(spark, d):
    got = timeline.integrity_verdict(timeline.clock_anomalies(I.timeline_events(spark, d)))
    of = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0)).cast("long")
    return got.select("status", "n_anomalies", "n_files", F.array_join("files", ",").alias("files"), of("by_severity", "CRITICAL").alias("critical"), of("by_severity", "MEDIUM").alias("medium"), of("by_kind", "NEGATIVE_JUMP").alias("jumps"), of("by_kind", "ACTIVITY_GAP").alias("gaps"))


@query(f"""WITH {I.TIMELINE_SQL}, own AS (SELECT * FROM tl WHERE action IN ('SSH_LOGIN_FAILED', 'SSH_LOGIN_FAILED_INVALID_USER', 'INVALID_USER', 'SSH_LOGIN_SUCCESS')), x AS (SELECT client_ip, count(*) FILTER (action <> 'SSH_LOGIN_SUCCESS') AS failures, count(*) FILTER (action = 'SSH_LOGIN_SUCCESS') AS successes, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events
FROM own GROUP BY client_ip), f AS (SELECT client_ip, string_agg(event_id, ',' ORDER BY place) AS first_events FROM (SELECT client_ip, event_id, row_number() OVER (PARTITION BY client_ip ORDER BY us, action = 'SSH_LOGIN_SUCCESS', event_id) AS place FROM own) WHERE place <= 20 GROUP BY client_ip)
SELECT x.*, CASE WHEN successes > 0 THEN 'BRUTE_FORCE_SUCCESS' ELSE 'BRUTE_FORCE_SCAN' END AS chain, CASE WHEN successes > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, first_events FROM x JOIN f USING (client_ip) WHERE failures >= 3""")
def brute_force_chains(spark, d):
    return timeline.brute_force_chains(I.timeline_events(spark, d)).withColumn("first_events", F.array_join("first_events", ","))


@query(f"""WITH {I.TIMELINE_SQL} SELECT a."user", a.event_id AS login_id, a.us AS login_us, count(*) AS n_sudo, max(b.us) AS end_us FROM tl a JOIN tl b ON a."user" = b."user" AND b.us >= a.us AND b.us - a.us <= 21600000000
WHERE a.action = 'SSH_LOGIN_SUCCESS' AND b.action = 'SUDO_COMMAND' GROUP BY ALL""")
def priv_esc_interval_join(spark, d):
    return timeline.escalation_chains(I.timeline_events(spark, d), 21600)


@query(f"WITH {I.TIMELINE_SQL} SELECT severity, count(*) AS n FROM tl GROUP BY severity")
def severity_histogram(spark, d):
    return I.timeline_events(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


# normalisers and parsers


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARNING' WHEN 4 THEN upper(o_orderstatus) ELSE 'INFO' END AS severity FROM orders""")
def severity_normalize(spark, d):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "err").when(k == 1, " 2 ").when(k == 2, "17").when(k == 3, "Warn").when(k == 4, F.col("o_orderstatus"))
    return I.table(spark, d, "orders").select("o_orderkey", N.normalize_severity(raw).alias("severity"))


@query("SELECT event_id, (epoch_us(ts) // 1000 * 1000)::BIGINT AS us FROM events")
def epoch_normalize(spark, d):
    e = I.table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ms = F.floor(F.col("us") / 1000)
    k = F.col("event_id") % 3
    number = F.when(k == 0, ms.cast("double")).when(k == 1, (ms * 1000).cast("double")).otherwise(ms / 1000)
    return e.select("event_id", N.epoch_us(number).alias("us"))


@query("SELECT o_orderkey, left(sha256('orders.log:' || o_orderkey || ':' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(o_orderdate) % 1000000 <> 0 THEN '.' || lpad((epoch_us(o_orderdate) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00:' || left(o_orderpriority, 256)), 16) AS event_id FROM orders")
def event_id_hash(spark, d):
    o = I.table(spark, d, "orders")
    return o.select("o_orderkey", N.event_id(F.lit("orders.log"), F.col("o_orderkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderpriority")).alias("event_id"))


_AUTH_TEXT = {"error": "Failed password for {u} from {i} port {p} ssh2", "signup": "Invalid user {u} from {i} port {p}", "click": "Accepted publickey for {u} from {i} port {p} ssh2", "view": "{u} : TTY=pts/1 ; PWD=/home ; USER=root ; COMMAND=/bin/ls"}


def _auth_lines(spark, d):
    e = I.table(spark, d, "events")
    k, user = F.get_json_object("props", "$.k"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string"))
    body = F.lit("session opened")
    for kind, text in _AUTH_TEXT.items():
        filled = F.lit(text)
        for mark, value in (("{u}", user), ("{i}", ip), ("{p}", k)):
            filled = F.replace(filled, F.lit(mark), value)
        body = F.when(F.col("event_type") == kind, filled).otherwise(body)
    at = F.date_format(F.col("ts").cast("timestamp"), "MMM dd HH:mm:ss")
    process = F.when(F.col("event_type") == "view", "sudo").otherwise("sshd")
    return e.select("event_id", F.concat(at, F.lit(" gw01 "), process, F.lit("[811]: "), body).alias("value"))


_AUTH_SQL = "(epoch_us(ts) // 1000000)::BIGINT"


@query(f"""SELECT event_id, {_AUTH_SQL} AS second, CASE event_type WHEN 'error' THEN 'SSH_LOGIN_FAILED' WHEN 'signup' THEN 'INVALID_USER' WHEN 'click' THEN 'SSH_LOGIN_SUCCESS' WHEN 'view' THEN 'SUDO_COMMAND' ELSE 'AUTH_EVENT' END AS action,
CASE event_type WHEN 'error' THEN 'WARNING' WHEN 'signup' THEN 'WARNING' WHEN 'click' THEN 'NOTICE' WHEN 'view' THEN 'NOTICE' ELSE 'INFO' END AS severity, CASE WHEN event_type <> 'purchase' THEN 'u' || user_id END AS "user",
CASE WHEN event_type NOT IN ('purchase', 'view') THEN '10.0.0.' || (user_id % 7) END AS client_ip FROM events""")
def auth_roundtrip(spark, d):
    year = I.table(spark, d, "events").agg(F.year(F.min("ts"))).first()[0]
    got = logs.parse_auth(_auth_lines(spark, d), year)
    return got.select("event_id", F.unix_seconds("timestamp").alias("second"), "action", "severity", "user", "client_ip")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'ssh_auth_fail' WHEN 'signup' THEN 'ssh_invalid_user' WHEN 'click' THEN 'ssh_auth_success' WHEN 'view' THEN 'sudo_command' ELSE 'generic_event' END AS event_type,
CASE WHEN event_type NOT IN ('purchase', 'view') THEN '10.0.0.' || (user_id % 7) END AS src_ip, CASE WHEN event_type <> 'purchase' THEN 'u' || user_id END AS "user", CASE WHEN event_type IN ('error', 'signup') THEN 'failed' WHEN event_type IN ('click', 'view') THEN 'success' ELSE 'info' END AS status FROM events""")
def security_parse(spark, d):
    return logs.parse_security(_auth_lines(spark, d), 2024).select("event_id", "event_type", "src_ip", "user", "status")


@query("""SELECT event_id, (epoch_us(ts) // 1000000)::BIGINT AS second, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARNING' ELSE 'INFO' END AS severity, 'HTTP_GET_' || CASE WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 404 ELSE 200 END AS action,
'10.0.0.' || (user_id % 7) AS client_ip, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id END AS "user" FROM events""")
def nginx_roundtrip(spark, d):
    e = I.table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "503").when(F.col("event_type") == "signup", "404").otherwise("200")
    user = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise("-")
    at = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string"), F.lit(" - "), user, F.lit(" ["), at, F.lit(' +0000] "GET /a HTTP/1.1" '), status, F.lit(' 12 "-" "-"'))
    got = logs.parse_nginx(e.select("event_id", line.alias("value")), 2024)
    return got.select("event_id", F.unix_seconds("timestamp").alias("second"), "severity", "action", "client_ip", "user")


@query("SELECT event_id, 'network_flow' AS event_type, '10.0.0.' || (user_id % 7) AS src_ip, (props::JSON->>'k')::INT AS dst_port, floor(value * 1000)::BIGINT AS bytes_sent FROM events")
def json_flow_parse(spark, d):
    e = I.table(spark, d, "events")
    line = F.to_json(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("orig_h"), F.get_json_object("props", "$.k").alias("resp_p"), F.floor(F.col("value") * 1000).alias("orig_bytes")))
    return logs.parse_security(e.select("event_id", line.alias("value")), 2024).select("event_id", "event_type", "src_ip", "dst_port", "bytes_sent")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 24 THEN ['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','security','console','solaris-cron','local0','local1','local2','local3','local4','local5','local6','local7'][n_nationkey + 1] ELSE 'facility_' || n_nationkey END AS facility, ['EMERGENCY','ALERT','CRITICAL','ERROR','WARNING','NOTICE','INFO','DEBUG'][n_nationkey % 8 + 1] AS severity FROM nation")
def syslog_pri(spark, d):
    pri = (F.col("n_nationkey") * 8 + F.col("n_nationkey") % 8).cast("int")
    return I.table(spark, d, "nation").select("n_nationkey", N.facility_of(pri).alias("facility"), N.severity_of(pri).alias("severity"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, d):
    return I.table(spark, d, "pages").select("page_id", N.xml_escape(F.col("html")).alias("escaped"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bBearer\s+[A-Za-z0-9_\-.]{16,}', 'Bearer [REDACTED]', 'g'), '\b(?:sk_[a-zA-Z0-9_\-]{16,}|gh[a-zA-Z0-9]_[a-zA-Z0-9]{20,}|AKIA[0-9A-Z]{16})\b', '[REDACTED]', 'g'), '(?i)\b(password|passwd|pwd|pass|secret|token|api[_-]?key|auth_token)\s*[:=]\s*([^\s;,"''&]+)', '\1=[REDACTED]', 'g') AS clean FROM documents""")
def secret_sanitize(spark, d):
    return I.table(spark, d, "documents").select("doc_id", N.sanitize(F.col("text")).alias("clean"))


@query("SELECT c_custkey, left(c_name, 2) || '***' AS name, regexp_replace('no /srv/' || c_custkey || '/' || c_mktsegment || ' here', '/(?:[a-zA-Z0-9_.-]+/)+[a-zA-Z0-9_.-]+', '[RUTA]', 'g') AS message FROM customer")
def shown_masks(spark, d):
    message = F.concat(F.lit("no /srv/"), F.col("c_custkey").cast("string"), F.lit("/"), "c_mktsegment", F.lit(" here"))
    return I.table(spark, d, "customer").select("c_custkey", N.mask_name(F.col("c_name")).alias("name"), N.hide_paths(message).alias("message"))


def _order_time(pattern: str):
    return F.date_format(F.col("o_orderdate").cast("timestamp"), pattern)


@query("SELECT o_orderkey, k AS kind, epoch(o_orderdate)::BIGINT AS second FROM orders, (VALUES ('iso'), ('bsd'), ('access'), ('error'), ('millis')) AS t(k)")
def time_texts(spark, d):
    """Times of every order in five notations, as texts."""
    millis = (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string")
    texts = {"iso": _order_time("yyyy-MM-dd'T'HH:mm:ssXXX"), "bsd": _order_time("MMM d HH:mm:ss"), "access": _order_time("dd/MMM/yyyy:HH:mm:ss Z"), "error": _order_time("yyyy/MM/dd HH:mm:ss"), "millis": millis}
    rows = I.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in texts.items()))).alias("t"))
    return rows.select("o_orderkey", "t.kind", F.unix_seconds(N.parse_time(F.col("t.text"), F.col("year"))).alias("second"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ssh_auth_fail' ELSE 'network_flow' END AS event_type, 'u' || user_id AS \"user\", round(value, 6) AS duration, event_type AS kind, (props::JSON->>'k') AS k, event_type = 'purchase' AS is_anomaly FROM events")
def security_json(spark, d):
    """Events as JSON lines: durations, and keys without a column of their own, come back."""
    e = I.table(spark, d, "events")
    line = F.to_json(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.col("value").alias("duration"), F.when(F.col("event_type") == "error", "SSH_AUTH_FAIL").otherwise("other").alias("event_type"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("k"), (F.col("event_type") == "purchase").alias("is_anomaly")))
    got = logs.parse_security(e.select("event_id", line.alias("value")), 2024)
    return got.select("event_id", "event_type", "user", F.round("duration", 6).alias("duration"), F.col("metadata")["kind"].alias("kind"), F.col("metadata")["k"].alias("k"), "is_anomaly")


_KEY = "o_orderkey::VARCHAR"


@query(f"""SELECT o_orderkey, (epoch_us(o_orderdate) // 1000000)::BIGINT AS second, CASE WHEN o_orderkey % 2 = 0 THEN 'local4' WHEN o_orderkey % 3 = 0 THEN 'auth' END AS facility, CASE WHEN o_orderkey % 2 = 0 THEN 'NOTICE' WHEN o_orderkey % 3 = 0 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
'h' || (o_orderkey % 5) AS host, 'app' AS process, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 1000)::INT ELSE 77 END AS pid, 'order ' || {_KEY} AS message, CASE WHEN o_orderkey % 2 = 0 THEN {_KEY} END AS key FROM orders""")
def syslog_parse(spark, d):
    key = F.col("o_orderkey").cast("string")
    host = F.concat(F.lit("h"), (F.col("o_orderkey") % 5).cast("string"))
    pid = (F.col("o_orderkey") % 1000).cast("string")
    new = F.concat(F.lit("<165>1 "), _order_time("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), host, F.lit(" app "), pid, F.lit(' ID1 [sd@1 k="old" k="'), key, F.lit('"] order '), key)
    pri = F.when(F.col("o_orderkey") % 3 == 0, "<34>").otherwise("")
    old = F.concat(pri, _order_time("MMM d HH:mm:ss"), F.lit(" "), host, F.lit(" app[77]: order "), key)
    orders = I.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.when(F.col("o_orderkey") % 2 == 0, new).otherwise(old).alias("value"))
    got = logs.parse_syslog(orders, F.col("y"))
    return got.select("o_orderkey", F.unix_seconds("timestamp").alias("second"), "facility", "severity", "host", "process", "pid", "message", F.try_element_at(F.try_element_at("structured", F.lit("sd@1")), F.lit("k")).alias("key"))


@query(f"""SELECT o_orderkey, (epoch_us(o_orderdate) // 1000000)::BIGINT AS second, CASE WHEN o_orderkey % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, CASE WHEN o_orderkey % 2 = 0 THEN 'NGINX_ERROR_ERROR' ELSE 'NGINX_ERROR_WARN' END AS action, 12 AS pid,
'10.0.0.' || (o_custkey % 7) AS client_ip, CASE WHEN o_orderkey % 3 = 0 THEN 'shop' || (o_orderkey % 4) ELSE 'srv' END AS host, 'upstream ' || {_KEY} AS message FROM orders""")
def nginx_error_parse(spark, d):
    level = F.when(F.col("o_orderkey") % 2 == 0, "error").otherwise("warn")
    host = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(', request: "GET / HTTP/1.1", host: "shop'), (F.col("o_orderkey") % 4).cast("string"), F.lit('"'))).otherwise("")
    line = F.concat(_order_time("yyyy/MM/dd HH:mm:ss"), F.lit(" ["), level, F.lit("] 12#0: *3 upstream "), F.col("o_orderkey").cast("string"), F.lit(", client: 10.0.0."), (F.col("o_custkey") % 7).cast("string"), F.lit(", server: srv"), host)
    got = logs.parse_nginx(I.table(spark, d, "orders").select("o_orderkey", line.alias("value")), 2024)
    return got.select("o_orderkey", F.unix_seconds("timestamp").alias("second"), "severity", "action", "pid", "client_ip", "host", "message")


@query(f"""SELECT o_orderkey, (epoch_us(o_orderdate) // 1000000)::BIGINT AS second, CASE WHEN o_orderkey % 3 = 0 THEN 'WARNING' ELSE 'INFO' END AS severity, 'u' || o_custkey AS "user", o_orderstatus AS action, 'order ' || {_KEY} AS message, o_orderpriority AS priority FROM orders""")
def jsonl_parse(spark, d):
    o = F.col("o_orderkey")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    common = (F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("username"), F.col("o_orderstatus").alias("event_type"), F.col("o_orderpriority").alias("priority"))
    text = F.concat(F.lit("order "), o.cast("string"))
    line = F.when(o % 3 == 0, F.to_json(F.struct((at * 1000).alias("ts"), F.lit("warn").alias("level"), text.alias("msg"), *common))).otherwise(F.to_json(F.struct(_order_time("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("@timestamp"), text.alias("message"), *common)))
    got = logs.parse_jsonl(I.table(spark, d, "orders").select("o_orderkey", line.alias("value")), 2024)
    return got.select("o_orderkey", F.unix_seconds("timestamp").alias("second"), "severity", "user", "action", "message", F.try_element_at("metadata", F.lit("priority")).alias("priority"))


# custody


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def doc_sha256(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def _leaves(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return custody.number_leaves(docs, "doc_id").select("doc_id", "idx", "hash")


_LEVEL = "SELECT i // 2 AS i, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(unhex('01') || unhex(max(h) FILTER (i % 2 = 0)) || unhex(max(h) FILTER (i % 2 = 1))) END AS h FROM {} GROUP BY i // 2"


def _tree_sql(rounds: int) -> str:
    return "l0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, sha256(text) AS h FROM documents), " + ", ".join(f"l{k} AS ({_LEVEL.format(f'l{k - 1}')})" for k in range(1, rounds + 1))


@query(f"WITH {_tree_sql(24)} SELECT h AS root, (SELECT count(*) FROM documents) AS n_leaves FROM l24")
def merkle_root(spark, d):
    return custody.merkle_root(custody.merkle_levels(_leaves(spark, d)))


_PROOF_SQL = f"WITH {_tree_sql(24)} SELECT i AS idx, h AS leaf, (SELECT h FROM l24) AS proof_root, true AS valid FROM l0"


@query(_PROOF_SQL)
def merkle_proof(spark, d):
    leaves = _leaves(spark, d).checkpoint()
    levels = custody.merkle_levels(leaves)
    proofs = custody.merkle_proofs(levels, leaves.select("idx"))
    root = custody.merkle_root(levels).first()["root"]
    got = proofs.select("idx", "leaf", custody.proof_root(F.col("leaf"), F.col("proof")).alias("proof_root"))
    return got.withColumn("valid", F.col("proof_root") == root)


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'TAMPERED' ELSE 'INTACT' END AS status FROM documents")
def custody_audit(spark, d):
    docs = I.table(spark, d, "documents")
    path = F.concat(F.lit("/e/"), F.col("doc_id").cast("string"))
    evidence = docs.select("doc_id", path.alias("source_path"), F.upper(F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)).alias("hash_value"))
    files = docs.where("doc_id % 10 <> 0").select(path.alias("path"), F.sha2("text", 256).alias("sha256"))
    return custody.audit(evidence, files).select("doc_id", "status")


@query("SELECT count(*) AS n_items, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 <> 0) AS n_intact, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 = 0) AS n_tampered, count(*) FILTER (doc_id % 10 = 0) AS n_missing, true AS root_matches, 'COMPROMISED' AS verdict FROM documents")
def custody_verdict(spark, d):
    return custody.audit_verdict(custody_audit(spark, d), "AB" * 32, "ab" * 32)


# binary


def _blobs(spark, d):
    return I.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))


_BYTES = "y AS (SELECT doc_id::VARCHAR AS path, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents WHERE text IS NOT NULL)"
_CLASS = "CASE WHEN e < 0.2 THEN 'EMPTY' WHEN e < 4.5 THEN 'LOW' WHEN e < 7.2 THEN 'MEDIUM' ELSE 'HIGH' END AS class"


def _blocks_sql(size: int) -> str:
    return f"z AS (SELECT path, i AS block, coalesce(list_aggregate(b[i * {size} + 1:(i + 1) * {size}], 'entropy'), 0.0) AS e FROM (SELECT path, b, unnest(range((len(b) + {size - 1}) // {size})) AS i FROM y))"


@query(f"WITH {_BYTES}, c AS (SELECT x, count(*) AS n FROM (SELECT unnest(b) AS x FROM y) GROUP BY x) SELECT range AS byte, coalesce(n, 0)::BIGINT AS n FROM range(256) LEFT JOIN c ON c.x = printf('%02X', range)")
def byte_histogram(spark, d):
    return binary.byte_histogram(_blobs(spark, d))


@query(f"WITH {_BYTES}, {_blocks_sql(1024)} SELECT path, count(*) AS n_blocks, round(avg(e), 4) AS mean, round(min(e), 4) AS least, round(max(e), 4) AS most FROM z GROUP BY path")
def doc_entropy(spark, d):
    return binary.entropy_map(binary.block_entropy(binary.blocks(_blobs(spark, d), 1024)))


@query(f"""WITH {_BYTES}, o AS (SELECT path, b, unnest(list_sort(list_distinct(CASE WHEN len(b) <= 1024 THEN [0] ELSE list_append(range(0, len(b) - 1023, 512), len(b) - 1024) END))) AS a FROM y),
z AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY a) - 1)::BIGINT AS block, a::BIGINT AS "offset", coalesce(list_aggregate(b[a + 1:a + 1024], 'entropy'), 0.0) AS e FROM o)
SELECT path, block, "offset", round(e, 4) AS entropy, {_CLASS} FROM z""")
def entropy_windows(spark, d):
    rows = binary.block_entropy(binary.blocks(_blobs(spark, d), 1024, 512))
    return rows.select("path", "block", "offset", F.round("entropy", 4).alias("entropy"), "class")


@query(f"WITH {_BYTES}, {_blocks_sql(1024)} SELECT path, block::BIGINT AS block, round(e, 4) AS entropy, {_CLASS} FROM z")
def entropy_blocks(spark, d):
    rows = binary.block_entropy(binary.blocks(_blobs(spark, d), 1024))
    return rows.select("path", "block", F.round("entropy", 4).alias("entropy"), "class")


@query(f"""WITH {_BYTES}, {_blocks_sql(256)}, h AS (SELECT path, block, block - row_number() OVER (PARTITION BY path ORDER BY block) AS run FROM z WHERE e >= 4.2)
SELECT path, min(block)::BIGINT AS first, max(block)::BIGINT AS last, count(*) AS n FROM h GROUP BY path, run HAVING count(*) >= 2""")
def entropy_regions(spark, d):
    return binary.high_entropy_regions(binary.block_entropy(binary.blocks(_blobs(spark, d), 256)), 4.2, 2)


_PNG = "89504E470D0A1A0A0000000D49484452000000010000000108060000001F15C489" + "0000000049454E44AE426082"


def _format_cases(blobs):
    """A valid and a broken file of each format, (path, format, content), made from every blob."""

    def run(batches):
        import gzip
        import io
        import tarfile
        import zipfile

        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, d in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                d = d or b""
                packed, bundled = io.BytesIO(), io.BytesIO()
                with zipfile.ZipFile(packed, "w") as z:
                    z.writestr("a", d)
                with tarfile.open(fileobj=bundled, mode="w") as t:
                    info = tarfile.TarInfo("a")
                    info.size = len(d)
                    t.addfile(info, io.BytesIO(d))
                png, gz, pe = bytes.fromhex(_PNG), gzip.compress(d, mtime=0), b"MZ" + bytes(58) + b"\x40\0\0\0"
                cases = {
                    "ZIP": (packed.getvalue(), packed.getvalue()[:-10]), "TAR": (bundled.getvalue(), b"x" * 600), "PNG": (png, png[:-12]), "JPEG": (b"\xff\xd8\xff\xe0" + d + b"\xff\xd9", b"\xff\xd8\xff\xe0" + d),
                    "PDF": (b"%PDF-1.4\n" + d + b"\n%%EOF\n", b"%PDF-1.4\n" + d.replace(b"%%EOF", b"")), "ELF": (b"\x7fELF\x02\x01\x01" + bytes(57), b"\x7fELF\x02\x01\x01"), "PE": (pe + b"PE\0\0" + bytes(20), pe), "GZIP": (gz, gz[:-6]),
                }
                rows += [(f"{path}/{what}", kind, c) for kind, pair in cases.items() for what, c in zip(("valid", "broken"), pair, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["path", "format", "content"])

    return blobs.select("path", "content").mapInArrow(run, "path string, format string, content binary")


#: What each case comes to: everything valid is clean, and what is broken says how.
_FORMAT_SQL = ", ".join(
    f"('{what}', '{kind}', {valid}, {score}::DOUBLE, '{note}')"
    for kind, fault in (("ZIP", "BadZipFile"), ("TAR", "ReadError"), ("PNG", "no end"), ("JPEG", "no end"), ("PDF", "no end"), ("ELF", "no header"), ("PE", "header outside"), ("GZIP", "EOFError"))
    for what, valid, score, note in (("valid", "true", 0.0, ""), ("broken", "false", 0.5, fault))
)


@query(f"SELECT doc_id || '/' || c.what AS path, c.format, c.valid, c.anomaly, CASE WHEN c.format = 'PDF' AND c.what = 'broken' AND octet_length(encode(coalesce(text, ''))) < 7 THEN 'no header' ELSE c.note END AS note FROM documents, (VALUES {_FORMAT_SQL}) AS c(what, format, valid, anomaly, note)")
def validate_formats(spark, d):
    return binary.validate_formats(_format_cases(_blobs(spark, d)))


_JPEG = "FFD8FFE000104A464946FFD9"
#: A PNG and a JPEG behind and before each text, which are taken as overlays; empty texts leave nothing behind the JPEG.
_CARVED_SQL = f"""i AS (SELECT doc_id::VARCHAR AS path, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT path, n AS "offset", {len(_PNG) // 2} AS size, 'PNG' AS format, sha256(unhex('{_PNG}')) AS sha256, true AS valid, 0.3::DOUBLE AS anomaly FROM i
UNION ALL SELECT path, n + {len(_PNG) // 2 + 32}, {len(_JPEG) // 2}, 'JPEG', sha256(unhex('{_JPEG}')), true, CASE WHEN n > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END FROM i)"""


def _images(spark, d):
    pad = F.col("content")
    return _blobs(spark, d).select("path", F.concat(pad, F.unhex(F.lit(_PNG)), F.unhex(F.lit("AA" * 32)), F.unhex(F.lit(_JPEG)), pad).alias("content"))


@query(f"WITH {_CARVED_SQL} SELECT * FROM r")
def carve_scan(spark, d):
    return _long(binary.carve(_images(spark, d)).select("path", "offset", "size", "format", "sha256", "valid", "anomaly"), "offset", "size")


@query(f"WITH {_CARVED_SQL} SELECT * FROM r")
def carve_files(spark, d):
    """The same images as files in the shared folder, carved by ranges."""
    folder = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    images = _images(spark, d).where("content is not null")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with files.open_output_stream(f"{root}/{name}") as f:
                    f.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["done"])

    images.mapInArrow(write, "done int").count()
    got = carving.carve_files(spark, folder)
    return got.select(F.element_at(F.split("path", "/"), -1).alias("path"), "offset", "size", "format", "sha256", "valid", "anomaly")


@query("SELECT e.event_id, x.element, x.name, x.value FROM events e, LATERAL (VALUES ('ex@1', 'kind', event_type), ('ex@1', 'user', 'u' || user_id), ('m@2', 'k', (props::JSON->>'k'))) AS x(element, name, value) WHERE x.value IS NOT NULL")
def structured_data_lateral(spark, d):
    """Structured data of every event's line as rows, by a lateral join in SQL."""
    lateral.register(spark)
    e, k = I.table(spark, d, "events"), F.get_json_object("props", "$.k")
    value = F.concat(F.lit('<34>1 2026-01-01T00:00:00Z h app 1 ID [ex@1 kind="'), "event_type", F.lit('" user="u'), F.col("user_id").cast("string"), F.lit('"]'), F.coalesce(F.concat(F.lit('[m@2 k="old" k="'), k, F.lit('"]')), F.lit("")), F.lit(" done"))
    lines = e.select("event_id", value.alias("value"))
    return spark.sql("SELECT event_id, element, name, s.value FROM {lines} l, LATERAL structured_data(l.value) s", lines=lines)


@query("SELECT event_type || '-' || event_id AS value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_number FROM events")
def numbered_lines(spark, d):
    """Events as a file of lines for each type, read back with line numbers over the files' splits."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    e = I.table(spark, d, "events").select("event_type", "event_id", F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("value"))
    e.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(folder)
    return ranges.read_lines(spark, folder).select("value", "line_number")


# case SQL


def _cases(spark, d):
    o = I.table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    risk = F.get(F.array(*map(F.lit, ("Bajo", "Medio", "Alto", "Crítico"))), (F.col("id") % 4).cast("int"))
    incidents = o.select("id", F.col("o_orderpriority").alias("incident_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_approx"), F.col("o_orderstatus").alias("location"), risk.alias("risk_level"), F.lit("s").alias("summary"), F.lit(None).cast("timestamp").alias("created_at"))
    li = I.table(spark, d, "lineitem")
    evidences = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("incident_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("item"), F.lit("x").alias("location_found"), F.col("l_returnflag").alias("evidence_type"))
    store = casesql.CaseStore(spark)
    store.insert({"incidents": incidents, "evidences": evidences})
    return store


@query("SELECT o_orderkey AS id, o_orderpriority AS incident_type, CASE o_orderkey % 4 WHEN 2 THEN 'Alto' ELSE 'Crítico' END AS risk_level FROM orders WHERE o_orderkey % 4 IN (2, 3) ORDER BY 1 LIMIT 100")
def case_sql_high_risk(spark, d):
    return _cases(spark, d).query(casesql.TEMPLATES["high_risk"])


@query("SELECT l_returnflag AS evidence_type, count(*) AS n FROM lineitem GROUP BY 1")
def case_sql_evidence_by_type(spark, d):
    return _cases(spark, d).query(casesql.TEMPLATES["evidence_by_type"])


@query("SELECT o_orderkey AS id, 's' AS summary FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE 'part ' || l_partkey LIKE 'part 1%') ORDER BY 1 LIMIT 100")
def case_sql_by_location(spark, d):
    return _cases(spark, d).query(casesql.TEMPLATES["by_location"], {"item": "part 1%"})
