"""Exports: JSON lines, Markdown, GEXF, GraphML, node-link JSON, CEF lines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracelake.functions.normalize import iso_text, xml_escape


def write_jsonl(events: DataFrame, path: str) -> int:
    """One JSON object a line, times as ISO text; returns how many, counted as they are written."""
    rows = events.withColumn("timestamp", iso_text(F.col("us"))).drop("us") if "us" in events.columns else events
    written = Observation()
    rows.select(F.to_json(F.struct("*")).alias("value")).observe(written, F.count(F.lit(1)).alias("n")).write.text(path)
    return written.get["n"]


def cef() -> Column:
    """A CEF line of an alert; its number is ten times the score, cut; without a rule NONE stands."""
    rules = F.when(F.size("rules") > 0, F.array_join("rules", ",")).otherwise("NONE")
    return F.concat(
        F.lit("CEF:0|tracelake|detector|1.0|"), "severity", F.lit("|"), "summary", F.lit("|"), F.floor(F.col("score") * 10).cast("string"), F.lit("|msg="), "summary", F.lit(" src="), "entity",
        F.lit(" cat=intrusion cs1Label=Rules cs1="), rules, F.lit(" cfp1Label=ThreatScore cfp1="), F.format_string("%.2f", "score"), F.lit(" rt="), iso_text(F.col("window_us")),
    )


def format_table(rows: DataFrame, most: int = 100, style: str = "markdown") -> str:
    """At most so many rows as a Markdown or boxed text table; null is NULL."""
    table = [["NULL" if v is None else str(v) for v in r] for r in rows.limit(most).collect()]
    width = [max(len(x) for x in column) for column in zip(rows.columns, *table, strict=True)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
    if style == "markdown":
        return "\n".join([line(rows.columns), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, table)])
    edge = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    return "\n".join([edge, line(rows.columns), edge, *map(line, table), edge])


def entropy_graph(blocks: DataFrame, width: int = 60, most: int = 40) -> str:
    """Bars of one blob's block entropies, at most so many, evenly spaced; only those reach the driver."""
    n, mean, low, high = blocks.agg(F.count("*"), F.avg("entropy"), F.min("entropy"), F.max("entropy")).first()
    if not n:
        return "no blocks"
    shown = blocks if n <= most else blocks.where(F.col("block").isin([i * n // most for i in range(most)]))
    bar = lambda e: ("#" * int(e / 8 * width)).ljust(width, ".")
    rows = [f"0x{r['offset']:08X}  {r['entropy']:6.4f}  [{bar(r['entropy'])}] {r['class'][:4]}" for r in shown.orderBy("block").collect()]
    return "\n".join([f"{n} blocks, mean {mean:.4f}, from {low:.4f} to {high:.4f}", *rows])


def carving_report(carved: DataFrame, alerts: DataFrame, most: int = 500) -> str:
    """Carved files and those that hide something, as Markdown; at most so many rows of each."""
    row = "| {} | 0x{:08X} | {} | {} | {:.4f} | {} |".format
    files = [row(r["path"], r["offset"], r["size"], r["format"], r["entropy"], "valid" if r["valid"] else "corrupt") for r in carved.orderBy("path", "offset").limit(most).collect()]
    odd = [f"- {r['path']} at 0x{r['offset']:X} ({r['format']}): {r['note']}, score {r['anomaly']}" for r in alerts.orderBy("path", "offset").limit(most).collect()]
    return "\n".join([f"# Carved files ({carved.count()})", "", "| blob | offset | bytes | format | entropy | structure |", "|-|-|-|-|-|-|", *files, "", "# Hidden content", "", *(odd or ["none"]), ""])


def markdown_report(events: DataFrame, anomalies: DataFrame, chains: DataFrame, most: int = 500) -> str:
    """A report: counts from aggregates, then at most so many rows; only those reach the driver."""
    cut = F.when(F.length("message") > 120, F.concat(F.substring("message", 1, 117), F.lit("..."))).otherwise(F.col("message"))
    counts = events.groupBy("severity").agg(F.count("*").alias("n")).orderBy("severity").collect()
    out = ["# Timeline", "", *(f"- {r['severity']}: {r['n']}" for r in counts), "", f"Anomalies: {anomalies.count()}", f"Chains: {chains.count()}", "", "| time | source | action | message |", "| - | - | - | - |"]
    rows = events.orderBy("us", "source_file", "line_number").limit(most).select(iso_text(F.col("us")).alias("t"), "source_file", "action", F.regexp_replace(cut, "[|\n]", " ").alias("m")).collect()
    return "\n".join([*out, *(f"| {r['t']} | {r['source_file']} | {r['action']} | {r['m']} |" for r in rows)]) + "\n"


def _lines(head: str, nodes: DataFrame, middle: str, edges: DataFrame, tail: str) -> DataFrame:
    """(part, key, line) in the order they are written."""
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, "", head), (2, "", middle), (4, "", tail)], "part int, key string, line string")
    return fixed.union(nodes.select(F.lit(1), "key", "line")).union(edges.select(F.lit(3), "key", "line"))


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GEXF 1.2 as ordered lines; nodes may carry rank and community."""
    has = set(nodes.columns)
    value = lambda c, i: F.concat(F.lit(f'<attvalue for="{i}" value="'), xml_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"/>')) if c in has else F.lit("")
    n = nodes.select(F.col("id").alias("key"), F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('" label="'), xml_escape(F.coalesce("label", "id")), F.lit('"><attvalues>'), value("entity_type", 0), value("rank", 1), value("community", 2), F.lit("</attvalues></node>")).alias("line"))
    pair = F.concat_ws("|", "source", "target")
    e = edges.select(pair.alias("key"), F.concat(F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="entity_type" type="string"/><attribute id="1" title="rank" type="double"/><attribute id="2" title="community" type="string"/></attributes><nodes>'
    return _lines(head, n, "</nodes><edges>", e, "</edges></graph></gexf>")


def _or(df: DataFrame, name: str, other: Column) -> Column:
    return F.coalesce(F.col(name).cast("string"), other) if name in df.columns else other


def graphml(nodes: DataFrame, edges: DataFrame, name: str = "graph") -> DataFrame:
    """GraphML as ordered lines: type, label and risk of nodes; relation, weight and amount (if any) of edges.

    Missing types are SUSPECT, labels the id, relations TRANSACTION, risks 0.0 and weights 1.0.
    """
    data = lambda key, value: F.concat(F.lit(f'<data key="{key}">'), xml_escape(value), F.lit("</data>"))
    n = nodes.select(
        F.col("id").alias("key"),
        F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), data("d0", _or(nodes, "entity_type", F.lit("SUSPECT"))), data("d1", _or(nodes, "label", F.col("id"))), data("d2", _or(nodes, "risk_score", F.lit("0.0"))), F.lit("</node>")).alias("line"),
    )
    amount = F.coalesce(data("d5", F.col("amount").cast("string")), F.lit("")) if "amount" in edges.columns else F.lit("")
    e = edges.select(
        F.concat_ws("|", "source", "target").alias("key"),
        F.concat(F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('">'), data("d3", _or(edges, "relation_type", F.lit("TRANSACTION"))), data("d4", _or(edges, "weight", F.lit("1.0"))), F.when(F.col("amount").isNotNull(), amount).otherwise("") if "amount" in edges.columns else amount, F.lit("</edge>")).alias("line"),
    )
    keys = (("d0", "node", "entity_type", "string"), ("d1", "node", "label", "string"), ("d2", "node", "risk_score", "double"), ("d3", "edge", "relation_type", "string"), ("d4", "edge", "weight", "double"), ("d5", "edge", "amount", "double"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(f'<key id="{i}" for="{f}" attr.name="{n}" attr.type="{t}"/>' for i, f, n, t in keys) + f'<graph id="{escape(name, {chr(34): "&quot;"})}" edgedefault="directed">'
    return _lines(head, n, "", e, "</graph></graphml>")


def json_document(nodes: DataFrame, edges: DataFrame, name: str = "graph") -> DataFrame:
    """One JSON document {"name", "nodes", "edges"} as ordered lines: an element a line, a comma before all but the first."""

    def listed(df: DataFrame, key: Column) -> DataFrame:
        rows = df.select(key.alias("key"), F.to_json(F.struct("*")).alias("line"))
        first = rows.agg(F.min(F.struct("key", "line")).alias("first"))
        return rows.crossJoin(F.broadcast(first)).select("key", F.when(F.struct("key", "line") == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line"))).alias("line"))  # one row

    return _lines(json.dumps({"name": name})[:-1] + ', "nodes": [', listed(nodes, F.col("id")), '], "edges": [', listed(edges, F.concat_ws("|", "source", "target")), "]}")


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered lines to a local file of the driver, streamed partition by partition through the driver."""
    rows: Iterator = lines.orderBy("part", "key", "line").toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(r["line"] + "\n")


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link JSON as rows (kind, value), for write.text."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("value")).union(edges.select(F.lit("link"), F.to_json(F.struct("*"))))
