"""Graph tables from CSV and JSON files: nodes and edges, later rows over earlier ones.

Blank cells are missing. A node without an id and an edge without both ends are left out; ids are
trimmed; types that aren't known become OTHER, missing ones SUSPECT and TRANSACTION; the other
columns go to a map of attributes. Rows keep their order in the file as seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.graph import ENTITY_TYPES, RELATION_TYPES, normalize_enum

# The header names of each field, in order of preference.
NODE_NAMES = {"id": ("id", "node_id", "name"), "entity_type": ("entity_type", "type"), "label": ("label",), "risk_score": ("risk_score",)}
EDGE_NAMES = {
    "source": ("source", "src", "from"), "target": ("target", "dst", "to"), "relation_type": ("relation_type", "type"),
    "weight": ("weight",), "amount": ("amount",), "timestamp": ("timestamp", "date"),
}
_NODE = "id string, entity_type string, label string, risk_score double, attributes map<string,string>"
_EDGE = "source string, target string, relation_type string, weight double, amount double, timestamp string, attributes map<string,string>"


def _own(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that isn't blank."""
    there = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def _rest(df: DataFrame, fields: dict[str, tuple[str, ...]]) -> Column:
    used = {n for names in fields.values() for n in names} - {"name"}
    more = [c for c in df.columns if c not in used and c != "_seq"]
    pairs = [x for c in more for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.map_filter(F.create_map(*pairs).cast("map<string,string>"), lambda k, v: v.isNotNull())


def nodes_of(rows: DataFrame) -> DataFrame:
    """Nodes (id, entity_type, label, risk_score, attributes, seq) of rows with any of the header names."""
    rows = rows if "_seq" in rows.columns else rows.withColumn("_seq", F.monotonically_increasing_id())
    field = {f: _own(rows, names) for f, names in NODE_NAMES.items()}
    kind = F.coalesce(field["entity_type"], F.lit("SUSPECT"))
    got = rows.select(
        field["id"].alias("id"), normalize_enum(kind, ENTITY_TYPES).alias("entity_type"), F.coalesce(field["label"], field["id"]).alias("label"),
        F.coalesce(field["risk_score"].try_cast("double"), F.lit(0.0)).alias("risk_score"), _rest(rows, NODE_NAMES).alias("attributes"), F.col("_seq").alias("seq"),
    )
    return got.where("id is not null")


def edges_of(rows: DataFrame) -> DataFrame:
    """Edges (source, target, relation_type, weight, amount, timestamp, attributes, seq) of rows with any of the header names."""
    rows = rows if "_seq" in rows.columns else rows.withColumn("_seq", F.monotonically_increasing_id())
    field = {f: _own(rows, names) for f, names in EDGE_NAMES.items()}
    kind = F.coalesce(field["relation_type"], F.lit("TRANSACTION"))
    got = rows.select(
        field["source"].alias("source"), field["target"].alias("target"), normalize_enum(kind, RELATION_TYPES).alias("relation_type"), F.coalesce(field["weight"].try_cast("double"), F.lit(1.0)).alias("weight"),
        field["amount"].try_cast("double").alias("amount"), field["timestamp"].alias("timestamp"), _rest(rows, EDGE_NAMES).alias("attributes"), F.col("_seq").alias("seq"),
    )
    return got.where("source is not null and target is not null")


def read_csv(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of two CSV files with headers, or folders of such; seq is a text that sorts as the rows stand in them."""
    meta = F.col("_metadata")
    # a row's place: its file, the split it was read from, and its place there; texts that sort as these do
    place = F.concat(meta["file_path"], F.lpad(meta["file_block_start"].cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    read = lambda path: (df := spark.read.option("header", True).option("escape", '"').csv(path)).select(*(F.col(f"`{c}`") for c in df.columns), place.alias("_seq"))
    return nodes_of(read(nodes)), edges_of(read(edges))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON document {"nodes": [...], "edges": [...]}."""
    whole = spark.read.option("multiLine", True).schema(f"nodes array<struct<{_NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{_EDGE.replace(' ', ':').replace(',:', ',')}>>").json(path)

    return _with_maps(whole, "nodes", nodes_of), _with_maps(whole, "edges", edges_of)


def _with_maps(whole: DataFrame, name: str, make) -> DataFrame:
    """A document's nodes or edges with their own attributes maps."""
    flat = whole.select(F.explode(name).alias("r")).select("r.*")
    plain = make(flat.withColumn("attributes", F.to_json("attributes")))
    own = F.from_json(F.try_element_at("attributes", F.lit("attributes")), "map<string,string>")
    return plain.withColumn("attributes", F.coalesce(own, F.create_map().cast("map<string,string>")))
