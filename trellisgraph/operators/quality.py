"""Quality report of a graph against its ontology: each section is one join with the ontology's small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.graph import Graph


def _in(domain: str | None) -> Column:
    return F.lit(True) if domain is None else F.col("domain") == domain


def completeness(g: Graph, domain: str | None = None, first: int = 3, most: int = 20) -> DataFrame:
    """(label, prop, name) of nodes without one of the first recommended properties; at most ``most`` names each."""
    props = g.ontology.entities(g.nodes.sparkSession).where("not required")
    props = props.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("ord"))).where(F.col("r") <= first).select("label", "prop")
    rows = g.nodes.where(_in(domain)).select("label", "name", "props").join(F.broadcast(props), "label").where("props[prop] is null")  # ontology-sized
    rank = F.row_number().over(Window.partitionBy("label", "prop").orderBy("name"))
    return rows.withColumn("r", rank).where(F.col("r") <= most).select("label", "prop", "name")


def consistency(g: Graph, domain: str | None = None, most: int = 20) -> DataFrame:
    """(type, edge_id, src_label, dst_label) of edges whose ends have other labels than the ontology says."""
    ends = F.broadcast(g.ontology.relations(g.nodes.sparkSession).select("type", F.col("src_label").alias("_a"), F.col("dst_label").alias("_b")))  # ontology-sized
    of = lambda end: g.nodes.select(F.col("node_id").alias(end), F.col("label").alias(f"{end}_label"), F.col("labels").alias(f"_{end}"))
    rows = g.edges.where(_in(domain)).select("edge_id", "type", "src", "dst").join(ends, "type").join(of("src"), "src").join(of("dst"), "dst")
    fits = lambda end, want: (F.col(f"{end}_label") == F.col(want)) | F.coalesce(F.array_contains(F.col(f"_{end}"), F.col(want)), F.lit(False))
    bad = rows.where(~(fits("src", "_a") & fits("dst", "_b")))
    rank = F.row_number().over(Window.partitionBy("type").orderBy("edge_id"))
    return bad.withColumn("r", rank).where(F.col("r") <= most).select("type", "edge_id", "src_label", "dst_label")


def duplicates(g: Graph, most: int = 20) -> DataFrame:
    """(name, labels, n) of names that several nodes have."""
    rows = g.nodes.groupBy("name").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").alias("n")).where("n > 1 or size(labels) > 1")
    return rows.orderBy(F.desc("n"), "name").limit(most)


def low_confidence(g: Graph, under: float = 0.5, most: int = 50) -> DataFrame:
    return g.edges.where(F.col("confidence") < under).select("edge_id", "type", "confidence").orderBy("confidence", "edge_id").limit(most)


def orphans(g: Graph) -> DataFrame:
    """Nodes at no edge."""
    ends = g.edges.select(F.col("src").alias("node_id")).unionAll(g.edges.select(F.col("dst").alias("node_id")))
    return g.nodes.select("node_id", "label", "name").join(ends.distinct(), "node_id", "left_anti")


def temporal_conflicts(g: Graph) -> DataFrame:
    """Edges that end before they start, compared as text; an empty string is unset."""
    a, b = F.nullif("valid_from", F.lit("")), F.nullif("valid_to", F.lit(""))
    return g.edges.where(a > b).select("edge_id", "type", "valid_from", "valid_to")


def score(issues: Column, entities: Column) -> Column:
    """100 less two for each issue, at least 0; 100 for an empty graph."""
    return F.when(entities == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), F.lit(100) - F.least(2 * issues, F.lit(100))))


def report(g: Graph, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(details: section, item, detail; summary: one row with issues and score)."""
    part = lambda name, df, item, detail: df.select(F.lit(name).alias("section"), item.alias("item"), detail.alias("detail"))
    rows = part("completeness", completeness(g, domain), F.concat_ws("::", "label", "name"), F.col("prop"))
    rows = rows.unionByName(part("consistency", consistency(g, domain), F.col("edge_id"), F.concat_ws(" -> ", "src_label", "dst_label")))
    rows = rows.unionByName(part("duplicates", duplicates(g), F.col("name"), F.array_join("labels", ",")))
    rows = rows.unionByName(part("low_confidence", low_confidence(g), F.col("edge_id"), F.col("confidence").cast("string")))
    rows = rows.unionByName(part("orphans", orphans(g), F.col("node_id"), F.col("label")))
    rows = rows.unionByName(part("temporal", temporal_conflicts(g), F.col("edge_id"), F.concat_ws(" > ", "valid_from", "valid_to")))
    total = g.nodes.where(_in(domain)).agg(F.count("*").alias("entities")).crossJoin(rows.agg(F.count("*").alias("issues")))  # one row each
    return rows, total.withColumn("score", score(F.col("issues"), F.col("entities")))


def timeline(g: Graph, label: str | None = None, domain: str | None = None, limit: int = 100) -> DataFrame:
    """Edges with a validity, latest first, with both names; label: of either end."""
    of = lambda end: g.nodes.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name"), F.col("label").alias(f"{end}_label"))
    start, stop = F.nullif("valid_from", F.lit("")), F.nullif("valid_to", F.lit(""))
    rows = g.edges.where(_in(domain)).where(start.isNotNull() | stop.isNotNull()).select("edge_id", "type", "src", "dst", "valid_from", "valid_to").join(of("src"), "src").join(of("dst"), "dst")
    if label:
        rows = rows.where((F.col("src_label") == label) | (F.col("dst_label") == label))
    return rows.orderBy(F.desc_nulls_last("valid_from"), "edge_id").limit(limit)


def entity_timeline(g: Graph, name: str) -> DataFrame:
    """Edges with a validity at the nodes of a name, either way, oldest first."""
    own = g.nodes.where(F.col("name") == name).select("node_id")
    of = lambda end: g.nodes.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name"))
    start, stop = F.nullif("valid_from", F.lit("")), F.nullif("valid_to", F.lit(""))
    e = g.edges.where(start.isNotNull() | stop.isNotNull()).select("edge_id", "type", "src", "dst", "valid_from", "valid_to")
    mine = e.join(own.toDF("src"), "src", "left_semi").unionByName(e.join(own.toDF("dst"), "dst", "left_semi")).distinct()
    return mine.join(of("src"), "src").join(of("dst"), "dst").orderBy("valid_from", "edge_id")
