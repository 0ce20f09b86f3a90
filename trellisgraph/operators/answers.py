"""What an answering service needs around retrieval: path shapes, entity look-up, merging of hits, judging, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.graph import Graph
from trellisgraph.operators.match import display_labels, public_props
from trellisgraph.operators.search import fulltext

#: Properties that a simplified path leaves out.
HIDDEN = ["name", "file"]


def path_parts(g: Graph, paths: DataFrame) -> DataFrame:
    """``paths`` (path_id, nodes, edges as id arrays) as (path_id, nodes: labels and properties, edges: type, start, end).

    Nodes and edges are joined by id after a positional explode, so no wide rows are shuffled.
    """
    node = g.nodes.select("node_id", F.struct(display_labels(F.col("labels")).alias("labels"), "name", F.col("props").alias("properties")).alias("node"))
    n = paths.select("path_id", F.posexplode("nodes").alias("pos", "node_id")).join(node, "node_id")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    # maps have no order, so positions alone must sort: they differ within a path
    nodes = n.select("path_id", "pos", F.struct(F.col("node.labels").alias("labels"), F.col("node.name").alias("name"), F.map_entries("node.properties").alias("entries")).alias("node")).groupBy("path_id").agg(ordered("node").alias("nodes"))
    nodes = nodes.withColumn("nodes", F.transform("nodes", lambda x: F.struct(x["labels"].alias("labels"), x["name"].alias("name"), F.map_from_entries(x["entries"]).alias("properties"))))
    name = lambda end: g.nodes.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name"))
    e = paths.select("path_id", F.posexplode("edges").alias("pos", "edge_id")).join(g.edges.select("edge_id", "src", "dst", "type"), "edge_id").join(name("src"), "src").join(name("dst"), "dst")
    edges = e.select("path_id", "pos", F.struct("type", F.col("src_name").alias("start"), F.col("dst_name").alias("end")).alias("edge")).groupBy("path_id").agg(ordered("edge").alias("edges"))
    return nodes.join(edges, "path_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<type:string,start:string,end:string>>")))


def simplified(parts: DataFrame) -> DataFrame:
    """Of ``path_parts`` what a response shows: of nodes labels, name and properties that hold something."""
    shown = lambda p: F.map_filter(p, lambda k, v: ~k.isin(HIDDEN) & (F.coalesce(v, F.lit("")) != ""))
    return parts.withColumn("nodes", F.transform("nodes", lambda n: F.struct(n["labels"].alias("labels"), n["name"].alias("name"), shown(n["properties"]).alias("key_props"))))


def hits_as_paths(g: Graph, hits: DataFrame) -> DataFrame:
    """Hits (node_id) as paths of one node without internal properties."""
    rows = g.nodes.join(hits.select("node_id").distinct(), "node_id", "left_semi")
    node = F.struct(display_labels(F.col("labels")).alias("labels"), "name", public_props(F.col("props")).alias("properties"))
    return rows.select(F.col("node_id").alias("path_id"), F.array(node).alias("nodes"), F.array().cast("array<struct<type:string,start:string,end:string>>").alias("edges"))


def fetched(nodes: DataFrame, name: str, label: str | None = None, hits: int = 5) -> DataFrame:
    """At most one row (node_id, label, name, props): the best of ``hits`` hits whose name is or holds ``name``."""
    found = fulltext(nodes, name, hits).select("node_id", "score")
    rows = nodes.join(found, "node_id").where((F.col("name") == name) | F.contains(F.lower("name"), F.lit(name.lower())))
    if label:
        rows = rows.where(F.array_contains("labels", label))
    return rows.orderBy(F.desc("score"), "node_id").limit(1).select("node_id", "label", "name", public_props(F.col("props")).alias("props"))


def with_linked(linked: DataFrame, hits: DataFrame, top_k: int = 10) -> DataFrame:
    """(question_id, name, score, source, rank) of linked entities (question_id, name, ord) before hits (question_id,
    name, score, rank): a linked name that no hit has goes to the front, each before the one linked earlier."""
    new = linked.join(hits.select("question_id", "name"), ["question_id", "name"], "left_anti")
    rows = new.select("question_id", "name", F.lit(1.0).alias("score"), F.lit("entity_linker").alias("source"), F.lit(0).alias("_s"), (-F.col("ord")).cast("long").alias("_o"))
    rows = rows.unionByName(hits.select("question_id", "name", "score", F.lit("search").alias("source"), F.lit(1).alias("_s"), F.col("rank").cast("long").alias("_o")))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("_s", "_o", "name"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_k).select("question_id", "name", "score", "source", "rank")


def metric_means(results: DataFrame, metrics: list[str] = ["faithfulness", "answer_relevancy", "context_precision", "overall"]) -> DataFrame:  # noqa: B006
    """One row: the mean of each metric to three places, 0 without results; a missing value counts as 0."""
    return results.agg(*[F.round(F.coalesce(F.sum(m) / F.count("*"), F.lit(0.0)), 3).alias(f"avg_{m}") for m in metrics])


def token_totals(calls: DataFrame) -> DataFrame:
    """One row: prompt_tokens, completion_tokens and total_tokens of all calls."""
    return calls.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def audit_record(spark: SparkSession, user: str, action: str, target: str, status: int, at: str) -> DataFrame:
    """One row for an append-only audit table."""
    return spark.createDataFrame([(user, action, target, status, at)], "user string, action string, target string, status int, at string")


def without_logs(nodes: DataFrame, label: str = "IngestLog") -> DataFrame:
    return nodes.where(~F.array_contains("labels", label))


def stamped(rows: DataFrame, source: Column) -> DataFrame:
    """``rows`` with their provenance."""
    return rows.withColumn("source", source)
