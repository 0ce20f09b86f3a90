"""Ontology inference: symmetric, transitive, inverse and subclass rules. Each gives the facts a graph lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.graph import Graph, edges_from
from trellisgraph.lineage import cut
from trellisgraph.operators.match import two_hop_open


def _scoped(g: Graph, type_: str) -> DataFrame:
    """Edges of a type whose ends have the labels that the ontology gives it; none if it gives none."""
    ends = g.ontology.relation_types.get(type_)
    e = g.edges.where(F.col("type") == type_).select("src", "dst")
    if not ends:
        return e.where(F.lit(False))
    label = lambda k: g.nodes.where((F.col("label") == k) | F.array_contains("labels", k)).select("node_id")
    return e.join(label(ends[0]).toDF("src"), "src", "left_semi").join(label(ends[1]).toDF("dst"), "dst", "left_semi")


def symmetric(g: Graph) -> DataFrame:
    """(rule, src, type, dst): reverse edges that are missing."""
    out = None
    for t in g.ontology.symmetric:
        e = _scoped(g, t)
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst").distinct()
        rows = back.join(g.edges.where(F.col("type") == t).select("src", "dst"), ["src", "dst"], "left_anti").select(F.lit("symmetric").alias("rule"), "src", F.lit(t).alias("type"), "dst")
        out = rows if out is None else out.unionByName(rows)
    return out


def inverse(g: Graph) -> DataFrame:
    out = None
    for t, other in g.ontology.inverse.items():
        back = _scoped(g, t).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
        rows = back.join(g.edges.where(F.col("type") == other).select("src", "dst"), ["src", "dst"], "left_anti").select(F.lit("inverse").alias("rule"), "src", F.lit(other).alias("type"), "dst")
        out = rows if out is None else out.unionByName(rows)
    return out


def transitive_step(g: Graph) -> DataFrame:
    """One composition step; a row for every middle node."""
    out = None
    for t in g.ontology.transitive:
        rows = two_hop_open(g, t).select(F.lit("transitive").alias("rule"), F.col("a").alias("src"), F.lit(t).alias("type"), F.col("c").alias("dst"), "mid")
        out = rows if out is None else out.unionByName(rows)
    return out


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(src, dst) reachable by one or more edges.

    Each round joins what the last one added with all that is known, on either side, so path lengths double and nothing
    is derived from old rows alone; it ends when nothing is added. Rounds are written to the checkpoint folder; the
    driver sees one count a round.
    """
    have = new = cut(edges.select("src", "dst").distinct())
    while True:
        left, right = new.toDF("src", "mid"), new.toDF("mid", "dst")
        more = left.join(have.toDF("mid", "dst"), "mid").select("src", "dst").union(have.toDF("src", "mid").join(right, "mid").select("src", "dst"))
        new = cut(more.distinct().join(have, ["src", "dst"], "left_anti"))
        if not new.count():
            return have
        have = cut(have.unionAll(new))


def subclass(g: Graph) -> DataFrame:
    """(node_id, parent): labels that nodes lack, one level up."""
    rules = F.broadcast(g.ontology.rules(g.nodes.sparkSession).where("family = 'subclass'").select(F.col("type").alias("label"), F.col("other").alias("parent")))  # ontology-sized
    return g.nodes.select("node_id", "label", "labels").join(rules, "label").where("not array_contains(labels, parent)").select("node_id", "parent")


def infer(g: Graph, dry_run: bool = False, domain: str | None = None) -> tuple[Graph, DataFrame]:
    """(graph, counts by rule). Rules run in order and see what those before them wrote, unless dry_run.

    What a rule writes is checkpointed, as the plans of later rules read it many times.
    """
    counts, now = None, g
    for name, rule in (("symmetric", symmetric), ("transitive", transitive_step), ("inverse", inverse)):
        found = rule(now)
        if found is None:
            continue
        row = found.agg(F.count("*").alias("inferred")).select(F.lit(name).alias("rule"), "inferred")
        counts = row if counts is None else counts.unionByName(row)
        fresh = found.select("src", "type", "dst").distinct().select(F.concat_ws("|", "type", "src", "dst").alias("edge_id"), "src", "dst", "type", F.lit(domain).alias("domain"), F.lit(True).alias("inferred"))
        if not dry_run:
            now = now.with_(edges=cut(edges_from(now.edges).unionByName(edges_from(fresh))))
    parents = subclass(now)
    counts = counts.unionByName(parents.agg(F.count("*").alias("inferred")).select(F.lit("subclass").alias("rule"), "inferred"))
    if not dry_run:
        add = parents.groupBy("node_id").agg(F.collect_set("parent").alias("_p"))
        now = now.with_(nodes=now.nodes.join(add, "node_id", "left").withColumn("labels", F.array_union("labels", F.coalesce("_p", F.array().cast("array<string>")))).drop("_p"))
    return (g if dry_run else now), counts
