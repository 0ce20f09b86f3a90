"""Counts and lists over the graph and its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisgraph.graph import Graph


def degrees(g: Graph) -> DataFrame:
    """(node_id, degree), a self-loop once; only nodes with edges."""
    ends = g.edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def top_degrees(g: Graph, n: int = 15) -> DataFrame:
    return degrees(g).orderBy(F.desc("degree"), "node_id").limit(n)


def statistics(g: Graph) -> DataFrame:
    """One row: nodes, edges, labels, types."""
    a = g.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("label").alias("labels"))
    b = g.edges.agg(F.count("*").alias("edges"), F.count_distinct("type").alias("types"))
    return a.crossJoin(b).select("nodes", "edges", "labels", "types")  # one row each


def labels_present(g: Graph) -> DataFrame:
    return g.nodes.select(F.explode("labels").alias("label")).distinct()


def types_present(g: Graph) -> DataFrame:
    return g.edges.select("type").distinct()


def files(g: Graph) -> DataFrame:
    """(file, entities, types), most first; by ``file`` property, or by source if no node has a file."""

    def by(c: Column) -> DataFrame:
        rows = g.nodes.select(c.alias("file"), "label").where("file is not null and file <> ''")
        return rows.groupBy("file").agg(F.count("*").alias("entities"), F.array_sort(F.collect_set("label")).alias("types"))

    first, spare = by(F.col("props")["file"]), by(F.col("source"))
    empty = first.agg(F.count("*").alias("_n"))
    return first.unionByName(spare.crossJoin(F.broadcast(empty)).where("_n = 0").drop("_n")).orderBy(F.desc("entities"), "file")  # one row


def log_totals(log: DataFrame) -> DataFrame:
    """One row: files, succeeded, failed, entities, relations."""
    return log.agg(F.count("*").alias("files"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.sum("entities").alias("entities"), F.sum("relations").alias("relations"))


def latest(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("at"), "source").limit(limit)


def display_radius(degree: Column) -> Column:
    return F.greatest(F.lit(14.0), F.least(F.lit(34.0), 14 + 4 * F.sqrt(degree)))


def precision_recall(gold: DataFrame, predicted: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of two sets of spans."""
    g = gold.select(*key, label).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*key, label).distinct().withColumn("_p", F.lit(1))
    rows = g.join(p, [*key, label], "full").groupBy(label).agg(F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    rows = rows.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rows.withColumn("f1", f1)


def macro_average(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def sample_quality(samples: DataFrame) -> DataFrame:
    """(quality, n, mean_entities, mean_relations) of samples (quality, entities, relations)."""
    return samples.groupBy("quality").agg(F.count("*").alias("n"), F.avg("entities").alias("mean_entities"), F.avg("relations").alias("mean_relations"))
