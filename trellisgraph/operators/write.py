"""Mutations: name resolution, validation, keyed upserts, deletes, incremental comparison and the ingest log.

Every mutation takes DataFrames and returns new ones; the caller writes them. Rows carry ``ord``, their order of
arrival, and the last wins per key and property.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.graph import Graph, Ontology, edges_from, nodes_from
from trellisgraph.operators.embed import with_embeddings

def last_wins(key: list[str], order: str = "ord") -> Window:
    return Window.partitionBy(*key).orderBy(F.col(order).desc())


def overlay(old: Column, new: Column) -> Column:
    """Map ``old`` with the entries of ``new`` over it; null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def folded(df: DataFrame, key: list[str]) -> DataFrame:
    """One row a key with ``props``: of every property the last value that is not null; and ``ord``, the last."""
    rows = df.select(*key, "ord", F.explode_outer("props").alias("k", "v"))
    props = rows.where("k is not null and v is not null").groupBy(*key, "k").agg(F.max_by("v", "ord").alias("v"))
    props = props.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))
    return df.groupBy(*key).agg(F.max("ord").alias("ord")).join(props, key, "left")


def aliases(spark: SparkSession, rows: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(type_lc, variant, rule, canonical, ord) from (canonical, type, variants); a canonical name is its own variant."""
    out = []
    for i, (canonical, kind, variants) in enumerate(rows):
        out.append((kind.lower(), canonical.strip().lower(), "self", canonical, 2 * i))
        out += [(kind.lower(), v.strip().lower(), "alias", canonical, 2 * i + 1) for v in variants]
    return spark.createDataFrame(out, "type_lc string, variant string, rule string, canonical string, ord int")


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def bare_name(name: Column) -> Column:
    """Lower case without white space and hyphens, so model numbers meet."""
    return F.regexp_replace(F.lower(name), r"[\s\-]", "")


def resolve(entities: DataFrame, table: DataFrame) -> DataFrame:
    """``entities`` (type, name, ...) with ``canonical`` and ``resolved_from``: self, alias, normalized or none.

    Exact variants go before normalized ones, earlier rules before later ones. The alias table is config.
    """
    first = Window.partitionBy("type_lc", "variant").orderBy("ord")
    exact = table.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("type_lc", "variant", F.col("canonical").alias("_exact"), F.col("rule").alias("_rule"))
    loose = table.withColumn("variant", bare_name(F.col("variant"))).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("type_lc", F.col("variant").alias("bare"), F.col("canonical").alias("_loose"))
    rows = entities.withColumn("type_lc", F.lower("type")).withColumn("variant", F.lower(plain_name(F.col("name")))).withColumn("bare", bare_name(F.col("name")))
    rows = rows.join(exact, ["type_lc", "variant"], "left").join(loose, ["type_lc", "bare"], "left")
    origin = F.when(F.col("_exact").isNotNull(), F.col("_rule")).when(F.col("_loose").isNotNull(), "normalized").otherwise("none")
    return rows.withColumn("canonical", F.coalesce("_exact", "_loose", plain_name(F.col("name")))).withColumn("resolved_from", origin).drop("type_lc", "variant", "bare", "_exact", "_loose", "_rule")


def rename_ends(relations: DataFrame, renamed: DataFrame) -> DataFrame:
    """Relations (src_type, src_name, dst_type, dst_name, ...) with names replaced by ``renamed`` (type, name, canonical)."""
    for end in ("src", "dst"):
        new = renamed.select(F.col("type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"), F.col("canonical").alias("_new")).distinct()
        relations = relations.join(new, [f"{end}_type", f"{end}_name"], "left").withColumn(f"{end}_name", F.coalesce("_new", f"{end}_name")).drop("_new")
    return relations


def checked_entities(entities: DataFrame, ontology: Ontology) -> DataFrame:
    """``entities`` with ``error``: null, or why a row is skipped."""
    known = F.col("type").isin(list(ontology.entity_types))
    valid = F.coalesce(F.trim("name") != "", F.lit(False))
    return entities.withColumn("error", F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown entity type: "), F.coalesce("type", F.lit("null")))).when(~valid, F.lit("empty name")))


def checked_relations(relations: DataFrame, ontology: Ontology) -> DataFrame:
    """``relations`` (type, src_type, dst_type, ...) with ``error``: unknown type or ends of other types."""
    table = F.broadcast(ontology.relations(relations.sparkSession).select(F.col("type"), F.col("src_label").alias("_a"), F.col("dst_label").alias("_b")))  # ontology-sized
    rows = relations.join(table, "type", "left")
    wrong = F.concat(F.lit("endpoint mismatch: "), F.col("src_type"), F.lit(" -> "), F.col("dst_type"))
    return rows.withColumn("error", F.when(F.col("_a").isNull(), F.concat(F.lit("unknown relation type: "), F.coalesce("type", F.lit("null")))).when((F.col("_a") != F.col("src_type")) | (F.col("_b") != F.col("dst_type")), wrong)).drop("_a", "_b")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after merging ``new`` by node_id: its properties go over the old ones, provenance is the newer."""
    kept = new.withColumn("_r", F.row_number().over(last_wins(["node_id"]))).where("_r = 1").drop("_r", "props").join(folded(new, ["node_id"]).select("node_id", F.col("props")), "node_id")
    return _merged(nodes_from(old), nodes_from(kept), "node_id")


def upsert_edges(nodes: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dangling): edges after merging ``new`` by (src, type, dst); new ones need both ends among ``nodes``."""
    ids = nodes.select("node_id")
    new = new.withColumn("edge_id", F.concat_ws("|", "type", "src", "dst"))
    held = new.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    dangling = new.join(held.select("edge_id").distinct(), "edge_id", "left_anti")
    kept = held.withColumn("_r", F.row_number().over(last_wins(["edge_id"]))).where("_r = 1").drop("_r", "props").join(folded(held, ["edge_id"]).select("edge_id", "props"), "edge_id")
    return _merged(edges_from(old), edges_from(kept), "edge_id"), dangling


def _merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    other = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns])
    rows = old.join(other, F.col(key) == F.col(f"_{key}"), "full")
    pick = lambda c: overlay(F.col(c), F.col(f"_{c}")) if c == "props" else F.coalesce(f"_{c}", c)
    return rows.select(*[pick(c).alias(c) for c in old.columns])


@dataclass
class Written:
    """What a write gives: the new graph, rows that were skipped with reasons, and one row of counts."""

    graph: Graph
    errors: DataFrame
    summary: DataFrame


def write(g: Graph, entities: DataFrame, relations: DataFrame, alias_table: DataFrame | None = None, domain: str = "default", source: str = "", model=None) -> Written:
    """Resolve names, validate, upsert nodes, embed, then edges. Relations without entities are written if their ends exist.

    model: opens an embedding model (see ``embed.embedding``); it sees written nodes whose text is new or has changed.

    entities: type, name, props, confidence, ord; relations: type, src_type, src_name, dst_type, dst_name, props,
    confidence, ord.
    """
    spark = entities.sparkSession
    if alias_table is not None:
        resolved = resolve(entities, alias_table)
        relations = rename_ends(relations, resolved.select("type", "name", "canonical"))
        entities = resolved.withColumn("name", F.col("canonical")).drop("canonical", "resolved_from")
    ents, rels = checked_entities(entities, g.ontology), checked_relations(relations, g.ontology)
    good = ents.where("error is null")
    key = lambda t, n: F.concat_ws("::", F.lit(domain), t, n)
    new = good.select(key("type", "name").alias("node_id"), F.col("type").alias("label"), F.array("type").alias("labels"), "name", F.lit(domain).alias("domain"), "props", F.lit(source).alias("source"), "confidence", "ord")
    nodes = upsert_nodes(g.nodes, nodes_from(new))
    if model is not None:
        nodes = with_embeddings(g.nodes, nodes, new, model)
    links = rels.where("error is null").select(key("src_type", "src_name").alias("src"), key("dst_type", "dst_name").alias("dst"), "type", F.lit(domain).alias("domain"), "props", F.lit(source).alias("source"), "confidence", "ord")
    edges, dangling = upsert_edges(nodes, g.edges, edges_from(links))
    errors = ents.where("error is not null").select(F.lit("entity").alias("kind"), "name", "error").unionByName(rels.where("error is not null").select(F.lit("relation").alias("kind"), F.concat_ws(" -> ", "src_name", "dst_name").alias("name"), "error"))
    errors = errors.unionByName(dangling.select(F.lit("relation").alias("kind"), F.concat_ws(" -> ", "src", "dst").alias("name"), F.lit("dangling").alias("error")))
    counts = [good.agg(F.count("*").alias("entities")), rels.where("error is null").agg(F.count("*").alias("relations")), errors.agg(F.count("*").alias("skipped"))]
    summary = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    return Written(g.with_(nodes=nodes, edges=edges), errors, summary)


def delete_nodes(g: Graph, victims: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, count): without ``victims`` (node_id) and every edge at them; the true number of nodes removed."""
    ids = victims.select("node_id").distinct()
    edges = g.edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti")
    removed = g.nodes.join(ids, "node_id", "left_semi").agg(F.count("*").alias("deleted"))
    return g.with_(nodes=g.nodes.join(ids, "node_id", "left_anti"), edges=edges), removed


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def delete_by_file(g: Graph, file: str) -> tuple[Graph, DataFrame]:
    """Without the nodes whose file or source is ``file`` or its base name."""
    short = file.replace("\\", "/").rsplit("/", 1)[-1]
    hit = F.coalesce(F.col("props")["file"], F.lit("")).isin(file, short) | F.coalesce("source", F.lit("")).isin(file, short)
    return delete_nodes(g, g.nodes.where(hit))


def drop_domain(g: Graph, domain: str) -> Graph:
    keep = F.coalesce(F.col("domain") != domain, F.lit(True))
    return delete_nodes(g, g.nodes.where(~keep))[0]


def log_entry(spark: SparkSession, source: str, filename: str, entities: int, relations: int, success: bool, at: str, content_hash: str) -> DataFrame:
    """One row for the append-only ingest log."""
    return spark.createDataFrame([(content_hash, source, filename, entities, relations, success, at)], "name string, source string, filename string, entities long, relations long, success boolean, at string")


def delete_log(log: DataFrame, source: str) -> DataFrame:
    """The log without the entries of a source."""
    return log.where(F.coalesce(F.col("source") != source, F.lit(True)))


def clean_log(log: DataFrame) -> DataFrame:
    return log.where(F.coalesce("name", F.lit("")) != "")


def unseen(texts: DataFrame, log: DataFrame, force: bool = False, text: str = "text") -> DataFrame:
    """``texts`` with content_hash, without those the log has."""
    rows = texts.withColumn("content_hash", F.sha2(F.col(text), 256))
    return rows if force else rows.join(log.select(F.col("name").alias("content_hash")), "content_hash", "left_anti")


def compared(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``new`` with ``status``: new, updated or unchanged. Compared as text; a null in ``new`` changes nothing."""
    have = old.select(*key, F.lit(1).alias("_have"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = new.join(have, key, "left")
    differs = F.lit(False)
    for c in columns:
        differs |= F.col(c).isNotNull() & (F.coalesce(F.col(f"_{c}").cast("string"), F.lit("")) != F.col(c).cast("string"))
    return rows.withColumn("status", F.when(F.col("_have").isNull(), "new").when(differs, "updated").otherwise("unchanged")).drop("_have", *[f"_{c}" for c in columns])


def not_unique(nodes: DataFrame) -> DataFrame:
    """(label, name, domain, n) that break uniqueness."""
    return nodes.groupBy("label", "name", "domain").agg(F.count("*").alias("n")).where("n > 1")
