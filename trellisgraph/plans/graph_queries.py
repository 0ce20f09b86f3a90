"""Queries for the graph operators over the projected star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.graph import Graph, edges_from
from trellisgraph.lineage import scratch, stored
from trellisgraph.operators import ask, community, infer, match, postings, quality, retrieve, stats, write
from trellisgraph.plans.registry import query
from trellisgraph.plans.star import STAR, WITH, read, small_star, star

FIRST_REGION = "(SELECT min(r_name) FROM region)"


def _asia(spark, sf_dir):
    """node ids of the first region by name; five rows are read."""
    return read(spark, sf_dir, "region").agg(F.concat(F.lit("Region::"), F.min("r_name")).alias("node_id"))


# Traversals ----------------------------------------------------------------------------------------------------


@query("j01_one_hop", WITH + " SELECT e.edge_id, a.name AS src_name, b.name AS dst_name FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE e.type = 'supplier_of'")
def j01(spark, sf_dir):
    return match.one_hop(star(spark, sf_dir), "supplier_of", "Supplier", "Nation").select("edge_id", "src_name", "dst_name")


@query("j02_neighbors", WITH + " SELECT b AS node_id, label, name, type, direction FROM both0 JOIN nodes ON node_id = b WHERE a = 'Nation::' || (SELECT min(n_name) FROM nation)")
def j02(spark, sf_dir):
    g = star(spark, sf_dir)
    name = read(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return match.neighbors(g, "Nation", name)


@query("j02_neighbors_typed_limit", WITH + " SELECT b AS node_id, label, name, type, direction FROM both0 JOIN nodes ON node_id = b WHERE a = 'Customer::1' AND direction = 'out' AND type = 'placed' ORDER BY type, direction, node_id LIMIT 5")
def j02b(spark, sf_dir):
    name = read(spark, sf_dir, "customer").where("c_custkey = 1").agg(F.min("c_name")).first()[0]
    return match.neighbors(star(spark, sf_dir), "Customer", name or "", "out", "placed", 5)


@query("j03_two_hop_open", WITH + " SELECT count(*) AS n, count(DISTINCT x.src) AS sources FROM se x JOIN se y ON x.dst = y.src AND x.type = 'supplier_of' AND y.type = 'in_region' WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM se z WHERE z.src = x.src AND z.dst = y.dst)")
def j03(spark, sf_dir):
    g = small_star(spark, sf_dir)
    path = g.with_(edges=g.edges.withColumn("type", F.when(F.col("type").isin("supplier_of", "in_region"), "within").otherwise(F.col("type"))))
    return match.two_hop_open(path, "within").agg(F.count("*").alias("n"), F.count_distinct("a").alias("sources"))


_TRAILS = """, t(seed, hops, last, edges) AS (
  SELECT 'Region::' || min(r_name), 0, 'Region::' || min(r_name), CAST([] AS VARCHAR[]) FROM region
  UNION ALL SELECT seed, hops + 1, b, list_append(edges, edge_id) FROM t JOIN sboth ON a = last WHERE hops < %d AND NOT list_contains(edges, edge_id))"""


@query("j04_trails", WITH + _TRAILS % 3 + " SELECT hops, last, count(*) AS n FROM t WHERE hops > 0 GROUP BY hops, last")
def j04(spark, sf_dir):
    return match.trails(small_star(spark, sf_dir), _asia(spark, sf_dir), 3).groupBy("hops", "last").agg(F.count("*").alias("n"))


@query("j04_trails_strict_missing_seed", "SELECT 0 AS n")
def j04s(spark, sf_dir):
    seeds = _asia(spark, sf_dir).unionByName(spark.createDataFrame([("Region::NOWHERE",)], "node_id string"))
    return match.trails(small_star(spark, sf_dir), seeds, 2, strict=True, wanted=2).agg(F.count("*").cast("int").alias("n"))


@query(
    "j04_trails_first_by_hops",
    WITH + ", t(hops, last, path) AS (SELECT 0, 'Region::' || min(r_name), 'Region::' || min(r_name) FROM region UNION ALL SELECT hops + 1, src, path || '|' || src FROM t JOIN se ON dst = last WHERE hops < 2) SELECT hops, last FROM t WHERE hops > 0 ORDER BY hops, path LIMIT 20",
)
def j04l(spark, sf_dir):
    return match.trails(small_star(spark, sf_dir), _asia(spark, sf_dir), 2, limit=20).select("hops", "last")


_BFS = """, r AS (SELECT DISTINCT a, b FROM sboth), p(source, last, hops) AS (
  SELECT node_id, node_id, 0 FROM sn WHERE label = 'Supplier' UNION SELECT source, b, hops + 1 FROM p JOIN r ON a = last WHERE hops < 4)"""


@query(
    "j05_paths_between",
    WITH + """, pair AS (SELECT 'Supplier::' || s_suppkey AS source, 'Customer::' || c_custkey AS target FROM supplier JOIN customer ON c_custkey = s_suppkey),
n AS (SELECT DISTINCT a, b FROM both0),
a1 AS (SELECT source, target, b FROM pair JOIN n ON a = source), a2 AS (SELECT DISTINCT source, target, n.b FROM a1 JOIN n ON n.a = a1.b), a3 AS (SELECT DISTINCT source, target, n.b FROM a2 JOIN n ON n.a = a2.b),
b1 AS (SELECT source, target, b FROM pair JOIN n ON a = target), b2 AS (SELECT DISTINCT source, target, n.b FROM b1 JOIN n ON n.a = b1.b),
h AS (SELECT source, target, 1 AS hops FROM a1 WHERE b = target UNION ALL SELECT source, target, 2 FROM a1 JOIN b1 USING (source, target, b) UNION ALL SELECT source, target, 3 FROM a2 JOIN b1 USING (source, target, b)
  UNION ALL SELECT source, target, 4 FROM a2 JOIN b2 USING (source, target, b) UNION ALL SELECT source, target, 5 FROM a3 JOIN b2 USING (source, target, b))
SELECT source, target, min(hops) AS hops FROM h GROUP BY source, target""",
)
def j05b(spark, sf_dir):
    """Shortest paths of up to five edges, over all edges of the star, from each supplier to the customer of its number."""
    g = star(spark, sf_dir)
    g = g.with_(edges=stored(g.edges.select("edge_id", "type", "src", "dst")))
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("s_suppkey"))
    pairs = s.select(F.concat(F.lit("Supplier::"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("Customer::"), F.col("c_custkey").cast("string")).alias("target"))
    return match.shortest_paths(g, pairs, 5).select("source", "target", "hops")


@query("j05_shortest_path", WITH + _BFS + " SELECT source, last AS target, min(hops) AS hops FROM p WHERE last LIKE 'Region::%' GROUP BY source, last")
def j05(spark, sf_dir):
    g = small_star(spark, sf_dir)
    return match.shortest_path(g, F.col("label") == "Supplier", F.col("label") == "Region", 2).select("source", "target", "hops")


@query("j06_subgraph", WITH + _TRAILS % 2 + " SELECT e AS edge_id, type, src, dst FROM (SELECT DISTINCT unnest(edges) AS e FROM t) JOIN se ON edge_id = e")
def j06(spark, sf_dir):
    return match.subgraph(small_star(spark, sf_dir), _asia(spark, sf_dir), 2)[1].select("edge_id", "type", "src", "dst")


@query("j06_subgraph_nodes", WITH + _TRAILS % 2 + " SELECT node_id, label, name FROM sn WHERE node_id IN (SELECT last FROM t)")
def j06n(spark, sf_dir):
    return match.subgraph(small_star(spark, sf_dir), _asia(spark, sf_dir), 2)[0].select("node_id", "label", "name")


@query(
    "j07_keyword_subgraph",
    WITH + ", h AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS r FROM sn WHERE label = 'Nation' AND contains(name, 'A') ORDER BY node_id LIMIT 5), x AS (SELECT node_id AS n FROM h UNION SELECT b FROM sboth JOIN h ON a = node_id WHERE r <= 3) SELECT node_id, label, name FROM sn JOIN x ON n = node_id",
)
def j07(spark, sf_dir):
    g = small_star(spark, sf_dir)
    hits = g.nodes.where("label = 'Nation' and contains(name, 'A')").select("node_id").orderBy("node_id").limit(5)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("node_id")))
    return match.keyword_subgraph(g, hits)[0].select("node_id", "label", "name")


@query("j08_full_graph", WITH + ", e AS (SELECT * FROM se ORDER BY edge_id LIMIT 60), i AS (SELECT node_id AS n FROM (SELECT node_id FROM sn ORDER BY node_id LIMIT 20) UNION SELECT src FROM e UNION SELECT dst FROM e) SELECT node_id, label FROM sn JOIN i ON n = node_id")
def j08(spark, sf_dir):
    return match.full_graph(small_star(spark, sf_dir), 20)[0].select("node_id", "label")


@query("j09_seed_product", WITH + " SELECT a.node_id AS n0, b.node_id AS n1 FROM sn a, sn b WHERE a.name = (SELECT min(r_name) FROM region) AND b.name = (SELECT max(n_name) FROM nation)")
def j09(spark, sf_dir):
    names = [read(spark, sf_dir, "region").agg(F.min("r_name")).first()[0], read(spark, sf_dir, "nation").agg(F.max("n_name")).first()[0]]
    return match.seed_product(small_star(spark, sf_dir), names)


@query("j14_endpoint_filter", WITH + " SELECT edge_id FROM edges WHERE type = 'supplies' AND src IN (SELECT node_id FROM nodes WHERE label = 'Supplier' AND name < 'Supplier#000000005') AND dst IN (SELECT node_id FROM nodes WHERE label = 'Part')")
def j14(spark, sf_dir):
    g = star(spark, sf_dir)
    keep = g.nodes.where("(label = 'Supplier' and name < 'Supplier#000000005') or label = 'Part'").select("node_id")
    return g.edges.where("type = 'supplies'").join(keep.toDF("src"), "src", "left_semi").join(keep.toDF("dst"), "dst", "left_semi").select("edge_id")


@query(
    "j15_common_relations",
    WITH + ", x AS (SELECT a, type, count(DISTINCT name) AS n FROM both0 JOIN nodes ON node_id = b WHERE a IN ('Supplier::1', 'Supplier::2') GROUP BY a, type) SELECT p.type, least(p.n, 5) AS a_targets, least(q.n, 5) AS b_targets FROM x p JOIN x q ON p.type = q.type WHERE p.a = 'Supplier::1' AND q.a = 'Supplier::2'",
)
def j15(spark, sf_dir):
    rows = match.common_relations(star(spark, sf_dir), "Supplier::1", "Supplier::2")
    return rows.select("type", F.size("a_targets").cast("long").alias("a_targets"), F.size("b_targets").cast("long").alias("b_targets"))


@query("w08_isolated_nodes", WITH + " SELECT node_id FROM nodes n WHERE label = 'Customer' AND NOT EXISTS (SELECT 1 FROM edges WHERE type = 'placed' AND src = n.node_id)")
def w08(spark, sf_dir):
    g = star(spark, sf_dir)
    return g.nodes.where("label = 'Customer'").join(g.edges.where("type = 'placed'").select(F.col("src").alias("node_id")), "node_id", "left_anti").select("node_id")


@query("w21_visible", WITH + " SELECT edge_id FROM se JOIN sn a ON a.node_id = src JOIN sn b ON b.node_id = dst WHERE a.label <> 'Customer' AND b.label <> 'Customer'")
def w21(spark, sf_dir):
    return match.visible(small_star(spark, sf_dir), ["Customer"])[1].select("edge_id")


# Statistics ----------------------------------------------------------------------------------------------------


@query("a03_top_degrees", WITH + " SELECT x AS node_id, count(*) AS degree FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) GROUP BY x ORDER BY degree DESC, x LIMIT 15")
def a03(spark, sf_dir):
    return stats.top_degrees(star(spark, sf_dir))


@query("a04_statistics", WITH + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT label) FROM nodes) AS labels, (SELECT count(DISTINCT type) FROM edges) AS types")
def a04(spark, sf_dir):
    return stats.statistics(star(spark, sf_dir))


@query("a02_labels_and_types", WITH + " SELECT DISTINCT 'label' AS kind, label AS value FROM nodes UNION ALL SELECT DISTINCT 'type', type FROM edges")
def a02(spark, sf_dir):
    g = star(spark, sf_dir)
    return stats.labels_present(g).select(F.lit("label").alias("kind"), F.col("label").alias("value")).unionByName(stats.types_present(g).select(F.lit("type").alias("kind"), F.col("type").alias("value")))


@query("a24_display_radius", WITH + ", d AS (SELECT x, count(*) AS n FROM (SELECT src AS x FROM se UNION ALL SELECT dst FROM se) GROUP BY x) SELECT x AS node_id, round(greatest(14.0, least(34.0, 14 + 4 * sqrt(n))), 6) AS radius FROM d")
def a24(spark, sf_dir):
    return stats.degrees(small_star(spark, sf_dir)).select("node_id", F.round(stats.display_radius(F.col("degree")), 6).alias("radius"))


# Scored trails -------------------------------------------------------------------------------------------------


@query(
    "x01_scored_trails",
    WITH + _TRAILS % 2 + " SELECT hops, last, round(1.0 * 0.35 + 0.5 * 0.20 + 0.7 * 0.15 + (1.0 - (hops - 1) * 0.2) * 0.30, 4) AS score FROM t WHERE hops > 0 ORDER BY score DESC, last LIMIT 50",
)
def x01(spark, sf_dir):
    """Trails of up to two hops from the first region, scored; all edges here have default weight and confidence."""
    g = small_star(spark, sf_dir)
    name = read(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    paths = match.trails(g, _asia(spark, sf_dir), 2)
    rows = retrieve.scored_paths(g, paths, [f"Region::{name}"]).select("hops", "last", F.round("score", 4).alias("score"))
    return rows.orderBy(F.desc("score"), "last").limit(50)


@query(
    "a13_path_scores",
    WITH + " SELECT e.edge_id, round(0.5 * 0.35 + 0.65 * 0.20 + confidence * 0.15 + 0.30, 6) AS score FROM edges e WHERE type = 'contains' AND src = 'Order::1'",
)
def a13(spark, sf_dir):
    g = star(spark, sf_dir)
    paths = match.trails(g.with_(edges=g.edges.where("type = 'contains' and src = 'Order::1'")), spark.createDataFrame([("Order::1",)], "node_id string"), 1)
    return retrieve.scored_paths(g, paths, ["Order::1", "Order::2"]).select(F.get("edges", F.lit(0)).alias("edge_id"), F.round("score", 6).alias("score"))


@query("x01_retrieval")
def x01r(spark, sf_dir):
    """The full context for two suppliers: trails, scores, lines, budget and markers."""
    return retrieve.retrieve(small_star(spark, sf_dir), ["Supplier::1", "Supplier::2"]).select("marker", "rank", "line", F.round("score", 6).alias("score"))


@query("x01_questions")
def x01q(spark, sf_dir):
    """One question for every customer: linking, search, seeds, trails over the whole star, scores and budget."""
    g = star(spark, sf_dir)
    g = g.with_(nodes=stored(g.nodes), edges=stored(g.edges))
    names = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    questions = names.select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("what did "), "c_name", F.lit(" of "), "n_name", F.lit(" order?")).alias("question"))
    index = postings.build(g.nodes, "node_id", ask.node_text(), scratch(spark))
    return ask.retrieve_all(g, questions, index, max_hops=2).select("question_id", "marker", "rank", "line", F.round("score", 6).alias("score"))


@query(
    "x04_compare",
    "WITH a AS (SELECT unnest(['brand', 'kind', 'size']) AS prop, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS a FROM part WHERE p_partkey = 1), b AS (SELECT unnest(['brand', 'kind', 'size']) AS prop, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS b FROM part WHERE p_partkey = 2) SELECT prop, a, b FROM a FULL JOIN b USING (prop)",
)
def x04(spark, sf_dir):
    return retrieve.compare(star(spark, sf_dir), "Part::1", "Part::2")[0].select("prop", "a", "b")


@query("k14_comparison_text")
def k14(spark, sf_dir):
    return retrieve.comparison_text(retrieve.compare(star(spark, sf_dir), "Part::1", "Part::2")[0], "Part::1", "Part::2")


# Mutations -----------------------------------------------------------------------------------------------------

_NEW = "SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders"


@query(
    "j18_incremental_compare",
    "WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders) SELECT CASE WHEN old.k IS NULL THEN 'new' WHEN new.status IS NOT NULL AND coalesce(old.status, '') <> new.status THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS n FROM new LEFT JOIN old USING (k) GROUP BY 1",
)
def j18(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    new = orders.withColumn("status", F.when(F.col("k") % 5 == 0, "X").when(F.col("k") % 7 == 0, None).otherwise(F.col("status")))
    old = orders.where("k % 3 <> 0").withColumnRenamed("status", "value")
    return write.compared(old, new.withColumnRenamed("status", "value"), ["k"], ["value"]).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "k01_upsert_nodes",
    "WITH o AS (SELECT 'Order::' || o_orderkey AS node_id, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey AS k FROM orders) SELECT node_id, CASE WHEN k % 2 = 0 THEN 'merged' ELSE status END AS status, CASE WHEN k % 3 = 0 THEN NULL ELSE priority END AS priority FROM o",
)
def k01(spark, sf_dir):
    """Old rows without every third priority; even ones come again with another status only."""
    g = star(spark, sf_dir)
    orders = g.nodes.where("label = 'Order'")
    k = F.substring_index("node_id", "::", -1).try_cast("long")
    old = orders.withColumn("props", F.when(k % 3 == 0, F.map_filter("props", lambda a, b: a != "priority")).otherwise(F.col("props")))
    new = orders.where(k % 2 == 0).withColumn("props", F.create_map(F.lit("status"), F.lit("merged"))).withColumn("ord", F.lit(1).cast("long"))
    rows = write.upsert_nodes(old, new)
    return rows.select("node_id", F.col("props")["status"].alias("status"), F.col("props")["priority"].alias("priority"))


@query(
    "k02_upsert_edges",
    WITH + " SELECT edge_id, CASE WHEN CAST(split_part(src, '::', 2) AS BIGINT) % 2 = 0 THEN 0.25 END AS confidence FROM se WHERE type = 'supplier_of'",
)
def k02(spark, sf_dir):
    g = small_star(spark, sf_dir)
    e = g.edges.where("type = 'supplier_of'")
    even = F.substring_index("src", "::", -1).try_cast("long") % 2 == 0
    new = e.where(even).withColumn("confidence", F.lit(0.25)).withColumn("ord", F.lit(1).cast("long"))
    lost = e.limit(1).withColumn("dst", F.lit("Nation::NOWHERE")).withColumn("ord", F.lit(2).cast("long"))
    return write.upsert_edges(g.nodes, e, new.unionByName(lost))[0].select("edge_id", "confidence")


@query("k02_dangling", "SELECT count(*) AS n FROM nation WHERE n_nationkey < 7")
def k02d(spark, sf_dir):
    g = small_star(spark, sf_dir)
    lost = read(spark, sf_dir, "nation").where("n_nationkey < 7").select(F.concat(F.lit("Nation::"), "n_name").alias("src"), F.lit("Region::NOWHERE").alias("dst"), F.lit("in_region").alias("type"), F.lit(1).cast("long").alias("ord"))
    return write.upsert_edges(g.nodes, g.edges, edges_from(lost))[1].agg(F.count("*").alias("n"))


@query(
    "k06_delete_nodes",
    WITH + ", v AS (SELECT node_id FROM sn WHERE label = 'Nation' AND name < 'E') SELECT edge_id FROM se WHERE src NOT IN (SELECT node_id FROM v) AND dst NOT IN (SELECT node_id FROM v)",
)
def k06(spark, sf_dir):
    g = small_star(spark, sf_dir)
    return write.delete_nodes(g, g.nodes.where("label = 'Nation' and name < 'E'").select("node_id"))[0].edges.select("edge_id")


@query("k06_deleted_count", "SELECT count(*) AS deleted FROM nation WHERE n_name < 'E'")
def k06c(spark, sf_dir):
    g = small_star(spark, sf_dir)
    return write.delete_nodes(g, g.nodes.where("label = 'Nation' and name < 'E'").select("node_id"))[1]


@query("k13_not_unique", WITH + " SELECT label, name, count(*) AS n FROM nodes GROUP BY label, name HAVING count(*) > 1")
def k13(spark, sf_dir):
    return write.not_unique(star(spark, sf_dir).nodes).select("label", "name", "n")


@query(
    "k03_write",
    "SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS entities, (SELECT count(*) FROM supplier) AS relations, (SELECT count(*) FROM region) AS skipped",
)
def k03(spark, sf_dir):
    """Suppliers and nations as entities, regions with an unknown type, supplier_of as relations."""
    e = lambda t, c, kind: read(spark, sf_dir, t).select(F.lit(kind).alias("type"), F.col(c).cast("string").alias("name"), F.create_map().cast("map<string,string>").alias("props"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("ord"))
    ents = e("supplier", "s_name", "Supplier").unionByName(e("nation", "n_name", "Nation")).unionByName(e("region", "r_name", "Territory"))
    rels = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("supplier_of").alias("type"), F.lit("Supplier").alias("src_type"), F.col("s_name").alias("src_name"), F.lit("Nation").alias("dst_type"), F.col("n_name").alias("dst_name"), F.create_map().cast("map<string,string>").alias("props"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("ord"))
    g = small_star(spark, sf_dir)
    empty = Graph(g.nodes.limit(0), g.edges.limit(0), STAR)
    return write.write(empty, ents, rels, domain="d").summary


@query(
    "w12_relation_validation",
    WITH + ", x AS (SELECT type, a.label AS s, b.label AS d FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE type IN ('supplies', 'placed')) SELECT 'endpoint mismatch: ' || d || ' -> ' || s AS error, count(*) AS n FROM x GROUP BY 1",
)
def w12(spark, sf_dir):
    """Edges checked with their ends the wrong way round."""
    rows = match.one_hop(star(spark, sf_dir)).where("type in ('supplies', 'placed')").select("type", F.col("dst_label").alias("src_type"), F.col("src_label").alias("dst_type"))
    return write.checked_relations(rows, STAR).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


@query("w17_unseen_texts", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def w17(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    log = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("name")).distinct()
    return write.unseen(docs, log).select("doc_id", "content_hash")


@query(
    "j12_resolve_names",
    "WITH x AS (SELECT n_name, lower(n_name) AS v FROM nation) SELECT upper(n_name) || ' ' AS name, CASE WHEN v < 'c' THEN 'N:' || v ELSE trim(upper(n_name)) END AS canonical, CASE WHEN v < 'c' THEN 'alias' ELSE 'none' END AS resolved_from FROM x",
)
def j12(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    names = [r[0] for r in nation.select("n_name").collect()]  # 25 rows of config
    table = write.aliases(spark, [(f"N:{n.lower()}", "Nation", [n]) for n in names if n.lower() < "c"])
    rows = nation.select(F.lit("Nation").alias("type"), F.concat(F.upper("n_name"), F.lit(" ")).alias("name"))
    return write.resolve(rows, table).select("name", "canonical", "resolved_from")


# Inference -----------------------------------------------------------------------------------------------------


@query("r01_symmetric", WITH + " SELECT DISTINCT dst AS src, src AS dst FROM edges e WHERE type = 'supplies' AND NOT EXISTS (SELECT 1 FROM edges f WHERE f.type = 'supplies' AND f.src = e.dst AND f.dst = e.src)")
def r01(spark, sf_dir):
    return infer.symmetric(star(spark, sf_dir)).select("src", "dst")


@query("r02_transitive_step", WITH + ", w AS (SELECT src, dst FROM se WHERE type IN ('in_region', 'supplier_of')) SELECT x.src, x.dst AS mid, y.dst FROM w x JOIN w y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM w z WHERE z.src = x.src AND z.dst = y.dst)")
def r02(spark, sf_dir):
    g = small_star(spark, sf_dir)
    e = g.edges.where("type in ('in_region', 'supplier_of')").withColumn("type", F.lit("within"))
    from dataclasses import replace

    return infer.transitive_step(g.with_(edges=e, ontology=replace(STAR, transitive=["within"]))).select("src", "mid", "dst")


@query("r02_transitive_closure", WITH + ", c AS (SELECT src, dst FROM se UNION SELECT c.src, se.dst FROM c JOIN se ON c.dst = se.src) SELECT src, dst FROM c")
def r02c(spark, sf_dir):
    return infer.transitive_closure(small_star(spark, sf_dir).edges)


@query("r03_inverse", WITH + " SELECT DISTINCT dst AS src, src AS dst, CASE type WHEN 'placed' THEN 'placed_by' ELSE 'has_supplier' END AS type FROM edges WHERE type IN ('placed', 'supplier_of')")
def r03(spark, sf_dir):
    return infer.inverse(star(spark, sf_dir)).select("src", "dst", "type")


@query("r04_subclass", WITH + " SELECT node_id, CASE WHEN label IN ('Customer', 'Supplier') THEN 'Party' ELSE 'Place' END AS parent FROM sn")
def r04(spark, sf_dir):
    return infer.subclass(star(spark, sf_dir))


@query("r05_infer_counts", WITH + " SELECT 'symmetric' AS rule, (SELECT count(*) FROM edges WHERE type = 'supplies') AS inferred UNION ALL SELECT 'transitive', 0 UNION ALL SELECT 'inverse', (SELECT count(*) FROM edges WHERE type IN ('placed', 'supplier_of')) UNION ALL SELECT 'subclass', (SELECT count(*) FROM sn)")
def r05(spark, sf_dir):
    return infer.infer(star(spark, sf_dir), dry_run=True)[1]


# Quality -------------------------------------------------------------------------------------------------------


@query("g01_completeness", "SELECT 'Supplier' AS label, 'phone' AS prop, s_name AS name FROM (SELECT s_name FROM supplier ORDER BY s_name LIMIT 20) UNION ALL SELECT 'Order', 'clerk', k FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders ORDER BY k LIMIT 20)")
def g01(spark, sf_dir):
    return quality.completeness(star(spark, sf_dir))


@query("g02_consistency", WITH + " SELECT type, edge_id FROM (SELECT 'placed' AS type, edge_id FROM edges WHERE type = 'supplier_of' ORDER BY edge_id LIMIT 20)")
def g02(spark, sf_dir):
    g = star(spark, sf_dir)
    bad = g.with_(edges=g.edges.where("type in ('supplier_of', 'in_region')").withColumn("type", F.when(F.col("type") == "supplier_of", "placed").otherwise(F.col("type"))))
    return quality.consistency(bad).select("type", "edge_id")


@query("g03_duplicates", WITH + " SELECT name, count(*) AS n FROM nodes GROUP BY name HAVING count(*) > 1 ORDER BY n DESC, name LIMIT 20")
def g03(spark, sf_dir):
    return quality.duplicates(star(spark, sf_dir)).select("name", "n")


@query("g04_low_confidence", WITH + " SELECT edge_id, type, round(confidence, 6) AS confidence FROM edges WHERE confidence < 0.6 - 0.05 ORDER BY edges.confidence, edge_id LIMIT 50")
def g04(spark, sf_dir):
    return quality.low_confidence(star(spark, sf_dir), 0.6 - 0.05).select("edge_id", "type", F.round("confidence", 6).alias("confidence"))


@query("g05_orphans", WITH + " SELECT node_id, label, name FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def g05(spark, sf_dir):
    return quality.orphans(star(spark, sf_dir))


@query("g06_temporal_conflicts", WITH + " SELECT edge_id FROM edges WHERE type = 'placed' AND valid_from > '1996'")
def g06(spark, sf_dir):
    g = star(spark, sf_dir)
    return quality.temporal_conflicts(g.with_(edges=g.edges.where("type = 'placed'").withColumn("valid_to", F.lit("1996")))).select("edge_id")


@query("g07_report_sections", WITH + ", d AS (SELECT count(*) AS c FROM (SELECT name FROM nodes GROUP BY name HAVING count(*) > 1 LIMIT 20)) SELECT 'completeness' AS section, (SELECT least(20, count(*)) FROM supplier) + (SELECT least(20, count(*)) FROM orders) AS n UNION ALL SELECT 'duplicates', c FROM d WHERE c > 0 UNION ALL SELECT 'low_confidence', count(*) FROM (SELECT 1 FROM edges WHERE confidence < 0.5 LIMIT 50) HAVING count(*) > 0 UNION ALL SELECT 'orphans', count(*) FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) HAVING count(*) > 0")
def g07(spark, sf_dir):
    return quality.report(star(spark, sf_dir))[0].groupBy("section").agg(F.count("*").alias("n"))


@query("j21_timeline", WITH + " SELECT edge_id, valid_from, a.name AS src_name, b.name AS dst_name FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE valid_from IS NOT NULL ORDER BY valid_from DESC, edge_id LIMIT 100")
def j21(spark, sf_dir):
    return quality.timeline(star(spark, sf_dir)).select("edge_id", "valid_from", "src_name", "dst_name")


@query("j22_entity_timeline", WITH + " SELECT edge_id, valid_from, b.name AS dst_name FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE valid_from IS NOT NULL AND a.node_id = 'Customer::1'")
def j22(spark, sf_dir):
    name = read(spark, sf_dir, "customer").where("c_custkey = 1").agg(F.min("c_name")).first()[0]
    return quality.entity_timeline(star(spark, sf_dir), name or "").select("edge_id", "valid_from", "dst_name")


# Communities ---------------------------------------------------------------------------------------------------

_COMPONENTS = ", q AS (SELECT node_id AS x, node_id AS y FROM sn UNION SELECT x, b FROM q JOIN (SELECT DISTINCT a, b FROM sboth) ON a = y), m AS (SELECT x, min(y) AS c FROM q GROUP BY x)"
_TREE = ", up AS (SELECT node_id, node_id AS top FROM sn WHERE label = 'Region' UNION ALL SELECT src, top FROM se JOIN up ON dst = node_id), m AS (SELECT u.node_id AS x, min(v.node_id) AS c FROM up u JOIN (SELECT top, min(node_id) AS node_id FROM up GROUP BY top) v ON v.top = u.top GROUP BY 1)"


@query("m03_components", WITH + _TREE + " SELECT x AS node_id, c AS component FROM m")
def m03(spark, sf_dir):
    return community.components(small_star(spark, sf_dir))


@query("m04_community_listing", WITH + _TREE + " SELECT c AS community, count(*) AS size FROM m GROUP BY c HAVING count(*) > 1")
def m04(spark, sf_dir):
    g = small_star(spark, sf_dir)
    return community.listing(g, community.components(g).withColumnRenamed("component", "community")).select("community", "size")


@query("m01_modularity", WITH + _TREE + ", l AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM se), k AS (SELECT count(*) AS k FROM l), d AS (SELECT c, count(*) AS d FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l) JOIN m USING (x) GROUP BY c), i AS (SELECT c, count(*) AS e FROM l JOIN m ON m.x = a GROUP BY c) SELECT round(sum(e / k - (d / (2 * k)) ** 2), 6) AS modularity FROM d JOIN i USING (c), k")
def m01(spark, sf_dir):
    g = small_star(spark, sf_dir)
    return community.modularity(g, community.components(g).withColumnRenamed("component", "community")).select(F.round("modularity", 6).alias("modularity"))


@query(
    "m03_components_of_all",
    WITH + ", b AS (SELECT a AS x, b AS y FROM both0), k AS (SELECT 'Customer::1' AS x UNION SELECT y FROM k JOIN b USING (x)), m AS (SELECT min(x) AS c FROM k) SELECT node_id, CASE WHEN node_id IN (SELECT x FROM k) THEN (SELECT c FROM m) ELSE node_id END AS component FROM nodes",
)
def m03a(spark, sf_dir):
    """All nodes and edges, hubs and cycles included; the SQL knows that one component has every edge."""
    return community.components(star(spark, sf_dir))


_VOTES = "".join(f", v{i} AS (SELECT a, c, count(*) AS n FROM e JOIN l{i} ON b = x GROUP BY a, c), w{i} AS (SELECT a, c FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, c) AS r FROM v{i}) WHERE r = 1), l{i + 1} AS (SELECT x, coalesce(w{i}.c, l{i}.c) AS c FROM l{i} LEFT JOIN w{i} ON a = x)" for i in range(3))


@query("m02_label_propagation", WITH + ", e AS (SELECT DISTINCT a, b FROM sboth), l0 AS (SELECT node_id AS x, node_id AS c FROM sn)" + _VOTES + " SELECT x AS node_id, c AS community FROM l3")
def m02(spark, sf_dir):
    return community.label_propagation(small_star(spark, sf_dir), 3)


@query("m02_louvain")
def m02l(spark, sf_dir):
    return community.louvain(small_star(spark, sf_dir))


@query("m06_community_context")
def m06(spark, sf_dir):
    g = small_star(spark, sf_dir)
    rows = community.listing(g, community.components(g).withColumnRenamed("component", "community"))
    return community.context(rows, read(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
