"""The star schema as a property graph, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisgraph.graph import Graph, Ontology, edges_from, nodes_from

# The ontology of the projected graph.
STAR = Ontology(
    entity_types={
        "Region": "name!",
        "Nation": "name!",
        "Customer": "name!,segment,balance:float",
        "Supplier": "name!,balance:float,phone",
        "Part": "name!,brand,kind,size:integer",
        "Order": "name!,status,priority,clerk",
        "User": "name!",
        "EventType": "name!",
    },
    relation_types={"in_region": ("Nation", "Region"), "customer_of": ("Customer", "Nation"), "supplier_of": ("Supplier", "Nation"), "placed": ("Customer", "Order"), "contains": ("Order", "Part"), "supplies": ("Supplier", "Part"), "did": ("User", "EventType")},
    subclass_of={"Customer": "Party", "Supplier": "Party", "Nation": "Place", "Region": "Place"},
    transitive=["in_region", "customer_of"],
    symmetric=["supplies"],
    inverse={"placed": "placed_by", "supplier_of": "has_supplier"},
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _key(label: str, col: str):
    return F.concat(F.lit(f"{label}::"), F.col(col).cast("string"))


def star(spark: SparkSession, sf_dir: str, events: bool = False) -> Graph:
    """Nodes and edges of the star schema. A filter on label or type prunes the other tables from the union."""
    t = lambda name: read(spark, sf_dir, name)
    none = F.create_map().cast("map<string,string>")

    def node(df, label, key, name, **props):
        m = F.create_map(*[x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]) if props else none
        return df.select(_key(label, key).alias("node_id"), F.lit(label).alias("label"), F.array(F.lit(label)).alias("labels"), F.col(name).cast("string").alias("name"), F.lit("star").alias("domain"), m.alias("props"))

    def edge(df, type_, src, dst, confidence=None, since=None):
        start = F.date_format(F.col(since).cast("timestamp"), "yyyy-MM-dd") if since else F.lit(None).cast("string")
        row = df.select(_key(*src).alias("src"), _key(*dst).alias("dst"), (F.col(confidence) if confidence else F.lit(None)).cast("double").alias("confidence"), start.alias("valid_from"))
        return row.select(F.concat_ws("|", F.lit(type_), "src", "dst").alias("edge_id"), "src", "dst", F.lit(type_).alias("type"), F.lit("star").alias("domain"), "confidence", "valid_from")

    nodes = [
        node(t("region"), "Region", "r_name", "r_name"),
        node(t("nation"), "Nation", "n_name", "n_name"),
        node(t("customer"), "Customer", "c_custkey", "c_name", segment="c_mktsegment", balance="c_acctbal"),
        node(t("supplier"), "Supplier", "s_suppkey", "s_name", balance="s_acctbal"),
        node(t("part"), "Part", "p_partkey", "p_name", brand="p_brand", kind="p_type", size="p_size"),
        node(t("orders"), "Order", "o_orderkey", "o_orderkey", status="o_orderstatus", priority="o_orderpriority"),
    ]
    nation = t("nation")
    lines = t("lineitem")
    edges = [
        edge(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "in_region", ("Nation", "n_name"), ("Region", "r_name")),
        edge(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "customer_of", ("Customer", "c_custkey"), ("Nation", "n_name")),
        edge(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "supplier_of", ("Supplier", "s_suppkey"), ("Nation", "n_name")),
        edge(t("orders"), "placed", ("Customer", "o_custkey"), ("Order", "o_orderkey"), since="o_orderdate"),
        edge(lines.groupBy("l_orderkey", "l_partkey").agg(F.max(1 - 5 * F.col("l_discount")).alias("c")), "contains", ("Order", "l_orderkey"), ("Part", "l_partkey"), confidence="c"),
        edge(lines.select("l_suppkey", "l_partkey").distinct(), "supplies", ("Supplier", "l_suppkey"), ("Part", "l_partkey")),
    ]
    if events:
        e = t("events")
        nodes += [node(e.select("user_id").distinct(), "User", "user_id", "user_id"), node(e.select("event_type").distinct(), "EventType", "event_type", "event_type")]
        edges += [edge(e.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts")), "did", ("User", "user_id"), ("EventType", "event_type"), since="ts")]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return Graph(nodes_from(union(nodes)), edges_from(union(edges)), STAR)


def small_star(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers and suppliers: a forest with one tree a region."""
    g = star(spark, sf_dir)
    return g.with_(nodes=g.nodes.where(F.col("label").isin("Region", "Nation", "Customer", "Supplier")), edges=g.edges.where(F.col("type").isin("in_region", "customer_of", "supplier_of")))


NODES_SQL = """
nodes AS (
  SELECT 'Region::' || r_name AS node_id, 'Region' AS label, r_name AS name FROM region
  UNION ALL SELECT 'Nation::' || n_name, 'Nation', n_name FROM nation
  UNION ALL SELECT 'Customer::' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'Supplier::' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'Part::' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT 'Order::' || o_orderkey, 'Order', CAST(o_orderkey AS VARCHAR) FROM orders)"""
EDGES_SQL = """
edges0 AS (
  SELECT 'Nation::' || n_name AS src, 'Region::' || r_name AS dst, 'in_region' AS type, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS valid_from FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Customer::' || c_custkey, 'Nation::' || n_name, 'customer_of', NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier::' || s_suppkey, 'Nation::' || n_name, 'supplier_of', NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'Customer::' || o_custkey, 'Order::' || o_orderkey, 'placed', NULL, strftime(o_orderdate, '%Y-%m-%d') FROM orders
  UNION ALL SELECT 'Order::' || l_orderkey, 'Part::' || l_partkey, 'contains', max(1 - 5 * l_discount), NULL FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'Supplier::' || l_suppkey, 'Part::' || l_partkey, 'supplies', CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM lineitem),
edges AS (SELECT type || '|' || src || '|' || dst AS edge_id, * FROM edges0)"""
SMALL_SQL = NODES_SQL + "," + EDGES_SQL + """,
sn AS (SELECT * FROM nodes WHERE label IN ('Region', 'Nation', 'Customer', 'Supplier')),
se AS (SELECT * FROM edges WHERE type IN ('in_region', 'customer_of', 'supplier_of')),
both0 AS (SELECT edge_id, type, src AS a, dst AS b, 'out' AS direction FROM edges UNION ALL SELECT edge_id, type, dst, src, 'in' FROM edges WHERE src <> dst),
sboth AS (SELECT edge_id, type, src AS a, dst AS b FROM se UNION ALL SELECT edge_id, type, dst, src FROM se WHERE src <> dst)"""
WITH = "WITH RECURSIVE " + SMALL_SQL
