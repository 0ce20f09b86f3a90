"""Pattern matching: hops, neighbours, trails, shortest paths and subgraphs.

Edges meet their ends by equi-joins on node ids. Seeds are filtered first, so each further hop starts from the rows
that the hop before left; hubs spread over tasks, since AQE splits the skewed side of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.graph import Graph
from trellisgraph.lineage import cut


def get_node(g: Graph, label: str, name: str) -> DataFrame:
    """The nodes of a label with a name; an added parent label matches too."""
    return g.nodes.where((F.col("label") == label) | F.array_contains("labels", label)).where(F.col("name") == name)


def one_hop(g: Graph, type_: str | None = None, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
    """(edge_id, type, src, src_name, src_label, dst, dst_name, dst_label) of (a)-[r]->(b)."""
    e = g.edges if type_ is None else g.edges.where(F.col("type") == type_)
    a = g.nodes.select(F.col("node_id").alias("src"), F.col("name").alias("src_name"), F.col("label").alias("src_label"))
    b = g.nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name"), F.col("label").alias("dst_label"))
    if src_label:
        a = a.where(F.col("src_label") == src_label)
    if dst_label:
        b = b.where(F.col("dst_label") == dst_label)
    return e.select("edge_id", "type", "src", "dst").join(a, "src").join(b, "dst").select("edge_id", "type", "src", "src_name", "src_label", "dst", "dst_name", "dst_label")


def neighbors(g: Graph, label: str, name: str, direction: str = "both", type_: str | None = None, limit: int | None = None) -> DataFrame:
    """(node_id, label, name, type, direction) of the nodes next to one; a self-loop once. Ordered when limited."""
    seed = get_node(g, label, name).select(F.col("node_id").alias("a"))
    e = g.both_ways() if direction == "both" else g.both_ways().where(F.col("direction") == direction)
    if direction == "in":  # a loop is an edge into the node as well
        loops = g.edges.where("src = dst").select("edge_id", "type", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("in").alias("direction"))
        e = e.unionAll(loops)
    if type_:
        e = e.where(F.col("type") == type_)
    out = e.join(seed, "a", "left_semi").join(g.nodes.select(F.col("node_id").alias("b"), "label", "name"), "b")
    out = out.select(F.col("b").alias("node_id"), "label", "name", "type", "direction")
    return out.orderBy("type", "direction", "node_id").limit(limit) if limit else out


def two_hop_open(g: Graph, type_: str) -> DataFrame:
    """(a, mid, c): a-[type]->mid-[type]->c with a <> c and no edge a-[type]->c yet."""
    e = g.edges.where(F.col("type") == type_).select("src", "dst", "edge_id")
    first = e.toDF("a", "mid", "e1")
    second = e.toDF("mid", "c", "e2")
    known = e.select(F.col("src").alias("a"), F.col("dst").alias("c")).distinct()
    return first.join(second, "mid").where("a <> c and e1 <> e2").join(known, ["a", "c"], "left_anti").select("a", "mid", "c")


def trails(g: Graph, seeds: DataFrame, max_hops: int = 3, limit: int | None = None, strict: bool = False, wanted: int | None = None) -> DataFrame:
    """Undirected trails of 1..max_hops edges from ``seeds`` (node_id): each edge once, nodes may repeat.

    Columns seed, hops, last, nodes (ids), edges (ids). strict: empty unless all ``wanted`` seeds exist, as one
    comma-joined pattern would be. A limit takes the fewest hops, ties by path.
    """
    both = g.both_ways().select("edge_id", "a", "b")
    have = seeds.select(F.col("node_id").alias("seed"))
    if strict:
        n = have.join(g.nodes.select(F.col("node_id").alias("seed")), "seed", "left_semi").agg(F.count("*").alias("n"))
        have = have.crossJoin(F.broadcast(n)).where(F.col("n") >= (wanted if wanted is not None else 0)).drop("n")  # n is one row
    level = have.select("seed", F.col("seed").alias("last"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    out, missing = None, limit
    for hops in range(1, max_hops + 1):
        step = level.join(both, F.col("last") == F.col("a")).where(~F.array_contains("edges", F.col("edge_id")))
        level = step.select("seed", F.col("b").alias("last"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"))
        if limit:  # longer trails come last, so a level that fills the limit ends the search
            level = cut(level)
        rows = level.withColumn("hops", F.lit(hops))
        out = rows if out is None else out.unionByName(rows)
        if limit:
            missing -= level.limit(missing).count()
            if not missing:
                break
    out = out.select("seed", "hops", "last", "nodes", "edges")
    return out.orderBy("hops", F.array_join("nodes", "|"), F.array_join("edges", "|")).limit(limit) if limit else out


def shortest_path(g: Graph, source: Column, target: Column, max_depth: int = 5) -> DataFrame:
    """(source, target, hops, nodes) of one shortest undirected path for each matched pair; ties by the least node list.

    Level by level over all sources at once: the frontier joins the edges, nodes a source reached before are dropped, and
    of several ways into a node the least stays. A search over all targets at once says before that how far each node is
    from the next target; a level goes only to nodes from which one is in reach, so a hub's other neighbours are met once
    and not once a source.
    """
    both = cut(g.both_ways().select("a", "b").distinct())
    ends = g.nodes.where(target).select(F.col("node_id").alias("target"))
    level = near = ends.select(F.col("target").alias("b"), F.lit(0).alias("far"))
    for far in range(1, max_depth):
        level = cut(both.join(level, "b").select(F.col("a").alias("b")).distinct().join(near, "b", "left_anti").withColumn("far", F.lit(far)))
        near = near.unionByName(level)
    start = g.nodes.where(source).select(F.col("node_id").alias("source"))
    frontier = start.select("source", F.col("source").alias("last"), F.array("source").alias("nodes"))
    seen = frontier.select("source", "last")
    found = frontier.withColumn("hops", F.lit(0))
    for hops in range(1, max_depth + 1):
        useful = both.join(near.where(F.col("far") <= max_depth - hops).select("b").distinct(), "b", "left_semi")
        step = frontier.join(useful, F.col("last") == F.col("a")).select("source", F.col("b").alias("last"), F.concat("nodes", F.array("b")).alias("nodes"))
        frontier = step.join(seen, ["source", "last"], "left_anti").groupBy("source", "last").agg(F.min("nodes").alias("nodes"))
        seen = seen.unionAll(frontier.select("source", "last"))
        found = found.unionByName(frontier.withColumn("hops", F.lit(hops)))
    return found.join(ends, F.col("last") == F.col("target")).where("source <> target").select("source", "target", "hops", "nodes")


def shortest_paths(g: Graph, pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """(source, target, hops, nodes) of one shortest undirected path for each of ``pairs`` (source, target); ties by the
    least node list. Pairs with a null end, with equal ends or with none within ``max_depth`` edges have no row.

    Two searches a pair, one from each end. A round widens the smaller frontier of every pair by one edge and drops nodes
    that search had before; of several ways into a node the least stays. A pair whose frontiers meet is done and takes
    part no more, as is one whose frontier is empty. Rounds are written out, so a plan never grows; no node is widened
    for a pair twice.
    """
    both = g.both_ways().select("a", "b").distinct()
    pairs = pairs.select("source", "target").where("source <> target").distinct()
    start = pairs.select("source", "target", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("node")), F.struct(F.lit(1).alias("side"), F.col("target").alias("node")))).alias("x"))
    frontier = cut(start.select("source", "target", "x.side", "x.node", F.array("x.node").alias("nodes")))
    seen, found, pair = frontier.select("source", "target", "side", "node"), [], ["source", "target"]
    for hops in range(1, max_depth + 1):
        size = frontier.groupBy(*pair).agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        turn = size.where("n0 > 0 and n1 > 0").select(*pair, F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1).alias("turn"))
        live = cut(frontier.join(turn, pair))
        if live.isEmpty():
            break
        longer = F.when(F.col("side") == 0, F.concat("nodes", F.array("b"))).otherwise(F.concat(F.array("b"), "nodes"))
        step = live.where("side = turn").join(both, F.col("node") == F.col("a")).select(*pair, "side", F.col("b").alias("node"), longer.alias("nodes"))
        step = step.groupBy(*pair, "side", "node").agg(F.min("nodes").alias("nodes")).join(seen, [*pair, "side", "node"], "left_anti")
        rest = live.where("side <> turn").select(*pair, "side", "node", "nodes")
        frontier = cut(step.unionByName(rest))
        ahead, back = (frontier.where(F.col("side") == k).select(*pair, "node", F.col("nodes").alias(f"_{k}")) for k in (0, 1))
        met = ahead.join(back, [*pair, "node"]).groupBy(*pair).agg(F.min(F.concat("_0", F.slice("_1", F.lit(2), F.size("_1")))).alias("nodes"))
        met = cut(met)
        found.append(met.select(*pair, F.lit(hops).alias("hops"), "nodes"))
        frontier = frontier.join(met.select(*pair), pair, "left_anti")
        seen = seen.unionByName(frontier.select(*seen.columns)).distinct()
        if hops < max_depth:
            seen = cut(seen.join(frontier.select(*pair).distinct(), pair, "left_semi"))
    out = found[0] if found else pairs.limit(0).select(*pair, F.lit(0).alias("hops"), F.array("source").alias("nodes"))
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def reach(g: Graph, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(seed, node_id, hops): every node within max_hops of each seed, with its least distance."""
    both = g.both_ways().select("a", "b").distinct()
    level = seeds.select(F.col("node_id").alias("seed"), "node_id").withColumn("hops", F.lit(0))
    out = level
    for hops in range(1, max_hops + 1):
        step = level.join(both, F.col("node_id") == F.col("a")).select("seed", F.col("b").alias("node_id")).distinct()
        level = cut(step.join(out, ["seed", "node_id"], "left_anti").withColumn("hops", F.lit(hops)))
        out = out.unionByName(level)
    return out


def subgraph(g: Graph, seeds: DataFrame, max_hops: int = 2, limit: int | None = None, raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) on the trails from ``seeds``; raw keeps an edge once for every trail. An isolated seed gives none.

    Without a limit and without ``raw`` no trail is listed: what lies on one is found from least distances, the edges
    with an end less than ``max_hops`` from a seed.
    """
    if limit is None and not raw:
        near = reach(g, seeds, max_hops - 1).select("node_id").distinct()
        ends = g.edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node_id"))
        edges = g.edges.join(ends.join(near, "node_id", "left_semi").select("edge_id").distinct(), "edge_id", "left_semi")
        ids = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        return g.nodes.join(ids, "node_id", "left_semi"), edges
    t = trails(g, seeds, max_hops, limit)
    nodes = t.select(F.explode("nodes").alias("node_id")).distinct()
    edges = t.select(F.explode("edges").alias("edge_id"))
    edges = edges if raw else edges.distinct()
    return g.nodes.join(nodes, "node_id", "left_semi"), g.edges.join(edges, "edge_id")


def keyword_subgraph(g: Graph, hits: DataFrame, max_hops: int = 1, expand: int = 3) -> tuple[DataFrame, DataFrame]:
    """Around the best ``hits`` (node_id, rank): the first ``expand`` are widened, the others kept alone; edges once
    for each (src, dst, type)."""
    nodes, edges = subgraph(g, hits.where(F.col("rank") <= expand).select("node_id"), max_hops)
    ids = nodes.select("node_id").unionByName(hits.select("node_id")).distinct()
    first = Window.partitionBy("src", "dst", "type").orderBy("edge_id")
    return g.nodes.join(ids, "node_id", "left_semi"), edges.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def full_graph(g: Graph, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` nodes and 3 * limit edges by id, and the ends of these edges."""
    edges = g.edges.orderBy("edge_id").limit(3 * limit)
    ids = g.nodes.select("node_id").orderBy("node_id").limit(limit)
    ids = ids.unionAll(edges.select("src")).unionAll(edges.select("dst")).distinct()
    return g.nodes.join(ids, "node_id", "left_semi"), edges


def visible(g: Graph, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose label is not hidden, and edges between them."""
    nodes = g.nodes.where(~F.col("label").isin(hidden))
    ids = nodes.select("node_id")
    edges = g.edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return nodes, edges


def seed_product(g: Graph, names: list[str]) -> DataFrame:
    """One row with the node ids of all names, for every way to match them; empty if any is missing."""
    out = None
    for i, name in enumerate(names):
        one = g.nodes.where(F.col("name") == name).select(F.col("node_id").alias(f"n{i}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # a name's nodes: one for each label and domain
    return out


def common_relations(g: Graph, a: str, b: str, most: int = 5) -> DataFrame:
    """(type, a_targets, b_targets) of the relation types two nodes share, at most ``most`` targets each, either way."""

    def side(node: str, name: str) -> DataFrame:
        rows = g.both_ways().where(F.col("a") == node).join(g.nodes.select(F.col("node_id").alias("b"), "name"), "b")
        return rows.groupBy("type").agg(F.slice(F.array_sort(F.collect_set("name")), 1, most).alias(name))

    return side(a, "a_targets").join(side(b, "b_targets"), "type")


def display_labels(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != "Entity")


def primary_label(labels: Column) -> Column:
    """The first label that is not ``Entity``, else the first."""
    return F.coalesce(F.get(display_labels(labels), F.lit(0)), F.get(labels, F.lit(0)))


def public_props(props: Column) -> Column:
    """Properties without internal (underscore) ones and without nulls."""
    return F.map_filter(props, lambda k, v: ~F.startswith(k, F.lit("_")) & v.isNotNull())


def node_key(label: Column, name: Column) -> Column:
    return F.concat_ws("::", label, name)
