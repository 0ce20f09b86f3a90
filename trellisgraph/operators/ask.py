"""From a table of questions to their contexts: candidates, linking, hybrid search, trails, scores and budget.

Every step is keyed by question_id, so a plan serves all questions at once; nothing is done question by question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.graph import Graph
from trellisgraph.lineage import cut
from trellisgraph.operators import cells, postings
from trellisgraph.operators.answers import with_linked
from trellisgraph.operators.patterns import occurrences
from trellisgraph.operators.retrieve import budgeted, path_lines, scored_paths
from trellisgraph.operators.search import span_links


def node_text():
    """The text of a node that its index holds."""
    return F.concat_ws(" ", "name", F.col("props")["description"])


def _first(order: list, group: list[str]):
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))


def containing(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, node_id, label, name) of names that contain the whole question as it is; none for an empty one."""
    found = occurrences(nodes, "node_id", "name", questions, "question", first=True).select(F.col("id").alias("node_id"), F.col("name").alias("question"))
    return found.join(questions.select("question_id", "question"), "question").join(nodes.select("node_id", "label", "name"), "node_id").select("question_id", "node_id", "label", "name")


def keyword_hits(nodes: DataFrame, questions: DataFrame, index: postings.Index, limit: int = 20) -> DataFrame:
    """(question_id, node_id, label, name, score, rank) from the index of ``node_text``; the texts are not read."""
    found = postings.search(index, questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query")), limit)
    return found.select(F.col("query_id").alias("question_id"), F.col("id").alias("node_id"), "score", "rank").join(nodes.select("node_id", "label", "name"), "node_id").select("question_id", "node_id", "label", "name", "score", "rank")


def candidates(nodes: DataFrame, questions: DataFrame, hits: DataFrame, most: int = 200, few: int = 5) -> DataFrame:
    """(question_id, node_id, label, name): keyword ``hits``, the first of each name, and for questions with under ``few``
    of them names that contain the question, by id, up to ``most`` in all."""
    hits = hits.withColumn("_n", _first(["rank"], ["question_id", "name"])).where("_n = 1").select("question_id", "node_id", "label", "name")
    have = hits.groupBy("question_id").agg(F.count("*").alias("_have"))
    short = questions.select("question_id", "question").join(have, "question_id", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where(F.col("_have") < few)
    more = containing(nodes, short).withColumn("_place", _first(["node_id"], ["question_id"]))
    more = more.join(short.select("question_id", "_have"), "question_id").where(F.col("_place") <= most - F.col("_have"))
    more = more.join(hits.select("question_id", "name"), ["question_id", "name"], "left_anti").withColumn("_n", _first(["node_id"], ["question_id", "name"])).where("_n = 1")
    return hits.unionByName(more.select("question_id", "node_id", "label", "name"))


def linked(questions: DataFrame, found: DataFrame, top: int = 10, min_score: float = 70.0) -> DataFrame:
    """(question_id, name, span, score, ord) of the candidates that a part of the question names, best first."""
    pairs = found.join(questions.select("question_id", "question"), "question_id").select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "name")
    return span_links(pairs, top, min_score).select(F.col("query_id").alias("question_id"), "name", "span", "score", F.col("rank").alias("ord"))


def hybrid_hits(vector: DataFrame | None, keyword: DataFrame, limit: int) -> DataFrame:
    """(question_id, node_id, label, name, score, source, rank): vector hits, then keyword hits, the first of each name."""
    wanted = ["question_id", "node_id", "label", "name", "score", "rank"]
    rows = keyword.select(*wanted, F.lit("fulltext").alias("source"), F.lit(1).alias("_s"))
    if vector is not None:
        rows = vector.select(*wanted, F.lit("vector").alias("source"), F.lit(0).alias("_s")).unionByName(rows)
    rows = rows.where(F.col("rank") <= limit).withColumn("_f", _first(["_s", "rank"], ["question_id", "name"])).where("_f = 1")
    return rows.withColumn("rank", _first(["_s", "rank"], ["question_id"])).where(F.col("rank") <= limit).drop("_s", "_f")


def trails_by_question(g: Graph, seeds: DataFrame, max_hops: int = 3, limit: int = 20) -> DataFrame:
    """(question_id, seed, hops, last, nodes, edges): of each question's undirected trails from its seeds (question_id,
    node_id) the ``limit`` with fewest hops, ties by path.

    After every hop a question keeps what fills its limit; a full one goes no further, so one that goes on has fewer than
    ``limit`` trails and a hub is met by no more rows than that. Trails that go on from one node in one way stand in the
    order of their next node and edge, so of each node only the first edges are met: ``limit``, and one for each edge that
    a trail may hold already. Levels are written out.
    """
    both = g.both_ways().select("edge_id", "a", "b")
    level = seeds.select("question_id", F.col("node_id").alias("seed")).distinct()
    level = level.select("question_id", "seed", F.col("seed").alias("last"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(limit).alias("_left"))
    rank = _first([F.array_join("nodes", "|"), F.array_join("edges", "|")], ["question_id"])
    out = None
    for hops in range(1, max_hops + 1):
        ways = both.join(level.select(F.col("last").alias("a")).distinct(), "a", "left_semi")
        ways = ways.withColumn("_w", _first(["b", "edge_id"], ["a"])).where(F.col("_w") < limit + hops).drop("_w")
        step = level.join(ways, F.col("last") == F.col("a")).where(~F.array_contains("edges", F.col("edge_id")))
        step = step.select("question_id", "seed", F.col("b").alias("last"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"), "_left")
        step = cut(step.withColumn("_r", rank).where(F.col("_r") <= limit).where(F.col("_r") <= F.col("_left")).drop("_r"))
        rows = step.withColumn("hops", F.lit(hops)).drop("_left")
        out = rows if out is None else out.unionByName(rows)
        if hops < max_hops:
            full = Window.partitionBy("question_id")  # at most ``limit`` rows
            level = step.withColumn("_left", F.col("_left") - F.count("*").over(full).cast("int")).where("_left > 0")
            if level.isEmpty():
                break
    return out.select("question_id", "seed", "hops", "last", "nodes", "edges")


def seeds_of(questions: DataFrame, nodes: DataFrame, index: postings.Index, vectors: cells.Cells | None = None, top_k: int = 5, probes: int = 8) -> DataFrame:
    """(question_id, node_id, label, name, score, source, rank): what each question's search starts from, at most ``top_k``.

    Keyword hits are names that contain the question where the index has none; vector hits need ``vectors`` and a column
    ``q`` of ``questions``. Linked names that search missed go to the front.
    """
    questions = cut(questions.where(F.col("question_id").isNotNull() & F.col("question").isNotNull()))
    hits = cut(keyword_hits(nodes, questions, index, 20))
    known = cut(candidates(nodes, questions, hits))
    names = linked(questions, known)
    spare = known.join(hits.select("question_id").distinct(), "question_id", "left_anti").withColumn("score", F.lit(1.0)).withColumn("rank", _first(["node_id"], ["question_id"]))
    keyword = hits.unionByName(spare.select(*hits.columns))
    near = None
    if vectors is not None:
        best = cells.search(vectors, questions.select(F.col("question_id").alias("query_id"), "q"), top_k, probes, normalized=False)
        near = best.select(F.col("query_id").alias("question_id"), F.col("id").alias("node_id"), "score", "rank").join(nodes.select("node_id", "label", "name"), "node_id")
    found = cut(hybrid_hits(near, keyword, top_k))
    merged = with_linked(names, found, top_k)
    ids = known.select("question_id", "name", "node_id", "label", F.lit(1).alias("_s")).unionByName(found.select("question_id", "name", "node_id", "label", F.lit(0).alias("_s")))
    ids = ids.withColumn("_f", _first(["_s", "node_id"], ["question_id", "name"])).where("_f = 1")
    return cut(merged.join(ids.select("question_id", "name", "node_id", "label"), ["question_id", "name"])).select("question_id", "node_id", "label", "name", "score", "source", "rank")


def contexts(g: Graph, seeds: DataFrame, max_hops: int = 3, found: int = 20, paths: int = 10, tokens: int = 2500) -> DataFrame:
    """(question_id, marker, rank, line, score, nodes, types) for seeds (question_id, node_id), best first.

    A question none of whose seeds has an edge gets paths of one node; one without seeds gets no row.
    """
    t = trails_by_question(g, seeds, max_hops, found)
    alone = seeds.select("question_id", "node_id").distinct().join(t.select("question_id").distinct(), "question_id", "left_anti")
    none = F.array().cast("array<string>")
    t = t.unionByName(alone.select("question_id", F.col("node_id").alias("seed"), F.lit(0).alias("hops"), F.col("node_id").alias("last"), F.array("node_id").alias("nodes"), none.alias("edges")))
    own = seeds.groupBy("question_id").agg(F.collect_set("node_id").alias("seeds"))  # at most top_k
    rows = cut(path_lines(g, scored_paths(g, t.join(own, "question_id"), F.col("seeds"))))
    kept = budgeted(rows, ["question_id"], [F.desc("score"), F.array_join("nodes", "|"), F.array_join("types", "|"), F.array_join("edges", "|")], "line", paths, tokens)
    return kept.select("question_id", "marker", "rank", "line", "score", "nodes", "types")


def retrieve_all(g: Graph, questions: DataFrame, index: postings.Index, vectors: cells.Cells | None = None, top_k: int = 5, max_hops: int = 3, found: int = 20, paths: int = 10, tokens: int = 2500) -> DataFrame:
    """The contexts of all ``questions`` (question_id, question[, q]): link, hybrid search, seeds, trails, scores, budget."""
    return contexts(g, seeds_of(questions, g.nodes, index, vectors, top_k), max_hops, found, paths, tokens)
