"""Retrieval for question answering: path scores, token budget, citations and their check, comparison of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.functions.text import citation_numbers, token_estimate
from trellisgraph.graph import Graph
from trellisgraph.operators.match import common_relations, public_props, trails

# Weights of relation types in a path's score.
RELATION_WEIGHTS = {
    "manufactures": 0.9,
    "uses_reducer": 0.9,
    "uses_servo": 0.9,
    "uses_controller": 0.85,
    "uses_sensor": 0.85,
    "uses_end_effector": 0.85,
    "applied_in": 0.75,
    "performs_process": 0.75,
    "uses_component": 0.7,
    "supplies_component": 0.7,
    "contains": 0.65,
    "component_compatible": 0.5,
    "competitor_of": 0.4,
    "subsidiary_of": 0.4,
    "uses_software": 0.6,
    "complies_with": 0.6,
    "process_requires": 0.7,
    "process_material": 0.6,
    "scenario_includes": 0.7,
}
# Properties shown on a path line, in order of preference.
SHOWN = ["payload", "reach", "repeatability", "axes", "rated_torque", "rated_power", "reducer_type", "application_type", "process_type", "country"]


def relation_weight(type_: Column) -> Column:
    table = F.create_map(*[x for k, v in RELATION_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, type_), F.lit(0.5))


def path_score(seed_share: Column, weight: Column, confidence: Column, hops: Column) -> Column:
    """0.35 seed share + 0.20 relation weight + 0.15 confidence + 0.30 length score (1.2 for no edge, less 0.2 each)."""
    return seed_share * 0.35 + weight * 0.20 + confidence * 0.15 + F.greatest(F.lit(0.0), 1.0 - (hops - 1) * 0.2) * 0.30


def scored_paths(g: Graph, paths: DataFrame, seeds: list[str] | Column) -> DataFrame:
    """``paths`` (nodes, edges as id arrays, hops, ...) with types, seed_share, weight, confidence and score.

    seeds: node ids, or a column of ``paths`` with those of the path's own question.
    Edge values are joined by id after a positional explode and put together again, so no wide rows are shuffled.
    """
    rows = paths.withColumn("path_id", F.xxhash64(F.array_join("nodes", "|"), F.array_join("edges", "|"), *[c for c in ("seed", "question_id") if c in paths.columns]))
    e = rows.select("path_id", F.posexplode("edges").alias("pos", "edge_id")).join(g.edges.select("edge_id", "type", "confidence"), "edge_id")
    per = e.groupBy("path_id").agg(F.avg(relation_weight(F.col("type"))).alias("weight"), F.avg(F.coalesce("confidence", F.lit(0.7))).alias("confidence"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]).alias("types"))
    names = F.array_distinct(F.array(*[F.lit(s) for s in seeds]).cast("array<string>") if isinstance(seeds, list) else seeds)
    share = F.size(F.array_intersect(F.array_distinct("nodes"), names)) / F.greatest(F.size(names), F.lit(1))
    out = rows.join(per, "path_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.5))).withColumn("confidence", F.coalesce("confidence", F.lit(0.7))).withColumn("seed_share", F.least(share, F.lit(1.0)))
    return out.withColumn("score", path_score(F.col("seed_share"), F.col("weight"), F.col("confidence"), F.col("hops")))


def path_lines(g: Graph, paths: DataFrame) -> DataFrame:
    """``paths`` (path_id, nodes, types) with ``line``: every node with up to two properties, arrows left to right."""
    shown = F.slice(F.filter(F.transform(F.array(*[F.lit(k) for k in SHOWN]), lambda k: F.when(F.coalesce(F.col("props")[k], F.lit("")) != "", F.concat(k, F.lit("="), F.col("props")[k]))), lambda x: x.isNotNull()), 1, 2)
    text = F.concat(F.lit("["), "label", F.lit("] "), "name", F.when(F.size(shown) > 0, F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")"))).otherwise(""))
    n = paths.select("path_id", F.posexplode("nodes").alias("pos", "node_id")).join(g.nodes.select("node_id", text.alias("t")), "node_id")
    texts = n.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("t"))
    rows = paths.join(texts, "path_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    return rows.withColumn("line", F.array_join(F.transform("t", lambda x, i: F.concat(x, F.when(i < F.size("types"), F.concat(F.lit("  --["), F.get("types", i), F.lit("]--> "))).otherwise(""))), " ")).drop("t")


def budgeted(rows: DataFrame, group: list[str], order: list[Column], text: str = "line", paths: int = 10, tokens: int = 2500) -> DataFrame:
    """``rows`` kept in order while their tokens fit: the first always, up to ``paths``; with ``marker`` P1, P2, ..."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(w))
    cost = token_estimate(F.concat(F.lit("P"), F.col("rank").cast("string"), F.lit(": "), F.col(text)))
    rows = rows.withColumn("tokens", cost).withColumn("spent", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where(F.col("rank") <= paths).where((F.col("rank") == 1) | (F.col("spent") <= tokens)).withColumn("marker", F.concat(F.lit("P"), F.col("rank").cast("string")))


def retrieve(g: Graph, seeds: list[str], max_hops: int = 2, found: int = 20, paths: int = 10, tokens: int = 2500) -> DataFrame:
    """(marker, rank, line, score, nodes, types): the context for the node ids ``seeds``, best first.

    Seeds without any path give paths of one node.
    """
    spark = g.nodes.sparkSession
    start = spark.createDataFrame([(s,) for s in seeds], "node_id string")
    t = trails(g, start, max_hops, found)
    alone = g.nodes.join(F.broadcast(start), "node_id", "left_semi")  # the seeds
    alone = alone.select(F.col("node_id").alias("seed"), F.lit(0).alias("hops"), F.col("node_id").alias("last"), F.array("node_id").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    n = t.agg(F.count("*").alias("_n"))
    t = t.unionByName(alone.crossJoin(F.broadcast(n)).where("_n = 0").drop("_n"))  # one row
    lines = path_lines(g, scored_paths(g, t, seeds))
    kept = budgeted(lines, [], [F.desc("score"), F.array_join("nodes", "|"), F.array_join("types", "|")], "line", paths, tokens)
    return kept.select("marker", "rank", "line", "score", "nodes", "types")


def fallback_answer(lines: Column) -> Column:
    """The degraded answer: the first five path lines."""
    return F.concat(F.lit("Related facts:\n"), F.array_join(F.slice(lines, 1, 5), "\n"))


# Capitalised words that name nothing, and Han characters of which a run names nothing.
COMMON_WORDS = ["THE", "AND", "FOR", "HAS", "ITS", "CAN", "ALL", "NOT", "THIS", "THAT", "WITH", "FROM", "WHEN", "WILL", "WHAT", "WHICH", "THEIR", "ABOUT", "THERE", "WOULD", "COULD"]
COMMON_HAN = "的了为是在有和与及或对从到被把让给向朝于由因以而能会可要就也都不但只仅还又更很太最极非每各某其之这那此该个种次回度倍率性化体量值数点线面位方式法"
#: What may be a name: a capital with two more word characters or hyphens, or two to six Han characters.
NAME = r"[A-Z][\p{L}\p{N}_\-]{2,}|[一-鿿]{2,6}"


def citations(answer: Column, around: int = 60) -> Column:
    """index, snippet of every ``[Pn]`` once, at its first place, in order; ``around`` characters either side of the mark."""
    number = citation_numbers(answer)

    def one(n: Column) -> Column:
        mark = F.concat(F.lit("[P"), n.cast("string"), F.lit("]"))
        # a number may be written with zeros before it
        place = F.regexp_instr(answer, F.concat(F.lit(r"\[P0*"), n.cast("string"), F.lit(r"\]")))
        length = F.length(F.coalesce(F.regexp_substr(answer, F.concat(F.lit(r"\[P0*"), n.cast("string"), F.lit(r"\]"))), mark))
        first = F.greatest(place - around, F.lit(1))
        return F.struct(n.alias("index"), F.btrim(F.substring(answer, first, place + length + around - first), F.lit(" \t\n\r\x0b\x0c")).alias("snippet"))

    return F.transform(number, one)


def possible_names(snippet: Column) -> Column:
    """The different tokens of a text that may name an entity, the first of each in either case."""
    found = F.regexp_extract_all(snippet, F.lit(NAME), F.lit(0))
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1)


def unsupported_names(snippet: Column, names: Column) -> Column:
    """Possible names of three characters or more that are no common words, are in no node's name and hold none."""
    lower = F.filter(F.transform(names, F.lower), lambda n: n != "")
    common = lambda x: F.upper(x).isin(COMMON_WORDS) | x.rlike(f"^[{COMMON_HAN}]+$")
    supported = lambda x: F.exists(lower, lambda n: F.contains(n, F.lower(x)) | F.contains(F.lower(x), n))
    return F.filter(possible_names(snippet), lambda x: (F.length(x) >= 3) & ~common(x) & ~supported(x))


def verified_citations(answers: DataFrame, paths: DataFrame) -> DataFrame:
    """(answer_id, index, verdict, issues) for answers (answer_id, answer) and paths (answer_id, index, nodes as names or
    null), one row for each answer and number.

    invalid_ref: no such path; empty_path: a null path; unsupported_entity: names near the mark (``issues``) that the path
    does not bear out; else ok.
    """
    c = answers.select("answer_id", F.inline(citations(F.col("answer"))))
    rows = c.join(paths.select("answer_id", "index", "nodes", F.lit(True).alias("_known")), ["answer_id", "index"], "left")
    issues = F.when(F.col("nodes").isNotNull(), unsupported_names(F.col("snippet"), F.col("nodes")))
    verdict = F.when(F.col("_known").isNull(), "invalid_ref").when(F.col("nodes").isNull(), "empty_path").when(F.size("issues") > 0, "unsupported_entity").otherwise("ok")
    return rows.withColumn("issues", issues).select("answer_id", "index", verdict.alias("verdict"), "issues")


def citation_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("answer_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "invalid_ref", "empty_path", "unsupported_entity")])


def citation_marks(answer: Column) -> Column:
    return citation_numbers(answer)


def compare(g: Graph, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(properties: prop, a, b, ord; relations: type, a_targets, b_targets) of two node ids; properties of a come first."""
    side = lambda node, name, base: g.nodes.where(F.col("node_id") == node).select(F.posexplode(public_props(F.col("props"))).alias("_o", "prop", name)).select("prop", name, (F.col("_o") + base).alias(f"_{name}"))
    props = side(a, "a", 0).join(side(b, "b", 1 << 20), "prop", "full")
    return props.select("prop", "a", "b", F.coalesce("_a", "_b").alias("ord")), common_relations(g, a, b)


def comparison_text(props: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the property table as Markdown."""
    line = F.concat(F.lit("| "), "prop", F.lit(" | "), F.coalesce("a", F.lit("-")), F.lit(" | "), F.coalesce("b", F.lit("-")), F.lit(" |"))
    head = f"| property | {a} | {b} |\n|-|-|-|\n"
    return props.select("ord", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("x")).select(F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("markdown"))
