"""What the work of a query grows with: rows and bytes that its stages move, beside right results."""

from __future__ import annotations

import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisgraph.graph import Graph, edges_from, nodes_from
from trellisgraph.operators import community, extract, match, postings, search, training


def moved(spark, run):
    """What ``run`` gives, and the rows that its stages wrote to shuffles."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {i for j in sc.statusTracker().getJobIdsForGroup(group) for i in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    return out, sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages)


def graph(spark, nodes, edges):
    n = nodes_from(spark.createDataFrame(nodes, "node_id string, label string, name string"))
    e = edges_from(spark.createDataFrame([(f"{a}|{b}", a, b, "t") for a, b in edges], "edge_id string, src string, dst string, type string"))
    return Graph(n, e)


def test_shortest_path_does_not_widen_a_hub_for_every_source(spark):
    ends = [("hub", "Hub", "hub"), ("top", "Top", "top"), ("next", "Hub", "next"), ("last", "Top", "last")]
    leaves, sources = [(f"l{i}", "Leaf", f"l{i}") for i in range(1500)], [(f"s{i}", "Source", f"s{i}") for i in range(150)]
    links = [(x[0], "hub") for x in leaves + sources] + [("hub", "top"), ("hub", "next"), ("next", "last"), ("s0", "next")]
    g = graph(spark, ends + leaves + sources, links)
    got, rows = moved(spark, lambda: match.shortest_path(g, F.col("label") == "Source", F.col("label") == "Top", 3).collect())
    paths = {(x["source"], x["target"]): x["nodes"] for x in got}
    assert len(paths) == len(got) == 300 and paths["s0", "last"] == ["s0", "next", "last"] and paths["s1", "last"] == ["s1", "hub", "next", "last"]
    assert paths["s1", "top"] == ["s1", "hub", "top"] and rows < 100_000  # 150 x 1650 rows went through the hub


def test_texts_passed_over_hold_no_match(spark):
    r = random.Random(5)
    bits = ["RV", "rv-20", "SHG25", "减速器", "伺服", "电机", "reach", "REACH", " 12 mm", "MM", "ISO 9", "ſuR", "Kuka", "KUKA", "轴", "是", "M-20 ", "6", "点焊", "用于", "传感器", "力", "视觉", "型号：", "x", " ", "公司", "推出", "控制器", "R-30"]
    texts = spark.createDataFrame([(i, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(1500)] + [(-1, None)], "doc_id int, text string")
    rows = extract.hinted(texts, "doc_id", "text").cache()
    found = 0
    for _, pattern in extract.ENTITY_PATTERNS + training.NAME_PATTERNS:
        plain = "(?iuU)" + pattern.replace("?P<", "?<").replace("_", "")
        want = F.regexp_extract_all("text", F.lit(plain), F.lit(0))
        got = F.transform(extract.matches(F.col("text"), pattern, F.col("han"), F.col("low")), lambda m: m["name"])
        n, wrong = rows.agg(F.sum(F.size(want)), F.count_if(~F.size(got).eqNullSafe(F.size(want)))).first()
        assert not wrong, pattern
        found += n
    assert found > 2000
    assert extract.needed("(?:点焊)?x|a点") == [] and extract.needed("(?:A点|焊b)kMM") == [{"点", "焊"}, {"mm"}] and extract.first_letters("(?:a|bc)?d") is None


def test_names_are_worked_out_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(extract.entities(docs)).count("Relation [") == 1  # the texts were read twice
    spans = plan(training.pattern_spans(docs))
    assert not re.search(r"Filter .*aggregate\(", spans)  # a filter on the spans worked them out a second time


def test_funnel_works_rules_out_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = lambda d: d.select("doc_id", F.lit("Language").alias("type"), F.col("lang").alias("name"), F.create_map().cast("map<string,string>").alias("props"), F.lit(0.1).alias("confidence"), F.lit(0).cast("long").alias("ord"))
    assert "regexp_extract_all" not in extract.funnel(docs, model)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [None, 3])
def test_texts_are_scored_where_they_lie(spark, tmp_path, limit, monkeypatch):
    """Few queries over many words: the same rows as by joins of words, repeated ids and tokens of all kinds included."""
    r = random.Random(7)
    bits = ["Arm", "gear-x2", "点焊", "ſ", "K9", "É", "w1 w2", "\n", "don't", "", "w3", "3.5"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 40))) if i % 40 else None) for i in range(900)]
    queries = spark.createDataFrame([(1, "arm gear w3"), (2, "点 x2 x2 k9"), (3, "none"), (4, "焊 t don arm w1 5")], "query_id int, query string")
    key = lambda x: (x["query_id"], x["id"])
    for extra in ([], [(5, "w3 w3"), (5, rows[5][1])]):
        df = spark.createDataFrame(rows + extra, "id long, text string").repartition(3)
        got, n = moved(spark, lambda: {key(x): x["score"] for x in search.bm25(df, "id", F.col("text"), queries, limit=limit).collect()})
        index = postings.build(df, "id", F.col("text"), f"{tmp_path}/{len(extra)}", buckets=3, block=8)
        stored = {key(x): x["score"] for x in postings.search(index, queries, limit).collect()}
        joined = {key(x): x["score"] for x in postings.search(index, queries, limit, local_words=0).collect()}
        monkeypatch.setattr(search.local, "LOCAL_WORDS", 0)
        want = {key(x): x["score"] for x in search.bm25(df, "id", F.col("text"), queries, limit=limit).collect()}
        monkeypatch.undo()
        assert want and got == pytest.approx(want) and stored == pytest.approx(want) and joined == pytest.approx(want)
        if not extra:
            assert n < 6000  # the ids of the texts and few more; the words are 15,000


@pytest.mark.parametrize("plain", [True, False])
def test_vectors_are_chosen_in_tasks_and_scored_as_before(spark, plain):
    """The same rows as pair by pair, with equal vectors, other lengths, nulls and numbers that are none."""
    r = np.random.default_rng(3)
    odd = [None, [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [None, 1.0, 2.0, 3.0], [1.0, 2.0], [3e30] * 4, [1e-40] * 4]
    rows = [(f"k{i:04d}", [float(x) for x in r.normal(size=4).round(1)]) for i in range(700)] + [(f"x{i}", v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "id string, v array<float>").repartition(3)
    queries = df.where("id like '%3' or id like 'x%'").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    key = lambda x: (x["query_id"], x["rank"], x["id"], repr(x["score"]))
    found, n = moved(spark, lambda: search.vector_search(df, "id", "v", queries, 5, plain).collect())
    pairs = search._by_pairs(df.where(search.usable(F.col("v"))), queries, plain).withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, id)")).where("rank <= 5").collect()
    assert sorted(map(key, found)) == sorted(map(key, pairs)) and len(found) > 350
    plan = search.vector_search(df, "id", "v", queries, 5, plain)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_names_that_are_all_alike_are_compared_in_blocks(spark, monkeypatch):
    """Many names of one form, long ones, one with letters of three bytes, beside a type of different names."""
    r = random.Random(4)
    names = [("s", f"Supplier#{i:07d}") for i in range(0, 4000, 17)] + [("s", "SUPPLIER#0000017"), ("s", "Supplier点0000034"), ("s", "x" * 70 + "y"), ("s", "x" * 69 + "z")]
    names += [("t", "".join(r.choice("abcdefghij") for _ in range(14))) for _ in range(60)] + [("t", "abcdefghijkl"), ("t", "abcdefghijkm")]
    df = spark.createDataFrame(names, "type string, name string")
    few = lambda n, low, high, make=search._all_pairs: make(n, low, high, 50)
    monkeypatch.setattr(search, "_all_pairs", few)
    got, rows = moved(spark, lambda: {(x["type"], x["a"], x["b"]): x["score"] for x in search.fuzzy_duplicates(df).collect()})
    want = {}
    for t, a in names:
        for u, b in names:
            if t == u and a.encode() < b.encode():
                x, y = a.lower(), b.lower()
                s = 2 * search._subsequence(x, y) / (len(x) + len(y))
                if 0.85 <= s < 0.98:
                    want[t, a, b] = s
    assert got == pytest.approx(want) and len(want) > 8000
    assert rows < 40_000  # names met on their pieces in rows of an exchange, many for a pair


def test_windows_and_substrings_are_those_of_plain_loops(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcd点 #0") for _ in range(n))
    pairs = [(word(r.randint(0, 12)), word(r.randint(0, 30))) for _ in range(1500)] + [(word(64), word(90)), (word(65), word(90)), ("ab", "ab"), (None, "a"), ("", ""), (word(64), word(64))]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", search.partial_ratio("a", "b").alias("p"), search.longest_common("a", "b").alias("c"))

    def partial(x, y):
        x, y = sorted((x or "", y or ""), key=len)
        m, n = len(x), len(y)
        spans = [(i, i + m) for i in range(n - m + 1)] + [(0, k) for k in range(1, m)] + [(n - k, n) for k in range(1, m)]
        return max(2 * search._subsequence(x, y[i:j]) / (m + j - i) for i, j in spans) if x else 0.0

    def common(x, y):
        x, y = x or "", y or ""
        return next((x[i : i + n] for n in range(len(x), 0, -1) for i in range(len(x) - n + 1) if x[i : i + n] in y), "")

    for x in df.collect():
        assert x["p"] == partial(x["a"], x["b"]) and x["c"] == common(x["a"], x["b"]), x
    # all windows of many pairs at once: a loop over windows took 15 times as long
    assert len(search._partial_ratios([(word(18), word(40)) for _ in range(2000)])) == 2000


def test_questions_do_not_all_widen_a_hub(spark):
    from trellisgraph.operators import ask

    leaves = [f"l{i:04d}" for i in range(1000)]
    g = graph(spark, [("hub", "Hub", "hub")] + [(x, "Leaf", x) for x in leaves], [("hub", x) for x in leaves])
    seeds = spark.createDataFrame([(q, x) for q in range(200) for x in ("hub", leaves[q])], "question_id int, node_id string")
    got, rows = moved(spark, lambda: ask.trails_by_question(g, seeds, 2, 5).collect())
    of = lambda q: sorted(tuple(x["nodes"]) for x in got if x["question_id"] == q)
    assert len(got) == 200 * 5 and of(7) == [("hub", x) for x in leaves[:5]]
    one = ask.trails_by_question(g, seeds.where("question_id = 2 and node_id <> 'hub'"), 2, 5).collect()
    assert sorted(tuple(x["nodes"]) for x in one) == [(leaves[2], "hub")] + [(leaves[2], "hub", x) for x in [*leaves[:2], *leaves[3:5]]]
    assert rows < 20_000  # 200 questions times 1,000 leaves were sorted


def test_components_write_no_circles(spark):
    r = random.Random(8)
    nodes = [f"n{i}" for i in range(600)]
    edges = [(r.choice(nodes[k : k + 100]), r.choice(nodes[k : k + 100])) for k in range(0, 500, 100) for _ in range(1500)] + [("n500", "n501"), ("n501", "n502"), ("n503", "n503")]
    g = graph(spark, [(x, "N", x) for x in nodes], edges)
    least = {x: x for x in nodes}
    for _ in range(600):
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    for size in (1 << 20, 50):
        assert {x["node_id"]: x["component"] for x in community.components(g, size).collect()} == least
    links = g.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).coalesce(1)
    assert links.mapInArrow(community._stars(1 << 20), "a string, b string").count() <= 600 < community.simple_links(g).count()
