"""Stored indexes, many-pattern matching and retrieval for many questions, against plain Python and the one-question path."""

from __future__ import annotations

import random
import re
import tempfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisgraph.graph import sample
from trellisgraph.operators import ask, cells, patterns, postings, retrieve, search


def folder():
    return tempfile.mkdtemp(prefix="spark-") + "/index"


def test_occurrences(spark):
    r = random.Random(2)
    names = {"".join(r.choice("ab点 ") for _ in range(r.randint(1, 3))) for _ in range(25)}
    texts = [(i, "".join(r.choice("ab点 ") for _ in range(r.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "ab" * 30_000)]
    want = sorted((i, n, k, len(t)) for i, t in texts if t and i < 61 for n in names for k in range(len(t)) if t.startswith(n, k))
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    n = spark.createDataFrame([*[(x,) for x in names], ("",), (None,), (next(iter(names)),)], "name string")
    for size in (1 << 20, 60):
        got = patterns.occurrences(df, "id", "text", n, block_bytes=size)
        assert sorted(map(tuple, got.where("id < 61").collect())) == want
        assert got.where("id = 61 and name = 'ab'").count() == (30_000 if "ab" in names else 0)
        first = patterns.occurrences(df, "id", "text", n, first=True, block_bytes=size).where("id < 61").collect()
        least = {}
        for i, x, k, m in want:
            least[i, x] = min(k, least.get((i, x), k))
        assert {(x["id"], x["name"]): x["start"] for x in first} == least and len(first) == len(least)
    assert patterns.occurrences(df, "id", "text", n.limit(0)).count() == 0


def test_many_names_in_linear_memory(spark):
    names = spark.range(200_000).select(F.concat(F.lit("part "), F.col("id").cast("string"), F.lit(";")).alias("name"))
    text = spark.createDataFrame([(1, " ".join(f"part {k};" for k in range(0, 200_000, 20)))], "id int, text string")
    assert patterns.occurrences(text, "id", "text", names).count() == 10_000


WORDS = ["arm", "gear", "motor", "weld", "axis", "joint", "base", "load"]


def documents(seed, n=400):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) if r.random() < 0.8 else f"w{r.randrange(60)}" for _ in range(r.randint(0, 25))) if i % 50 else None) for i in range(n)]


QUERIES = [(1, "arm gear w3 w4"), (2, "arm"), (3, "w7"), (4, "arm motor weld axis joint base load gear"), (5, "absent words"), (6, ""), (7, None), (8, "W3 w3 ARM")]


@pytest.mark.parametrize("limit", [None, 1, 5, 1000])
def test_stored_index_gives_bm25(spark, limit):
    df = spark.createDataFrame(documents(1), "id long, text string")
    q = spark.createDataFrame(QUERIES, "query_id int, query string")
    key = lambda rows: sorted((x["query_id"], x["id"], round(x["score"], 9)) for x in rows)
    want = key(search.bm25(df, "id", F.col("text"), q, limit=limit).collect())
    assert want
    index = postings.build(df.where("id % 7 <> 0"), "id", F.col("text"), folder(), buckets=5, block=8)
    grown = index.with_new(df.where("id % 14 = 0"), "id", F.col("text")).with_new(df.where("id % 14 = 7"), "id", F.col("text"))
    assert key(postings.search(grown, q, limit).collect()) == want
    assert key(postings.search(grown.merged(folder()), q, limit).collect()) == want


def test_stored_index_reads_no_texts_and_few_buckets(spark):
    place, df = folder(), spark.createDataFrame(documents(3), "id long, text string")
    df.write.parquet(place + "-texts")
    index = postings.build(spark.read.parquet(place + "-texts"), "id", F.col("text"), place, buckets=16, block=8)
    found = postings.search(index, spark.createDataFrame([(1, "w7")], "query_id int, query string"), None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "-texts" not in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    empty = postings.build(df.limit(0), "id", F.col("text"), folder())
    assert postings.search(empty, spark.createDataFrame(QUERIES, "query_id int, query string"), 5).count() == 0


def vectors(seed, n=3000, dim=16):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(40, dim))
    x = centre[r.integers(0, 40, n)] + 0.35 * r.normal(size=(n, dim))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_vector_cells(spark):
    rows = vectors(4)
    df = spark.createDataFrame([*rows, (9001, None), (9002, [0.0] * 16), (9003, [1.0] * 3), (9004, [float("nan")] * 16)], "id long, v array<float>")
    q = spark.createDataFrame([(i, [c * 1.01 for c in v]) for i, v in rows[::50]], "query_id long, q array<float>")
    index = cells.build(df.where("id % 3 <> 0 or id > 9000"), "id", "v", folder(), cells=48, sample=1500)
    index.add(df.where("id % 3 = 0 and id < 9000"), "id", "v")
    assert index.vectors().count() == len(rows)
    exact = search.vector_search(df.where("id < 9004"), "id", "v", q, 10, normalized=False)
    key = lambda rows: {(x["query_id"], x["rank"]): (x["id"], round(x["score"], 6)) for x in rows.collect()}
    want = key(exact)
    assert key(cells.search(index, q, 10, normalized=False, exact=True)) == want
    found = cells.search(index, q, 10, probes=8, normalized=False)
    got = defaultdict(set)
    for (i, _), (j, _) in key(found).items():
        got[i].add(j)
    hit = sum(j in got[i] for (i, _), (j, _) in want.items()) / len(want)
    assert hit >= 0.9
    one = cells.search(index, q.limit(1), 10, probes=3, normalized=False)
    assert re.search(r"PartitionFilters: \[[^\]]*cell", one._jdf.queryExecution().executedPlan().toString())
    none = cells.build(df.limit(0), "id", "v", folder())
    assert cells.search(none, q, 5).count() == 0 and cells.search(index, q.limit(0), 5).count() == 0


QUESTIONS = [(1, "FANUC M-20iA uses which RV-40E reducer?"), (2, "ABB and KUKA"), (3, "点焊"), (4, "KUKA"), (5, "zzz"), (6, ""), (7, None), (8, "伺服"), (9, "FANUC M-20iA uses which RV-40E reducer?"), (None, "ABB")]


@pytest.fixture(scope="module")
def g(spark):
    return sample(spark)


@pytest.fixture(scope="module")
def found(spark, g):
    index = postings.build(g.nodes, "node_id", ask.node_text(), folder())
    return ask.seeds_of(spark.createDataFrame(QUESTIONS, "question_id long, question string"), g.nodes, index)


def test_seeds_of_many_questions(found):
    rows = defaultdict(list)
    for x in sorted(found.collect(), key=lambda x: (x["question_id"], x["rank"])):
        rows[x["question_id"]].append(x["name"])
    assert set(rows) == {1, 2, 3, 4, 8, 9} and all(len(x) <= 5 == len(x) or len(x) < 5 for x in rows.values())
    assert rows[1] == rows[9] and {"FANUC M-20iA", "RV-40E"} <= set(rows[1]) and {"ABB", "KUKA"} <= set(rows[2]) and "KUKA" in rows[4]
    assert rows[3][0] == "点焊" and "伺服焊枪" in rows[8]


def plain_trails(edges, seeds, hops, limit):
    out, level = [], [((s,), ()) for s in seeds]
    for h in range(1, hops + 1):
        level = [(ns + (b,), es + (e,)) for ns, es in level for e, a, b in edges if a == ns[-1] and e not in es]
        out += [(h, "|".join(ns), "|".join(es)) for ns, es in level]
    return sorted(out)[:limit]


@pytest.mark.parametrize("hops,limit", [(1, 20), (3, 20), (3, 4), (4, 60)])
def test_trails_by_question(spark, g, found, hops, limit):
    edges = [(x["edge_id"], x["a"], x["b"]) for x in g.both_ways().collect()]
    seeds = defaultdict(set)
    for x in found.collect():
        seeds[x["question_id"]].add(x["node_id"])
    got = defaultdict(list)
    for x in ask.trails_by_question(g, found, hops, limit).collect():
        got[x["question_id"]].append((x["hops"], "|".join(x["nodes"]), "|".join(x["edges"])))
    assert {k: sorted(v) for k, v in got.items()} == {k: t for k, v in seeds.items() if (t := plain_trails(edges, v, hops, limit))}


def test_contexts_equal_those_of_single_questions(g, found):
    got = defaultdict(list)
    for x in ask.contexts(g, found, max_hops=2).collect():
        got[x["question_id"]].append((x["rank"], x["marker"], x["line"], round(x["score"], 9)))
    seeds = defaultdict(set)
    for x in found.collect():
        seeds[x["question_id"]].add(x["node_id"])
    for k in seeds:
        want = retrieve.retrieve(g, sorted(seeds[k]), max_hops=2).collect()
        assert sorted(got[k]) == sorted((x["rank"], x["marker"], x["line"], round(x["score"], 9)) for x in want)
    assert set(got) == set(seeds) and len(got[4]) == 1 and "KUKA" in got[4][0][2]
