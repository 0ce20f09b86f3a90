"""Similarity, spans, samples and answers against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisgraph.functions import text as fn
from trellisgraph.graph import Graph, edges_from, nodes_from
from trellisgraph.operators import answers, match, retrieve, search, training, write
from trellisgraph.sources import files


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 2 * subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    if not a or not b:
        return 0.0
    a, b = sorted((a, b), key=len)
    n = len(a)
    return max(ratio(a, w) for w in [b[i : i + n] for i in range(len(b) - n + 1)] + [b[:k] for k in range(1, n)] + [b[-k:] for k in range(1, n)])


def test_ratios(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(150)] + [(None, "a"), ("", ""), ("abc", "xxabcxx")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", search.indel_ratio("a", "b").alias("i"), search.partial_ratio("a", "b").alias("p"))
    for x in df.collect():
        a, b = x["a"] or "", x["b"] or ""
        assert x["i"] == pytest.approx(ratio(a, b)) and x["p"] == pytest.approx(partial(a, b))


def test_fuzzy_duplicates(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 24))) for _ in range(40)]

    def edited(w):
        w = list(w)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = [r.choice("abcdefgh")] * r.randint(0, 1)
        return "".join(w)

    words = sorted({w for w in [*base, *map(edited, base), *map(str.upper, base[:10])] if w})
    got = {(x["a"], x["b"]): x["score"] for x in search.fuzzy_duplicates(spark.createDataFrame([("t", w) for w in words], "type string, name string")).collect()}
    want = {(a, b): s for i, a in enumerate(words) for b in words[i + 1 :] if 0.85 <= (s := ratio(a.lower(), b.lower())) < 0.98}
    assert set(got) == set(want) and len(want) > 10 and all(got[k] == pytest.approx(v) for k, v in want.items())


def apart(candidates):
    kept = []
    for s, e, label in candidates:
        if not any(a < e and s < b for a, b, _ in kept):
            kept.append((s, e, label))
    return kept


def test_dictionary_spans(spark):
    texts = {1: "aXa aXa b", 2: "none", 3: "ababab abab", 4: ""}
    names = [(1, 0, "aXa", "Robot"), (1, 1, "Xa b", "Part"), (1, 2, "a", "Part"), (3, 0, "abab", "Robot"), (3, 1, "ab", "Part"), (3, 2, "ba", "Nothing"), (4, 0, "ab", "Part")]
    want = {}
    for i, t in texts.items():
        found = []
        for k, _, name, kind in names:
            if k == i and len(name) >= 2 and kind in training.LABELS:
                found += [(p, p + len(name), training.LABELS[kind]) for p in range(len(t) - len(name) + 1) if t[p : p + len(name)] == name]
        if apart(found):
            want[i] = apart(found)
    rows = training.dictionary_spans(spark.createDataFrame(list(texts.items()), "text_id int, text string"), spark.createDataFrame(names, "text_id int, ord int, name string, type string"))
    assert {x["text_id"]: [tuple(s) for s in x["spans"]] for x in rows.collect()} == want and len(want) == 2


LINES = ["FANUC M-20iA 是 6 轴机器人，配备力矩传感器。", "  安川推出 GP180 负载 180 kg  ", "short", "伺服电机型号：SGM7 与 RV-40E 减速器，符合 ISO 10218-1 标准", "用于汽车焊接和点焊", "Your english line ends here. R-30iB Plus"]


def test_pattern_spans_and_prefilter(spark):
    text = "\n".join(LINES)
    got = {x["text"]: [tuple(s) for s in x["spans"]] for x in training.pattern_spans(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    want = {}
    for line in map(str.strip, LINES):
        if len(line) < 10:
            continue
        found = [(*m.span("name"), training.LABELS[kind]) for kind, p in training.NAME_PATTERNS for m in re.finditer(p, line, re.IGNORECASE) if len(m["name"].strip()) >= 2 and kind in training.LABELS]
        if apart(found):
            want[line] = apart(found)
    assert got == want and len(want) >= 4
    names = {(x["type"], x["name"]) for x in training.prefiltered(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert names == {(kind, m["name"].strip()) for kind, p in training.NAME_PATTERNS for m in re.finditer(p, text, re.IGNORECASE) if len(m["name"].strip()) >= 2}


def test_split(spark):
    rows = training.split(spark.range(5000), ["id"], 0.2)
    n = {x["part"]: x["count"] for x in rows.groupBy("part").count().collect()}
    assert n["train"] + n["test"] == 5000 and 900 < n["test"] < 1100
    assert rows.exceptAll(training.split(spark.range(5000).repartition(3), ["id"], 0.2)).count() == 0


def test_overlapping_chunks(spark):
    r = random.Random(4)
    texts = ["", " \n", "short", "x" * 50, *("".join(r.choice("ab \n") if r.random() < 0.1 else "c" for _ in range(r.randint(40, 300))) for _ in range(30))]

    def plain(t, size, overlap, look):
        if len(t) <= size:
            return [t] if t.strip() else []
        out, start = [], 0
        while start < len(t):
            end = start + size
            if end < len(t):
                cut = t.rfind("\n", max(end - look, start), end)
                end = cut if cut > start else end
            if t[start:end].strip():
                out.append(t[start:end].strip())
            start = max(end - overlap, start + 1)
        return out

    for size, overlap, look in ((40, 10, 12), (30, 0, 30), (50, 45, 20)):
        got = [x["c"] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.overlapping_chunks(F.col("t"), size, overlap, look).alias("c")).collect()]
        assert got == [plain(t, size, overlap, look) for t in texts]


def test_small_parts(spark):
    log = spark.createDataFrame([("a", "s"), ("b", None), ("c", "t")], "name string, source string")
    assert sorted(x["name"] for x in write.delete_log(log, "s").collect()) == ["b", "c"]
    assert answers.audit_record(spark, "u", "delete", "x", 200, "now").count() == 1
    assert answers.metric_means(spark.createDataFrame([], "faithfulness double, answer_relevancy double, context_precision double, overall double")).first()["avg_overall"] == 0
    for table in ("(select 1) x.y", "a b", "x.y;z", ""):
        with pytest.raises(ValueError):
            files.read_table(spark, "jdbc:none", table)


CITED = [
    ("The FANUC robot lifts 20 kg [P1].", ["FANUC"], "ok"),
    ("安川电机 makes robots [P1].", ["ABB"], "unsupported_entity"),
    ("FANUC-Robotics is known [P1].", ["FANUC"], "ok"),
    ("FANUC M-20iA has payload 20kg[P1].", ["FANUC M-20iA"], "ok"),
    ("KUKA KR60的精度为0.02mm[P1]。", ["ABB IRB 6700"], "unsupported_entity"),
    ("Test[P1].", None, "empty_path"),
    ("all lower case [P1].", [], "ok"),
    ("Some claim[P1].", [], "unsupported_entity"),
    ("的了为是[P1] 与及", ["x"], "ok"),
    ("Far KUKA" + " and so on" * 8 + " [P1]", ["x"], "ok"),
    ("Near KUKA" + " and so on" * 3 + " [P1]", ["near"], "unsupported_entity"),
    ("[P1] " + "so on and " * 5 + "KUKA " + "KUKA", ["abb"], "unsupported_entity"),
    ("[P1] " + "so on and " * 6 + "KUKA", ["abb"], "ok"),
    ("fanuc FANUC Fanuc [P1]", ["FANUC M-20iA"], "ok"),
    ("fanuc [P01]", ["FANUC"], "unsupported_entity"),  # a mark of three characters counts as a name itself
]


def test_citation_rules(spark):
    answers = spark.createDataFrame([(i, a) for i, (a, *_) in enumerate(CITED)] + [(100, "Twice [P1][P2] and [P1]; [P9]"), (103, "[P99999999999]"), (101, None), (102, "no mark")], "answer_id int, answer string")
    paths = spark.createDataFrame([(i, 1, n) for i, (_, n, _) in enumerate(CITED)] + [(100, 1, ["twice"])], "answer_id int, index int, nodes array<string>")
    rows = retrieve.verified_citations(answers, paths)
    got = {(x["answer_id"], x["index"]): x["verdict"] for x in rows.collect()}
    assert got == {(i, 1): v for i, (_, _, v) in enumerate(CITED)} | {(100, 1): "ok", (100, 2): "invalid_ref", (100, 9): "invalid_ref", (103, 2**31 - 1): "invalid_ref"}
    assert {x["answer_id"]: (x["total"], x["ok"], x["invalid_ref"]) for x in retrieve.citation_summary(rows).collect()}[100] == (3, 1, 2)
    assert {x["answer_id"]: x["issues"] for x in rows.collect() if x["issues"]}[4] == ["KUKA", "KR60的精度为0"]


def test_shortest_paths(spark):
    r = random.Random(8)
    edges = [(f"e{k}", f"n{r.randrange(40)}", f"n{r.randrange(40)}", "t") for k in range(55)] + [(f"h{k}", "hub", f"n{k}", "t") for k in range(0, 40, 3)] + [("loop", "n1", "n1", "t"), ("far1", "f1", "f2", "t")]
    g = Graph(nodes_from(spark.createDataFrame([(f"n{k}", "L") for k in range(40)], "node_id string, label string")), edges_from(spark.createDataFrame(edges, "edge_id string, src string, dst string, type string")))
    near: dict[str, set] = {}
    for _, a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def best(a, b, most):
        level = {a: [a]}
        seen = {a}
        for hops in range(1, most + 1):
            new: dict[str, list] = {}
            for path in level.values():
                for x in near.get(path[-1], ()):
                    if x not in seen and (x not in new or path + [x] < new[x]):
                        new[x] = path + [x]
            seen |= set(new)
            level = new
            if b in new:
                return hops, new[b]

    pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)] + [("n1", "n1"), ("n2", "f1"), ("f1", "f2"), ("hub", "n5"), ("gone", "n1"), (None, "n1"), ("n1", None)]
    for most in (1, 2, 5, 9):
        got = {(x["source"], x["target"]): (x["hops"], x["nodes"]) for x in match.shortest_paths(g, spark.createDataFrame(pairs, "source string, target string"), most).collect()}
        assert got == {p: w for p in pairs if None not in p and p[0] != p[1] and (w := best(*p, most))}
    # nodes and edges near seeds, as the trails give them
    seeds = spark.createDataFrame([("n1",), ("n7",), ("gone",)], "node_id string")
    for most in (1, 2, 3):
        t = match.trails(g, seeds, most).collect()
        nodes, rows = match.subgraph(g, seeds, most)
        assert {x["edge_id"] for x in rows.collect()} == {e for x in t for e in x["edges"]}
        assert {x["node_id"] for x in nodes.collect()} == {n for x in t for n in x["nodes"]} & {f"n{k}" for k in range(40)}


def test_hashed_embedding_works_each_word_out_once(spark):
    text = "alpha beta alpha gamma delta"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select("t", search.hashed_embedding(F.col("t"), 8).alias("v"))
    words = spark.createDataFrame([(w,) for w in text.split()], "w string").selectExpr("pmod(xxhash64(w), 8) AS at", "if(pmod(xxhash64(w, 1), 2) = 0, 1, -1) AS s").collect()
    want = [sum(x["s"] for x in words if x["at"] == k) for k in range(8)]
    norm = sum(x * x for x in want) ** 0.5
    got = {x["t"]: x["v"] for x in df.collect()}
    assert np.allclose(got[text], [x / norm for x in want], atol=1e-7) and got[""] == [None] * 8 and got[None] is None
    # the plan names the two hashes of a word once each, not once more for every place and norm
    assert df._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 2


def test_link_by_every_alias_of_a_name(spark, tmp_path):
    """Names that several suppliers share have several numbers; a number of five digits has no four."""
    from trellisgraph.plans import registry

    keys = [3, 8, 1003, 1008, 9999, 10000, 10003, 59003]
    rows = [(k, f"Supplier#{k % 1000:09d}") for k in keys]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(x["mention_id"], x["node_id"]): x["score"] for x in registry.queries()["f06_link_by_alias"](spark, str(tmp_path)).collect()}
    assert got == {(k, f"Supplier::{k}"): 100.0 if k % 2 == 0 else 85 + 10 * 4 / 11 for k in keys if k < 10000}
