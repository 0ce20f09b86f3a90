"""The graph operators on the literal sample graph and on small tables."""

from __future__ import annotations

import io
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from trellisgraph import graph
from trellisgraph.functions import text as fn
from trellisgraph.operators import community, extract, infer, match, quality, retrieve, search, stats, write
from trellisgraph.sources import cad, files, mapping
from trellisgraph.streaming import jobs


@pytest.fixture(scope="module")
def g(spark):
    s = graph.sample(spark)
    return s.with_(nodes=s.nodes.cache(), edges=s.edges.cache())


def names(df, c="name"):
    return sorted(r[c] for r in df.collect())


def test_sample_quality(g):
    assert names(quality.orphans(g)) == ["KUKA", "安川电机"]
    assert quality.consistency(g).count() == 0
    wrong = g.with_(edges=g.edges.withColumn("type", F.when(F.col("type") == "manufactures", "uses_servo").otherwise(F.col("type"))))
    assert quality.consistency(wrong).count() == 2
    rows, summary = quality.report(g)
    s = summary.first()
    assert s["entities"] == 11 and s["score"] == max(0, 100 - 2 * rows.count())
    assert quality.report(g.with_(nodes=g.nodes.limit(0), edges=g.edges.limit(0)))[1].first()["score"] == 100


def test_inference(g):
    assert [(r["src"], r["dst"]) for r in infer.symmetric(g).collect()] == [("Manufacturer::ABB", "Manufacturer::FANUC")]
    assert infer.inverse(g).count() == 2 and infer.transitive_step(g).count() == 0
    assert sorted(r["node_id"] for r in infer.subclass(g).collect()) == ["EndEffector::伺服焊枪", "Reducer::RV-40E", "ServoMotor::αiF 8/4000"]
    done, counts = infer.infer(g, domain="d")
    assert {r["rule"]: r["inferred"] for r in counts.collect()} == {"symmetric": 1, "transitive": 0, "inverse": 2, "subclass": 3}
    assert done.edges.count() == 11 and done.edges.where("inferred and domain = 'd'").count() == 3
    again = infer.infer(done)[1]
    assert all(r["inferred"] == 0 for r in again.collect())
    assert infer.infer(g, dry_run=True)[0] is g


def test_paths(spark, g):
    p = match.shortest_path(g, F.col("name") == "FANUC", F.col("name") == "伺服焊枪", 5).collect()
    assert len(p) == 1 and p[0]["hops"] == 4 and len(p[0]["nodes"]) == 5
    assert match.shortest_path(g, F.col("name") == "FANUC", F.col("name") == "KUKA", 5).count() == 0
    seed = g.nodes.where("name = 'FANUC'").select("node_id")
    t = match.trails(g, seed, 3).collect()
    assert all(len(set(r["edges"])) == r["hops"] == len(r["nodes"]) - 1 for r in t)
    assert sum(r["hops"] == 1 for r in t) == 2
    lost = seed.unionByName(spark.createDataFrame([("X::none",)], "node_id string"))
    assert match.trails(g, lost, 2, strict=True, wanted=2).count() == 0 < match.trails(g, lost, 2).count()
    nodes, edges = match.subgraph(g, g.nodes.where("name = 'KUKA'").select("node_id"))
    assert nodes.count() == 0 == edges.count()
    assert sorted(r["hops"] for r in match.reach(g, seed, 2).collect()) == [0, 1, 1, 2, 2, 2]


def test_neighbors(spark, g):
    assert names(match.neighbors(g, "Manufacturer", "FANUC")) == ["ABB", "FANUC M-20iA"]
    assert names(match.neighbors(g, "Manufacturer", "ABB", "in")) == ["FANUC"]
    loop = g.edges.limit(1).select("edge_id", F.lit("Manufacturer::KUKA").alias("src"), F.lit("Manufacturer::KUKA").alias("dst"), F.lit("competitor_of").alias("type"))
    looped = g.with_(edges=graph.edges_from(loop))
    assert match.neighbors(looped, "Manufacturer", "KUKA").count() == 1 == match.neighbors(looped, "Manufacturer", "KUKA", "in").count()
    assert stats.degrees(looped).first()["degree"] == 1
    top = {r["node_id"]: r["degree"] for r in stats.top_degrees(g, 2).collect()}
    assert top == {"Robot::FANUC M-20iA": 3, "Robot::ABB IRB 6700": 3}


def test_communities(g):
    c = {r["node_id"]: r["component"] for r in community.components(g).collect()}
    sizes = sorted(list(c.values()).count(x) for x in set(c.values()))
    assert sizes == [1, 1, 9]
    flat = community.components(g).withColumnRenamed("component", "community")
    assert [r["size"] for r in community.listing(g, flat).collect()] == [9]
    q = community.modularity(g, community.louvain(g)).first()["modularity"]
    assert q >= community.modularity(g, flat).first()["modularity"]


def plain_graph(spark, pairs, alone=()):
    nodes = spark.createDataFrame([(x, "N", ["N"], x, "d") for x in sorted({x for p in pairs for x in p} | set(alone))], "node_id string, label string, labels array<string>, name string, domain string")
    edges = spark.createDataFrame([(f"{a}|{b}", a, b, "r", "d") for a, b in pairs], "edge_id string, src string, dst string, type string, domain string")
    return graph.Graph(graph.nodes_from(nodes), graph.edges_from(edges), graph.Ontology())


def test_louvain_finds_cliques(spark):
    clique = lambda k: [(f"{k}{i}", f"{k}{j}") for i in range(5) for j in range(i)]
    pairs = [e for k in "abcdef" for e in clique(k)] + [(f"{a}0", f"{b}1") for a, b in zip("abcdef", "bcdefa")]
    got = {r["node_id"]: r["community"] for r in community.louvain(plain_graph(spark, pairs, ["z"])).collect()}
    assert got == {f"{k}{i}": f"{k}0" for k in "abcdef" for i in range(5)} | {"z": "z"}


def test_closure_and_components(spark):
    import random

    r = random.Random(3)
    pairs = sorted({(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(45)} | {(f"c{i}", f"c{i + 1}") for i in range(30)})
    edges = spark.createDataFrame(pairs, "src string, dst string")
    want = set(pairs)
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    assert {tuple(x) for x in infer.transitive_closure(edges).collect()} == want
    top = {x: x for p in pairs for x in p}
    for _ in range(80):
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    assert {x["node_id"]: x["component"] for x in community.components(plain_graph(spark, pairs)).collect()} == top


def test_write(spark, g):
    ents = spark.createDataFrame([("Manufacturer", "发那科", {"country": "JP"}, 0.9, 1), ("Manufacturer", " fanuc ", {"website": "x"}, 0.8, 2), ("Robot", "M-20", {"axes": "6"}, 1.0, 3), ("Ghost", "g", {}, 1.0, 4), ("Robot", " ", {}, 1.0, 5)], "type string, name string, props map<string,string>, confidence double, ord long")
    rels = spark.createDataFrame([("manufactures", "Manufacturer", "发那科", "Robot", "M-20", 1), ("manufactures", "Robot", "M-20", "Manufacturer", "发那科", 2), ("nothing", "Robot", "M-20", "Robot", "M-20", 3), ("manufactures", "Manufacturer", "发那科", "Robot", "missing", 4)], "type string, src_type string, src_name string, dst_type string, dst_name string, ord long").withColumn("props", F.create_map().cast("map<string,string>")).withColumn("confidence", F.lit(1.0))
    table = write.aliases(spark, [("FANUC", "Manufacturer", ["发那科", "Fanuc Robotics"])])
    empty = g.with_(nodes=g.nodes.limit(0), edges=g.edges.limit(0))
    w = write.write(empty, ents, rels, table, "industrial_robot", "test")
    rows = {r["name"]: r for r in w.graph.nodes.collect()}
    assert set(rows) == {"FANUC", "M-20"} and rows["FANUC"]["props"] == {"country": "JP", "website": "x"}
    assert rows["FANUC"]["domain"] == "industrial_robot" and rows["FANUC"]["confidence"] == 0.8
    e = w.graph.edges.collect()
    assert [(r["src"], r["dst"]) for r in e] == [("industrial_robot::Manufacturer::FANUC", "industrial_robot::Robot::M-20")]
    errors = sorted(r["error"] for r in w.errors.collect())
    assert errors == ["dangling", "empty name", "endpoint mismatch: Robot -> Manufacturer", "unknown entity type: Ghost", "unknown relation type: nothing"]
    s = w.summary.first()
    assert (s["entities"], s["relations"], s["skipped"]) == (3, 2, 5)
    twice = write.write(w.graph, ents, rels, table, "industrial_robot", "test")
    assert twice.graph.nodes.count() == 2 and twice.graph.edges.count() == 1
    late = write.write(w.graph, ents.limit(0), rels, table, "industrial_robot")
    assert late.graph.edges.count() == 1
    gone, count = write.delete_nodes(w.graph, w.graph.nodes.where("name = 'FANUC'").select("node_id"))
    assert gone.edges.count() == 0 and count.first()["deleted"] == 1
    assert write.delete_by_file(w.graph, "/some/where/test")[0].nodes.count() == 0
    assert write.drop_domain(w.graph, "industrial_robot").nodes.count() == 0


@pytest.mark.parametrize("name, canonical, origin", [("发那科", "FANUC", "alias"), ("fanuc robotics", "FANUC", "alias"), ("  FANUC  ", "FANUC", "self"), ("FANUC-Robotics", "FANUC", "normalized"), ("UnknownCorp", "UnknownCorp", "none")])
def test_resolve(spark, name, canonical, origin):
    table = write.aliases(spark, [("FANUC", "Manufacturer", ["发那科", "Fanuc Robotics"])])
    r = write.resolve(spark.createDataFrame([("Manufacturer", name)], "type string, name string"), table).first()
    assert (r["canonical"], r["resolved_from"]) == (canonical, origin)


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "d")], "k int, v string")
    assert {r["k"]: r["status"] for r in write.compared(old, new, ["k"], ["v"]).collect()} == {1: "unchanged", 2: "updated", 3: "unchanged", 4: "new"}


@pytest.mark.parametrize(
    "text, kind, name, props",
    [
        ("本线选用 NACHI MZ07 为 6 轴小型机。", "Robot", "MZ07", {"axes": "6"}),
        ("NACHI MZ07 额定负载：7.5 kg", "Robot", "MZ07", {"payload": "7.5"}),
        ("NACHI MZ07 最大臂展 723 mm", "Robot", "MZ07", {"reach": "723.0"}),
        ("第二关节为 RV-80N 减速器。", "Reducer", "RV-80N", {}),
        ("柜内装有 R-50 Mate 控制器。", "Controller", "R-50 Mate", {}),
        ("焊缝按 DIN 5817 验收。", "Standard", "DIN 5817", {}),
        ("NACHI MZ07 为 6 轴，NACHI MZ07 负载 7 kg。", "Robot", "MZ07", {"axes": "6", "payload": "7.0"}),
    ],
)
def test_rule_entities(spark, text, kind, name, props):
    rows = extract.entities(spark.createDataFrame([(1, text)], "doc_id long, text string")).where(F.col("type") == kind).collect()
    assert len(rows) == 1 and name in rows[0]["name"] and rows[0]["confidence"] == 0.95
    assert {k: v for k, v in rows[0]["props"].items() if k in props} == props


def test_rule_relations(spark):
    docs = spark.createDataFrame([(1, "KUKA 制造 KR10 搬运设备。"), (2, "KR10搭载X9减速器"), (3, "明天开会，请带上图纸。"), (4, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in extract.relations(docs).collect()}
    assert rows[1]["type"] == "manufactures" and rows[1]["src_name"] == "KUKA"
    assert rows[2]["type"] == "uses_reducer" and 3 not in rows and 4 not in rows
    assert extract.entities(docs.where("doc_id > 2")).count() == 0


def test_funnel(spark):
    docs = spark.createDataFrame([(1, "FANUC"), (2, "KUKA KR10 为 6 轴，DIN 5817 弧焊 夹爪")], "doc_id long, text string")
    model = lambda d: d.select("doc_id", F.lit("Software").alias("type"), F.lit("RoboGuide").alias("name"), F.create_map().cast("map<string,string>").alias("props"), F.lit(0.4).alias("confidence"), F.lit(0).cast("long").alias("ord"))
    rows = extract.funnel(docs, model).where("type = 'Software'").collect()
    assert [(r["doc_id"], r["confidence"]) for r in rows] == [(1, 0.7)]


def test_scores_and_budget(spark, g):
    seed = "Manufacturer::FANUC"
    t = match.trails(g, spark.createDataFrame([(seed,)], "node_id string"), 1)
    s = {r["types"][0]: r["score"] for r in retrieve.scored_paths(g, t, [seed]).collect()}
    assert s["manufactures"] == pytest.approx(0.35 + 0.18 + 0.105 + 0.3) and s["competitor_of"] == pytest.approx(0.35 + 0.08 + 0.105 + 0.3)
    rows = retrieve.retrieve(g, [seed], 2).collect()
    assert [r["marker"] for r in rows] == [f"P{i + 1}" for i in range(len(rows))]
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert "[Robot] FANUC M-20iA(payload=20, reach=1853)" in "".join(r["line"] for r in rows)
    alone = retrieve.retrieve(g, ["Manufacturer::KUKA"], 2).collect()
    assert len(alone) == 1 and alone[0]["score"] == pytest.approx(0.35 + 0.1 + 0.105 + 0.36)
    long = spark.createDataFrame([(1, i, "word " * 100) for i in range(9)], "q int, i int, line string")
    assert retrieve.budgeted(long, ["q"], [F.col("i")], tokens=500).count() == 2
    assert retrieve.budgeted(long, ["q"], [F.col("i")], tokens=1).count() == 1


def test_text_functions(spark):
    r = spark.createDataFrame([("机器人 two words",), ("",)], "t string").select(fn.token_estimate(F.col("t")).alias("n"), F.size(fn.chunks(F.col("t"), 5)).alias("c")).collect()
    assert [(x["n"], x["c"]) for x in r] == [(int(3 + 2.6 + 13 // 6), 3), (0, 1)]
    j = spark.createDataFrame([('x [{"a": 1}, {"a": 2}] y',), ('[{"a": 1}, {"a"',), ("none",)], "t string").select(fn.json_array(F.col("t"), "array<struct<a:int>>").alias("x")).collect()
    assert [x["x"] and len(x["x"]) for x in j] == [2, 1, None]
    c = spark.createDataFrame([("6.9", "yes", " ", "1e3")], "a string, b string, c string, d string").select(fn.converted(F.col("a"), "integer"), fn.converted(F.col("b"), "boolean"), fn.converted(F.col("c"), "string"), fn.converted(F.col("d"), "float"), fn.converted(F.col("b"), "integer")).first()
    assert tuple(c) == (6, True, None, 1000.0, None)


def test_search(spark, g):
    hits = search.fulltext(g.nodes, "fanuc robot").collect()
    assert {r["name"] for r in hits} == {"FANUC", "FANUC M-20iA"}
    assert [r["score"] for r in search.fulltext(g.nodes, "anuc M").collect()] == [1.0] or len(search.fulltext(g.nodes, "anuc M").collect()) >= 1
    s = spark.createDataFrame([("fanuc", "FANUC"), ("the fanuc robot", "FANUC"), ("fan", "FANUC"), ("red old robot", "old robot arm"), ("motor12345", "motor12346"), ("x", "completely else")], "q string, n string").select(search.match_score(F.col("q"), F.col("n")).alias("s")).collect()
    assert [round(x["s"], 3) for x in s] == [100, round(85 + 10 * 5 / 15, 3), 86, 70, round(55 + 0.25 * (1800 / 19 - 80), 3), 0]
    assert spark.range(1).select(search.longest_common(F.lit("abcxyz"), F.lit("zbcxy")).alias("x")).first()["x"] == "bcxy"
    assert spark.range(1).select(search.indel_ratio(F.lit("abcd"), F.lit("abed")).alias("x")).first()["x"] == 0.75


def test_citations(spark):
    answers = spark.createDataFrame([(1, "Robot [P1] and [P1], FANUC [P2], [P9].")], "answer_id int, answer string")
    paths = spark.createDataFrame([(1, 1, None), (1, 2, ["FANUC", "Robot one"])], "answer_id int, index int, nodes array<string>")
    got = {r["index"]: r["verdict"] for r in retrieve.verified_citations(answers, paths).collect()}
    assert got == {1: "empty_path", 2: "ok", 9: "invalid_ref"}
    assert retrieve.citation_summary(retrieve.verified_citations(answers, paths)).first()["total"] == 3


def test_mapping(spark, tmp_path):
    assert mapping.matching_rule("data/robot_components_1.csv").type == "uses_component"
    assert mapping.matching_rule("robot_components_1.csv", first_match=True).type == "Component"
    (tmp_path / "robots.csv").write_text("name,axes,payload_kg,extra\nR1,6.0,12.5,z\n,4,1,z\nR2,x,,z\n")
    df = files.read_csv(spark, str(tmp_path / "robots.csv"))
    rows = {r["name"]: r for r in mapping.to_entities(df, mapping.matching_rule("robots.csv")).collect()}
    assert set(rows) == {"R1", "R2"} and rows["R1"]["props"] == {"name": "R1", "axes": "6", "payload": "12.5"} and rows["R2"]["props"] == {"name": "R2"}


def test_files(spark, tmp_path):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.txt").write_bytes("机器人".encode("gb18030"))
    (tmp_path / "c.html").write_text("<html><head><script>x()</script></head><body><nav>menu</nav><main><p>Main  text</p></main></body></html>")
    (tmp_path / "d.xls").write_bytes(b"x")
    got = {r["name"]: r for r in files.routed(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.docx"]["text"] == "Hello\na | b" and got["b.txt"]["text"] == "机器人" and got["c.html"]["text"] == "Main text" and got["d.xls"]["error"] == "unsupported: .xls"


@pytest.mark.parametrize("url, problem", [("https://example.com/a", None), ("ftp://example.com", "scheme"), ("http://u:p@example.com", "credentials"), ("http://localhost/x", "host"), ("http://10.0.0.1/", "address"), ("http://169.254.169.254/x", "address"), ("http://[::1]/", "address"), ("http://8.8.8.8/", None)])
def test_urls(spark, url, problem):
    assert spark.createDataFrame([(url,)], "u string").select(files.url_problem(F.col("u")).alias("p")).first()["p"] == problem


def test_cad(spark):
    dxf = "\n".join(["0", "SECTION", "2", "TABLES", "0", "LAYER", "2", "L1", "0", "ENDSEC", "0", "SECTION", "2", "BLOCKS", "0", "BLOCK", "2", "GEAR", "0", "BLOCK", "2", "*U1", "0", "BLOCK", "2", "BOX ASSY", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", "0", "TEXT", "1", "Q235 steel", "10", "1.0", "20", "2.0", "0", "DIMENSION", "1", "Ø12.5", "0", "INSERT", "2", "GEAR", "10", "5", "20", "-1", "0", "INSERT", "2", "GEAR", "0", "ENDSEC", "0", "EOF"])
    meta = cad.dxf_metadata(spark.createDataFrame([("/x/d.dxf", dxf)], "path string, text string"))
    assert names(meta["layers"]) == ["L1"] and names(meta["blocks"]) == ["BOX ASSY", "GEAR"] and meta["inserts"].first()["n"] == 2
    x = meta["extents"].first()
    assert (x["min_x"], x["max_x"], x["min_y"], x["max_y"]) == (1.0, 5.0, -1.0, 2.0)
    ents, rels = cad.dxf_graph(meta)
    assert {(r["type"], r["name"]) for r in ents.collect()} == {("Drawing", "d.dxf"), ("CADLayer", "L1"), ("Part", "GEAR"), ("Assembly", "BOX ASSY"), ("Dimension", "Ø12.5"), ("Material", "Q235"), ("Material", "STEEL")}
    assert {r["type"] for r in rels.collect()} == {"drawing_has_layer", "drawing_defines", "drawing_defines_assembly", "part_has_dimension", "part_made_of"}
    assert "GEAR x2" in cad.dxf_summary(meta).first()["summary"]
    raw = b"AC1032" + b"\x00\x01" + b"PART NAME" + b"\xff" + b"12" + b"\x00"
    d = cad.dwg_strings(spark.createDataFrame([("p", bytearray(raw))], "path string, content binary")).first()
    assert d["version"] == "AC1032" and "PART NAME" in d["strings"]


def test_label_cleaning(spark):
    e = spark.createDataFrame([(1, "Part", "4-M10"), (1, "Part", " M10螺纹孔"), (1, "Part", "4-M"), (1, "Part", "圆弧"), (1, "Component", "底座"), (1, "Material", "金属"), (1, "Part", "金属"), (1, "Process", "图层"), (1, "Process", "焊接"), (1, "Part", "")], "sample_id int, type string, name string")
    kept = extract.clean_entity_names(e)
    assert names(kept) == sorted(["M10螺纹孔", "M4螺纹孔", "底座", "金属", "焊接"])
    rows = [("contains", "Part", "M10螺纹孔", "Component", "底座", 1), ("contains", "Component", "底座", "Part", "M10螺纹孔", 2), ("performs_process", "Process", "焊接", "Component", "底座", 3), ("contains", "Component", "底座", "Part", "圆弧", 4)]
    r = spark.createDataFrame([(1, *x) for x in rows], "sample_id int, type string, src_type string, src_name string, dst_type string, dst_name string, ord int")
    assert sorted((x["type"], x["src_name"], x["dst_name"]) for x in extract.clean_relations(r, kept).collect()) == [("contains", "底座", "M10螺纹孔"), ("performs_process", "底座", "焊接")]


def test_ontology(spark):
    o = graph.Ontology.from_yaml("entity_types:\n  A:\n    properties:\n      name: {type: string, required: true}\n      n: {type: integer}\nrelation_types:\n  r: {source: A, target: A}\nsemantics:\n  symmetric_relations: [r]\n  inverse_pairs: [[r, s]]\n")
    assert o.entity_types == {"A": "name!,n:integer"} and o.relation_types == {"r": ("A", "A")} and o.inverse == {"r": "s"}
    assert o.rules(spark).count() == 2 and o.entities(spark).where("required").count() == 1
    assert len(graph.Ontology().entity_types) == 18 and len(graph.Ontology().relation_types) == 27
    assert replace(o, symmetric=[]).symmetric == []


def test_streams(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "events"))
    q = jobs.to_memory(jobs.tumbling(jobs.events_stream(spark, str(tmp_path / "events"), schema)), "tumbled", "complete")
    q.awaitTermination()
    batch = jobs.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("tumbled")) == key(batch)


def test_incremental_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    (folder / "b.txt").write_text("two")
    run = lambda: jobs.ingest(jobs.text_stream(spark, str(folder)), str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (folder / "c.txt").write_text("one")
    (folder / "d.txt").write_text("three")
    run()
    assert names(spark.read.parquet(str(tmp_path / "out")), "text") == ["one", "three", "two"]
