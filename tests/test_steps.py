"""Keyed merges in a stream, the embedding step, guarded fetching, read-only statements and the second tier of names."""

from __future__ import annotations

import os
import random
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisgraph.graph import Graph, edges_from, nodes_from, sample
from trellisgraph.operators import embed, extract, search, statements, write
from trellisgraph.sources import web
from trellisgraph.streaming import upserts


def merged_plainly(rows, known):
    out = []
    for k, a, b, n in sorted(rows, key=lambda x: x[3]):
        if k is None:
            continue
        new = {c: v for c, v in (("a", a), ("b", b)) if v is not None}
        if k not in known:
            status, known[k] = "new", new
        else:
            status = "updated" if any(known[k].get(c, "") != v for c, v in new.items()) else "unchanged"
            known[k] = known[k] | new
        out.append((k, known[k].get("a"), known[k].get("b"), n, status))
    return out


def test_stream_upserts_over_restarts(spark):
    r = random.Random(4)
    base = tempfile.mkdtemp(prefix="spark-")
    schema, known, want = "k string, a string, b string, n long", {}, []
    spark.createDataFrame([], schema).write.parquet(f"{base}/in")
    for batch in range(3):
        rows = [(r.choice([*"pqrstuv", None]), r.choice(["1", "2", None]), r.choice(["x", "", None]), batch * 100 + i) for i in range(25)]
        rows += [(f"only{batch}", "1", None, batch * 100 + 50)]
        want += merged_plainly(rows, known)
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{base}/in")
        # each run is a new query that goes on from the checkpoint
        out = upserts.upserts(spark.readStream.schema(schema).parquet(f"{base}/in"), ["k"], ["a", "b"], "n")
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{base}/out").select("k", "a", "b", "n", "status").collect()), key=repr)
    assert got == sorted(want, key=repr) and Counter(x[-1] for x in got)["updated"] > 5
    # one row a key: as the batch comparison says
    old = spark.createDataFrame([(k, v.get("a"), v.get("b")) for k, v in known.items()], "k string, a string, b string")
    new = [("p", "9", None), ("q", None, None), ("fresh", "1", "1")]
    batch = {x["k"]: x["status"] for x in write.compared(old, spark.createDataFrame(new, "k string, a string, b string"), ["k"], ["a", "b"]).collect()}
    assert batch == {k: s for k, *_, s in merged_plainly([(k, a, b, 1) for k, a, b in new], known)}


def test_embedding_step(spark):
    place = tempfile.mkdtemp(prefix="spark-")

    def opened():
        with open(f"{place}/open-{os.getpid()}-{os.urandom(4).hex()}", "w"):
            pass
        plain = embed.hashed_model(16)

        def model(texts):
            with open(f"{place}/calls-{os.getpid()}", "a") as f:
                f.write(f"{len(texts)}\n")
            assert all(len(t) <= 9000 * 6 for t in texts)
            return plain(texts)

        return model

    def calls():
        sizes = []
        for x in os.listdir(place):
            if x.startswith("calls-"):
                sizes += [int(n) for n in open(f"{place}/{x}").read().split()]
        return sizes

    ents = lambda names: spark.createDataFrame([("Robot", n, {"description": d}, 1.0, i) for i, (n, d) in enumerate(names)], "type string, name string, props map<string,string>, confidence double, ord long")
    none = spark.createDataFrame([], "type string, src_type string, src_name string, dst_type string, dst_name string, props map<string,string>, confidence double, ord long")
    g = sample(spark)
    g = g.with_(nodes=g.nodes.limit(0), edges=g.edges.limit(0))
    first = write.write(g, ents([(f"R{i}", f"lifts {i}") for i in range(150)] + [("long", "word " * 10_000), ("empty", None)]), none, model=opened).graph
    nodes = spark.createDataFrame(first.nodes.collect(), first.nodes.schema)
    assert sum(calls()) == 152 and max(calls()) == 32
    pids = Counter(x.split("-")[1] for x in os.listdir(place) if x.startswith("open-"))
    assert set(pids.values()) == {1}
    rows = {x["name"]: np.array(x["embedding"]) for x in nodes.collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 or not v.any() for v in rows.values())
    again = write.write(g.with_(nodes=nodes), ents([("R0", "lifts 0"), ("R1", "lifts more"), ("new", "x")]), none, model=opened).graph.nodes.collect()
    assert sum(calls()) == 154 and len(again) == 153
    now = {x["name"]: np.array(x["embedding"]) for x in again}
    assert all(np.array_equal(now[k], v) for k, v in rows.items() if k != "R1") and not np.array_equal(now["R1"], rows["R1"])
    assert embed.cut_to_tokens("机器人 arm long", 4) == "机器人 arm" and embed.cut_to_tokens("a b", 8192) == "a b"


PAGES = {
    "http://ok.example/a": (200, None, "<html><body><p>hello</p><script>x</script></body></html>"),
    "http://ok.example/r1": (302, "/r2", ""),
    "http://ok.example/r2": (301, "https://other.example/r3", ""),
    "https://other.example/r3": (308, "http://ok.example/a", ""),
    "http://ok.example/r0": (302, "/r1", ""),
    "http://ok.example/inward": (302, "http://10.0.0.7/secret", ""),
    "http://ok.example/rebound": (302, "http://inside.example/x", ""),
    "http://10.0.0.7/secret": (200, None, "<body>secret</body>"),
    "http://inside.example/x": (200, None, "<body>secret</body>"),
    "http://ok.example/none": (302, None, "<body>no place</body>"),
    "http://ok.example/gone": (404, None, "<body>gone</body>"),
}
HOSTS = {"ok.example": ["93.184.216.34"], "other.example": ["2606:2800:220:1::1"], "inside.example": ["93.184.216.34", "192.168.3.4"], "mapped.example": ["::ffff:127.0.0.1"]}


def test_guarded_fetch(spark):
    seen, stored, hosts = tempfile.mkdtemp(prefix="spark-"), dict(PAGES), dict(HOSTS)

    def resolve(host):
        if host not in hosts:
            raise OSError(host)
        return hosts[host]

    def fetch(url):
        open(f"{seen}/{url.replace('/', '|')}", "w").close()
        return stored[url]

    urls = [*PAGES, "ftp://ok.example/a", "http://u:p@ok.example/a", "http://localhost/a", "http://nowhere.example/", "http://mapped.example/", "http://127.0.0.1/", "http://[::1]/", "http://ok.example/crash", None, "", "http://"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id int, url string, hops_before int")
    got = {x["url"]: x for x in web.pages(df, fetch, resolve).collect()}
    assert len(got) == len(urls)
    text = {u: x["text"] for u, x in got.items() if x["text"]}
    assert text == {"http://ok.example/a": "hello", "http://ok.example/r1": "hello", "http://ok.example/r2": "hello", "https://other.example/r3": "hello", "http://ok.example/none": "no place"}
    why = {u: x["error"] for u, x in got.items()}
    assert why["http://ok.example/r0"] == "redirects" and got["http://ok.example/r1"]["hops"] == 3
    assert {why[u] for u in ("http://ok.example/inward", "http://ok.example/rebound", "http://10.0.0.7/secret", "http://inside.example/x", "http://mapped.example/", "http://127.0.0.1/", "http://[::1]/")} == {"address"}
    assert why["http://ok.example/gone"] == "status 404" and why["http://nowhere.example/"] == "unresolved" and why["http://ok.example/crash"].startswith("KeyError")
    assert (why["ftp://ok.example/a"], why["http://u:p@ok.example/a"], why["http://localhost/a"], why[None], why[""], why["http://"]) == ("scheme", "credentials", "host", "url", "url", "host")
    assert not any("10.0.0.7" in x or "inside" in x for x in os.listdir(seen))


def test_read_only_statements(spark):
    g = sample(spark)
    run = lambda q, **p: statements.read_only(g, q, p)
    assert run("SELECT name FROM nodes WHERE label = :label ORDER BY name", label="Manufacturer").count() == 4
    assert run("WITH x AS (SELECT src, count(*) AS n FROM edges GROUP BY src) SELECT name, n FROM x JOIN nodes ON node_id = src WHERE n > :least", least=1).count() == 3
    assert run("SELECT 'DROP TABLE nodes; DELETE' AS create_set, (SELECT max(name) FROM nodes) AS m").first()["create_set"].startswith("DROP")
    assert run("SELECT name FROM nodes WHERE name = :x", x="' OR 1 = 1 --").count() == 0
    assert not spark.catalog.tableExists("nodes")
    place = tempfile.mkdtemp(prefix="spark-")
    for bad in (
        "DROP TABLE nodes", "CREATE TABLE t AS SELECT * FROM nodes", "CREATE TEMP VIEW v AS SELECT 1", "INSERT INTO nodes SELECT * FROM nodes", "INSERT OVERWRITE DIRECTORY '%s' USING parquet SELECT 1" % place,
        "FROM nodes INSERT INTO t SELECT name", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "DELETE FROM nodes", "UPDATE nodes SET name = 'x'", "MERGE INTO nodes USING edges ON true WHEN MATCHED THEN DELETE", "TRUNCATE TABLE nodes",
        "ALTER TABLE nodes RENAME TO x", "SET spark.sql.ansi.enabled = false", "RESET", "ADD JAR 'x.jar'", "CACHE TABLE nodes", "USE other", "REFRESH TABLE nodes", "CREATE FUNCTION f AS 'x'", "EXPLAIN SELECT 1", "SHOW TABLES",
        "SELECT * FROM parquet.`/etc`", "SELECT name FROM nodes WHERE name IN (SELECT value FROM text.`/etc/passwd`)", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('java.lang.System', 'gc')", "SELECT TRANSFORM(name) USING 'cat' FROM nodes",
        "BEGIN DROP TABLE nodes; END", "SELECT * FROM others", "WITH x AS (SELECT * FROM nodes WHERE name IN (SELECT value FROM text.`/etc/passwd`)) SELECT * FROM x", "SELECT (SELECT max(value) FROM others) AS v FROM nodes",
    ):
        with pytest.raises(Exception) as e:
            run(bad)
        assert isinstance(e.value, statements.NotReadOnly), (bad, e.value)


def plain_overlap(first, second):
    kept = {n: c for n, c in first}
    for n, c in second:
        if n in kept:
            kept[n] = max(kept[n], c)
            continue
        for m in list(kept):
            if n in m or m in n:
                if len(n) > len(m):
                    kept.pop(m)
                    kept[n] = c
                else:
                    kept[m] = max(kept[m], c)
                break
        else:
            kept[n] = c
    return kept


def test_second_tier(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 6)))
    rows = {0: [], 1: []}
    for doc in range(12):
        for kind in ("Robot", "Part"):
            for tier in (0, 1):
                names = list(dict.fromkeys(word() for _ in range(r.randint(0, 9))))
                rows[tier] += [(doc, kind, n, {"k": n}, r.random(), i) for i, n in enumerate(names)]
    schema = "doc_id int, type string, name string, props map<string,string>, confidence double, ord long"
    a, b = (spark.createDataFrame(rows[t], schema).repartition(3) for t in (0, 1))
    got = {}
    for x in extract.tagged(a, b).collect():
        got.setdefault((x["doc_id"], x["type"]), {})[x["name"]] = x["confidence"]
        assert x["props"] == {"k": x["name"]}
    want = {}
    for key in {x[:2] for t in rows.values() for x in t}:
        want[key] = plain_overlap(*[[(n, c) for d, k, n, _, c, _ in rows[t] if (d, k) == key] for t in (0, 1)])
    assert got == want
    # no pair of names is compared: ten thousand names of one text
    many = spark.createDataFrame([(1, "Part", f"part {i:05d}", {}, 0.5, i) for i in range(10_000)], schema)
    assert extract.tagged(many.limit(0), many).count() == 10_000 and extract.longer_of_overlapping(many).count() == 10_000
    short = spark.createDataFrame([(1, "Part", n, {}, 0.5, i) for i, n in enumerate(["arm", "arm 5", "arm", "leg", "g"])] + [(1, "Robot", "ar", {}, 0.5, 9)], schema)
    assert sorted(x["name"] for x in extract.longer_of_overlapping(short).collect()) == ["ar", "arm 5", "leg"]


def test_funnel_with_tagger(spark):
    docs = spark.createDataFrame([(1, "FANUC M-20iA 负载 20kg。"), (2, "nothing to see")], "doc_id long, text string")
    more = lambda kind, name, c: lambda d: d.select("doc_id", F.lit(kind).alias("type"), F.lit(name).alias("name"), F.create_map(F.lit("payload"), F.lit("9")).alias("props"), F.lit(c).alias("confidence"), F.lit(0).cast("long").alias("ord"))
    rules = {(x["doc_id"], x["type"], x["name"]): x for x in extract.entities(docs).collect()}
    robot = next(k for k in rules if k[1] == "Robot")
    both = {(x["doc_id"], x["type"], x["name"]): x for x in extract.funnel(docs, tagger=more("Robot", robot[2], 0.99)).collect()}
    assert both[robot]["confidence"] == 0.99 and both[robot]["props"]["payload"] == rules[robot]["props"]["payload"] and both[2, "Robot", robot[2]]["props"] == {"payload": "9"}
    last = extract.funnel(docs, more("Software", "S", 0.1), tagger=more("Part", "P", 0.9)).collect()
    assert {x["doc_id"]: x["confidence"] for x in last if x["type"] == "Software"} and all(x["confidence"] == 0.7 for x in last if x["type"] == "Software")


def test_small_operators(spark):
    from trellisgraph.operators import retrieve, stats

    node = lambda i, label, file, source: (i, label, label + i, {"file": file} if file else {}, source)
    schema = "node_id string, label string, name string, props map<string,string>, source string"
    make = lambda rows: Graph(nodes_from(spark.createDataFrame(rows, schema)), edges_from(spark.createDataFrame([], "edge_id string, src string, dst string, type string")))
    rows = [node("1", "Robot", "b.txt", "s"), node("2", "Part", "b.txt", "s"), node("3", "Part", "a.txt", "t"), node("4", "Part", "", "u")]
    assert [tuple(x) for x in stats.files(make(rows)).collect()] == [("b.txt", 2, ["Part", "Robot"]), ("a.txt", 1, ["Part"])]
    assert [(x["file"], x["entities"]) for x in stats.files(make([r[:3] + ({}, r[4]) for r in rows])).collect()] == [("s", 2), ("t", 1), ("u", 1)]
    log = write.log_entry(spark, "s", "f", 3, 1, True, "2024-01-02T00:00:00", "h").unionByName(write.log_entry(spark, "s2", "f2", 0, 0, False, "2024-01-03T00:00:00", "")).unionByName(write.log_entry(spark, "s3", "f3", 0, 0, False, "2024-01-01T00:00:00", None))
    assert [x["source"] for x in stats.latest(log).collect()] == ["s2", "s", "s3"] and [x["source"] for x in write.clean_log(log).collect()] == ["s"]
    assert tuple(stats.log_totals(log).first()) == (3, 1, 2, 3, 1)
    gold, said = ([(1, 0, "A"), (1, 5, "A"), (2, 0, "B")], [(1, 0, "A"), (2, 3, "B")])
    scores = stats.precision_recall(*(spark.createDataFrame(x, "doc int, at int, label string") for x in (gold, said)), ["doc", "at"])
    assert tuple(round(x, 4) for x in stats.macro_average(scores).first()) == (0.5, 0.25, 0.3333)
    # results of several chunks, folded in order: later values win where asked
    chunks = spark.createDataFrame([(1, "Robot", "R", {"a": "1", "b": None}, 0.7, 0), (1, "Robot", "R", {"a": "2", "b": "3"}, 0.9, 1), (1, "Robot", "R", {"a": "4"}, 0.8, 2), (1, "Part", "R", {}, 0.1, 3)], "doc_id int, type string, name string, props map<string,string>, confidence double, ord long")
    for first, want in ((True, {"a": "1", "b": "3"}), (False, {"a": "4", "b": "3"})):
        got = {x["type"]: x for x in extract.merged(chunks, first).collect()}
        assert got["Robot"]["props"] == want and got["Robot"]["confidence"] == 0.9 and got["Part"]["props"] == {}
    docs = spark.createDataFrame([(1, "FANUC makes M1. KUKA sees nothing; ABB makes. M1 uses G2 and makes G3")], "doc_id int, text string")
    found = spark.createDataFrame([(1, n) for n in ("FANUC", "M1", "KUKA", "ABB", "G2", "G3")], "doc_id int, name string")
    assert {tuple(x)[1:] for x in extract.co_occurrences(docs, found, ["makes", "uses"]).collect()} == {("FANUC", "M1", "makes"), ("M1", "G2", "uses"), ("M1", "G3", "uses"), ("G2", "G3", "makes")}
    v, k = ([("a", 0.5), ("b", 0.9), ("b", 0.1)], [("b", 9.0), ("c", 3.0), ("d", 1.0)])
    got = search.hybrid(*(spark.createDataFrame(x, "name string, score double") for x in (v, k)), 3).orderBy("rank").collect()
    assert [(x["name"], x["source"]) for x in got] == [("b", "vector"), ("a", "vector"), ("c", "fulltext")]
    two = make([("1", "P", "x", {"zeta": "1", "alpha": "2"}, ""), ("2", "P", "y", {"mid": "5", "alpha": "3"}, "")])
    props = retrieve.compare(two, "1", "2")[0]
    assert [tuple(x)[:3] for x in props.orderBy("ord").collect()] == [("zeta", "1", None), ("alpha", "2", "3"), ("mid", None, "5")]
    assert [x.split(" | ")[0] for x in retrieve.comparison_text(props, "x", "y").first()["markdown"].splitlines()[2:]] == ["| zeta", "| alpha", "| mid"]


def test_table_functions(spark, sf_dir):
    from trellisgraph.functions import tables
    from trellisgraph.operators import training
    from trellisgraph.plans import registry
    from trellisgraph.sources import mapping

    made = registry.queries()
    plain, said = ({x["text_id"]: (x["text"], [tuple(s) for s in x["spans"]]) for x in made[name](spark, sf_dir).collect()} for name in ("e13_dictionary_spans", "e13_spans_in_sql"))
    assert plain == said and len(plain) > 10
    tables.register(spark)
    texts = spark.createDataFrame([(1, "FANUC M-20iA 是 6 轴机器人，配备力矩传感器，用于点焊"), (2, ""), (3, None)], "doc_id int, text string")
    names = spark.sql("SELECT d.doc_id, n.type, n.name FROM {d} d, LATERAL pattern_names(d.text) n", d=texts)
    assert {tuple(x) for x in names.collect()} == {(x["doc_id"], x["type"], x["name"]) for x in training.prefiltered(texts).collect()} != set()
    odd = spark.createDataFrame([(1, "abab", [(0, "ab", "Robot"), (1, "ba", "Part")]), (2, "abab", [(1, "ab", "Part"), (0, "bab", "Robot"), (2, None, "Part"), (3, "a", "Part")]), (3, None, [(0, "ab", "Part")]), (4, "ab", None), (5, "ab", [(0, "ab", "Nothing")])], "i int, text string, names array<struct<ord int, name string, type string>>")
    got = spark.sql("SELECT o.i, s.* FROM {o} o, LATERAL dictionary_spans(o.text, o.names) s", o=odd).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 2, "ROBOT"), (1, 1, 2, 4, "ROBOT"), (2, 0, 1, 4, "ROBOT")]
    rows = spark.createDataFrame([("R1", "6.9", " 1e2 ", "z"), ("", "4", "1", "z"), ("R2", "x", "", "z"), (None, "1", "1", "z"), ("R3", "99999999999", "-0.5", None)], "name string, axes string, payload_kg string, extra string")
    want = {x["name"]: x["props"] for x in mapping.to_entities(rows, mapping.matching_rule("robots.csv")).collect()}
    got = spark.sql("SELECT m.* FROM {r} r, LATERAL mapped_entities('data/robots.csv', map('name', r.name, 'axes', r.axes, 'payload_kg', r.payload_kg, 'extra', r.extra)) m", r=rows).collect()
    assert {x["name"]: x["props"] for x in got} == want and {x["type"] for x in got} == {"Robot"} and set(want) == {"R1", "R2", "R3"}
    assert spark.sql("SELECT m.* FROM {r} r, LATERAL mapped_entities('other.csv', map('name', r.name)) m", r=rows).count() == 0
