"""Queries for text, search, extraction, mapping, evaluation and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.functions import text as fn
from trellisgraph.lineage import scratch
from trellisgraph.operators import cells, extract, patterns, postings, retrieve, search, stats
from trellisgraph.plans.registry import query
from trellisgraph.plans.star import read, star
from trellisgraph.sources import cad, files, mapping
from trellisgraph.streaming import jobs

_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+|[一-鿿]')"


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents").select("doc_id", *columns)


# Text functions ------------------------------------------------------------------------------------------------


@query("c03_token_estimate", "SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(text, '[a-zA-Z]+')) * 1.3 + length(text) // 6) AS INTEGER) AS tokens FROM documents")
def c03(spark, sf_dir):
    return _docs(spark, sf_dir, fn.token_estimate(F.col("text")).alias("tokens"))


@query("c04_chunks", "SELECT doc_id, i // 1000 AS chunk, sha256(substring(text, i + 1, 1000)) AS h FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1000)) AS i FROM documents)")
def c04(spark, sf_dir):
    return _docs(spark, sf_dir, F.posexplode(fn.chunks(F.col("text"), 1000)).alias("chunk", "t")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha2("t", 256).alias("h"))


@query("c06_clean", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'))) AS h FROM documents")
def c06(spark, sf_dir):
    return _docs(spark, sf_dir, F.sha2(fn.clean(F.col("text")), 256).alias("h"))


@query("c07_shortened", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN 3500 + 15 ELSE length(text) END AS n FROM documents")
def c07(spark, sf_dir):
    return _docs(spark, sf_dir, F.length(fn.shortened(F.col("text"))).alias("n"))


@query("c08_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def c08(spark, sf_dir):
    return _docs(spark, sf_dir, F.sha2("text", 256).alias("h"))


@query("c09_base_name", r"SELECT page_id, regexp_extract(url, '[^/\\]+$') AS name FROM pages")
def c09(spark, sf_dir):
    from trellisgraph.operators.write import base_name

    return read(spark, sf_dir, "pages").select("page_id", base_name(F.col("url")).alias("name"))


@query("c10_url_host", "SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host FROM pages")
def c10(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(F.try_parse_url("url", F.lit("PROTOCOL")), F.lit("")).alias("scheme"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))


@query("w15_url_problem", "SELECT page_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN NULL ELSE 'scheme' END AS problem FROM pages")
def w15(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", files.url_problem(F.col("url")).alias("problem"))


@query("c11_page_text")
def c11(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", files.html_text("html").alias("text"))


@query("c12_keywords", "SELECT doc_id, len(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+'))) AS n FROM documents")
def c12(spark, sf_dir):
    return _docs(spark, sf_dir, F.size(fn.keywords(F.col("text"))).cast("long").alias("n"))


@query("c15_judged_score", r"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN (turn % 11) / 10.0 END::DOUBLE AS score FROM conversations")
def c15(spark, sf_dir):
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"score": '), (F.col("turn") % 11).cast("string"), F.lit(', "reason": "x"}'))).otherwise("no number here")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", fn.judged_score(said).alias("score"))


@query("c16_citation_numbers", "SELECT conv_id, turn, 2 AS n, CAST(turn AS INTEGER) AS first FROM conversations")
def c16(spark, sf_dir):
    t = F.col("turn").cast("string")
    said = F.concat(F.lit("As [P"), t, F.lit("] and [P99999] show, see [P"), t, F.lit("]."))
    n = fn.citation_numbers(said)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(n).alias("n"), F.get(n, F.lit(0)).alias("first"))


_VERDICTS = r"""
WITH a AS (SELECT doc_id AS answer_id, substring(text, 1, 50) || ' [P1]' AS s, lower(regexp_extract(text, '[^ \t\r\n]+')) AS n FROM documents),
v AS (
  SELECT answer_id, 1 AS index,
    CASE WHEN answer_id % 5 = 0 THEN 'invalid_ref' WHEN answer_id % 5 = 1 THEN 'empty_path'
      WHEN len(list_filter(regexp_extract_all(s, '[A-Z][\p{L}\p{N}_\-]{2,}|[一-鿿]{2,6}'), lambda x: length(x) >= 3
        AND upper(x) NOT IN ('THE', 'AND', 'FOR', 'HAS', 'ITS', 'CAN', 'ALL', 'NOT', 'THIS', 'THAT', 'WITH', 'FROM', 'WHEN', 'WILL', 'WHAT', 'WHICH', 'THEIR', 'ABOUT', 'THERE', 'WOULD', 'COULD')
        AND NOT contains(n, lower(x)) AND NOT contains(lower(x), n))) > 0 THEN 'unsupported_entity' ELSE 'ok' END AS verdict
  FROM a
)
"""


@query("c18_citation_verdicts", _VERDICTS + "SELECT answer_id, index, verdict FROM v")
def c18(spark, sf_dir):
    """The beginnings of all documents as answers that cite a path over their own first word; some paths are null or missing."""
    docs = _docs(spark, sf_dir, "text")
    answers = docs.select(F.col("doc_id").alias("answer_id"), F.concat(F.substring("text", 1, 50), F.lit(" [P1]")).alias("answer"))
    nodes = F.when(F.col("doc_id") % 5 != 1, F.array(F.regexp_extract("text", r"[^ \t\r\n]+", 0)))
    paths = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("answer_id"), F.lit(1).alias("index"), nodes.alias("nodes"))
    return retrieve.verified_citations(answers, paths).select("answer_id", "index", "verdict")


@query("a18_citation_summary", _VERDICTS + "SELECT answer_id, 1 AS total, CAST(verdict = 'ok' AS BIGINT) AS ok, CAST(verdict = 'invalid_ref' AS BIGINT) AS invalid_ref, CAST(verdict = 'empty_path' AS BIGINT) AS empty_path, CAST(verdict = 'unsupported_entity' AS BIGINT) AS unsupported_entity FROM v")
def a18(spark, sf_dir):
    return retrieve.citation_summary(c18(spark, sf_dir))


@query("p20_model_output", "SELECT conv_id, turn, 1 AS entities, 'E' || turn AS name FROM conversations")
def p20(spark, sf_dir):
    said = F.concat(F.lit('Here:\n```json\n{"entities": [{"name": "E'), F.col("turn").cast("string"), F.lit('", "type": "Robot"}], "relations": []}\n``` done'))
    rows = extract.parsed_model_output(read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text")))
    return rows.select("conv_id", "turn", F.size("entities").alias("entities"), F.get("entities", F.lit(0))["name"].alias("name"))


@query("p21_cut_json_array", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS n FROM conversations")
def p21(spark, sf_dir):
    whole = '[{"a": "1"}, {"a": "2"}]'
    said = F.when(F.col("turn") % 2 == 0, whole).otherwise(whole[:-6])
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(fn.json_array(said, "array<struct<a:string>>")).alias("n"))


# Search --------------------------------------------------------------------------------------------------------


@query("f02_inverted_index", f"WITH w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY term")
def f02(spark, sf_dir):
    postings, _ = search.inverted_index(_docs(spark, sf_dir, "text"), "doc_id", F.col("text"))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_BM25 = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / m))) AS score FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY ALL)
"""


@query("f01_bm25", _BM25 + "SELECT item_id AS query_id, count(*) AS n, round(max(score), 5) AS best, round(sum(score), 3) AS total FROM r GROUP BY item_id")
def f01(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = search.bm25(_docs(spark, sf_dir, "text"), "doc_id", F.col("text"), q)
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 5).alias("best"), F.round(F.sum("score"), 3).alias("total"))


@query("f01_stored_index", _BM25 + ", t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) SELECT item_id AS query_id, count(*) AS n, round(max(score), 5) AS best, round(sum(score), 3) AS total FROM t WHERE rank <= 10 GROUP BY item_id")
def f01_stored(spark, sf_dir):
    """The ten best documents of every item from an index of four fifths of the documents and the postings of the rest."""
    docs = _docs(spark, sf_dir, "text")
    index = postings.build(docs.where("doc_id % 5 <> 0"), "doc_id", F.col("text"), scratch(spark)).with_new(docs.where("doc_id % 5 = 0"), "doc_id", F.col("text"))
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return postings.search(index, q, 10).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 5).alias("best"), F.round(F.sum("score"), 3).alias("total"))


@query("f07_names_in_documents", "WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS name FROM benchmark) SELECT name, count(*) AS n_docs FROM n JOIN documents ON contains(lower(text), name) GROUP BY name")
def f07_names(spark, sf_dir):
    """In how many documents each longer word of the benchmark is, inside other words too."""
    names = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), 0)).alias("name"))
    found = patterns.occurrences(_docs(spark, sf_dir, F.lower("text").alias("text")), "doc_id", "text", names, first=True)
    return found.groupBy("name").agg(F.count("*").alias("n_docs"))


@query("f03_substring", "SELECT 'Part::' || p_partkey AS node_id, p_name AS name FROM part WHERE contains(p_name, '1') ORDER BY node_id LIMIT 10")
def f03(spark, sf_dir):
    return search.substring_hits(star(spark, sf_dir).nodes.where("label = 'Part'"), "1").select("node_id", "name")


@query("f05_fulltext_fallback", "SELECT 'Customer::' || c_custkey AS node_id FROM customer WHERE contains(c_name, 'ustomer#') ORDER BY node_id LIMIT 10")
def f05(spark, sf_dir):
    """No token matches, so names that contain the text come back."""
    return search.fulltext(star(spark, sf_dir).nodes.where("label = 'Customer'"), "ustomer#").select("node_id")


_VECTORS = """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT query_id, id, {0} AS score FROM b, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 5"""


def _queries(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("v02_vector_top_k", _VECTORS.format("list_dot_product(v, q)"))
def v02(spark, sf_dir):
    rows = search.vector_search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _queries(spark, sf_dir), 5)
    return rows.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("v03_cosine_top_k", _VECTORS.format("list_cosine_similarity(v, q)"))
def v03(spark, sf_dir):
    rows = search.vector_search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _queries(spark, sf_dir), 5, normalized=False)
    return rows.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _cells(spark, sf_dir):
    return cells.build(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", scratch(spark))


@query("v01_cells_exact", _VECTORS.format("list_dot_product(v, q)"))
def v01_exact(spark, sf_dir):
    """The exact path of the stored vector index."""
    rows = cells.search(_cells(spark, sf_dir), _queries(spark, sf_dir), 5, exact=True)
    return rows.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("v01_vector_cells")
def v01(spark, sf_dir):
    """The ten nearest by cosine from the eight cells nearest to each query."""
    rows = cells.search(_cells(spark, sf_dir), _queries(spark, sf_dir), 10, probes=8, normalized=False)
    return rows.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("v05_hyperplane_buckets")
def v05(spark, sf_dir):
    return search.hyperplane_buckets(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)


@query("v04_hashed_embedding", "SELECT p_partkey, true AS unit FROM part")
def v04(spark, sf_dir):
    v = search.hashed_embedding(search.embedding_text(F.lit("Part"), F.col("p_name"), F.col("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", (F.abs(search.dot(F.col("v"), F.col("v")) - 1) < 1e-5).alias("unit"))


@query(
    "f04_hybrid",
    "WITH v AS (SELECT p_name AS name, max(p_size)::DOUBLE AS score FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), k AS (SELECT p_name AS name, max(p_retailprice) AS score FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), u AS (SELECT *, 'vector' AS source, 0 AS s, row_number() OVER (ORDER BY score DESC, name) AS r FROM v UNION ALL SELECT *, 'fulltext', 1, row_number() OVER (ORDER BY score DESC, name) FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s, r) AS f FROM u) SELECT name, score, source, rank FROM (SELECT *, row_number() OVER (ORDER BY s, r) AS rank FROM f WHERE f = 1) WHERE rank <= 8",
)
def f04(spark, sf_dir):
    top = lambda c: read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.max(c).cast("double").alias("score")).orderBy(F.desc("score"), "name").limit(5)
    return search.hybrid(top("p_size"), top("p_retailprice"), 8).select("name", "score", "source", F.col("rank").cast("long").alias("rank"))


@query("f06_link_entities", "SELECT s_suppkey AS mention_id, 'Supplier::' || s_suppkey AS node_id, 100.0 AS score FROM supplier")
def f06(spark, sf_dir):
    """Every supplier's name, in capitals, linked to the suppliers that share its number."""
    s = read(spark, sf_dir, "supplier")
    mentions = s.select(F.col("s_suppkey").alias("mention_id"), F.upper("s_name").alias("mention"))
    candidates = s.select(F.col("s_suppkey").alias("mention_id"), F.concat(F.lit("Supplier::"), "s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    return search.link(mentions, candidates).select("mention_id", "node_id", "score")


@query("f07_spans", "SELECT n_nationkey AS query_id, n_name AS name, 6 AS start FROM nation")
def f07(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    queries = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("from "), "n_name", F.lit(" today")).alias("query"))
    rows = search.spans(queries, n.select(F.col("n_name").alias("name")))
    own = n.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("name"))
    return rows.join(own, ["query_id", "name"], "left_semi").select("query_id", "name", "start")


@query("f11_normalized_names", r"SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS plain, regexp_replace(lower(p_name), '[\s\-]', '', 'g') AS bare FROM part")
def f11(spark, sf_dir):
    from trellisgraph.operators.write import bare_name, plain_name

    return read(spark, sf_dir, "part").select("p_partkey", plain_name(F.col("p_name")).alias("plain"), bare_name(F.col("p_name")).alias("bare"))


@query("f12_exact_duplicates", "WITH x AS (SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT upper(p_brand) FROM part)), y AS (SELECT name, regexp_replace(lower(name), '[\\s\\-]', '', 'g') AS k FROM x), m AS (SELECT k, min(name) AS a FROM y GROUP BY k HAVING count(*) > 1) SELECT 'Brand' AS type, a, name AS b FROM y JOIN m USING (k) WHERE name <> a")
def f12(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    names = p.select("p_brand").unionAll(p.select(F.upper("p_brand"))).select(F.lit("Brand").alias("type"), F.col("p_brand").alias("name"))
    return search.exact_duplicates(names)


# Extraction and mapping ----------------------------------------------------------------------------------------

_RULES = r"""
WITH m AS (
  SELECT doc_id, 'Manufacturer' AS type, unnest(regexp_extract_all(text, '(FANUC|ABB|KUKA|Yaskawa|Kawasaki|Epson|Stäubli|Comau|Nachi|Universal Robots|UR|Estun)', 1, 'i')) AS name FROM documents
  UNION ALL SELECT doc_id, 'Reducer', unnest(regexp_extract_all(text, '(SHG[\-]?\d+[A-Z]*)', 1, 'i')) FROM documents
  UNION ALL SELECT doc_id, 'Standard', unnest(regexp_extract_all(text, '((?:ISO|GB|IEC|EN|DIN|JIS)\s*[\d\-\.]+[\pL\pN\pM_]*)', 1, 'i')) FROM documents),
e AS (SELECT DISTINCT doc_id, type, trim(name) AS name FROM m WHERE trim(name) <> '')"""


@query("e03_rule_entities", _RULES + "SELECT doc_id, type, name, 0.95::DOUBLE AS confidence FROM e")
def e03(spark, sf_dir):
    """The rules over all texts; the patterns that need Han characters find nothing in these."""
    return extract.entities(_docs(spark, sf_dir, "text")).select("doc_id", "type", "name", "confidence")


@query(
    "e04_rule_relations",
    "SELECT p_partkey AS doc_id, 'manufactures' AS type, 'KUKA' AS src_name, 'R' || p_partkey || '机器人' AS dst_name FROM part UNION ALL SELECT p_partkey, 'uses_reducer', 'R' || p_partkey || '机器人', 'X' || p_size || '减速器' FROM part",
)
def e04(spark, sf_dir):
    """A note for every part, who makes it and with which reducer."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    note = F.concat(F.lit("KUKA 推出 R"), k, F.lit("机器人。R"), k, F.lit("机器人 采用 X"), n, F.lit("减速器。"))
    return extract.relations(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), note.alias("text"))).select("doc_id", "type", "src_name", "dst_name")


@query("e01_pattern_counts", _RULES.split(",\ne AS")[0] + " SELECT doc_id, count(*) AS n FROM m WHERE type = 'Manufacturer' GROUP BY doc_id")
def e01(spark, sf_dir):
    """How often the pattern of known makers is found in a text."""
    pattern = next(p for kind, p in extract.ENTITY_PATTERNS if kind == "Manufacturer")
    return _docs(spark, sf_dir, F.size(extract.matches(F.col("text"), pattern)).cast("long").alias("n")).where("n > 0")


@query(
    "a08_merge_entities",
    "SELECT l_orderkey AS doc_id, l_returnflag AS name, max(round(1 - l_discount, 4)) AS confidence, CAST(min(l_partkey) AS VARCHAR) AS v FROM lineitem GROUP BY 1, 2",
)
def a08(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("Flag").alias("type"), F.col("l_returnflag").alias("name"), F.create_map(F.lit("v"), F.col("l_partkey").cast("string")).alias("props"), F.round(1 - F.col("l_discount"), 4).alias("confidence"), F.col("l_partkey").alias("ord"))
    return extract.merged(rows).select("doc_id", "name", "confidence", F.col("props")["v"].alias("v"))


@query("a10_funnel", _RULES + ", n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id) SELECT count(*) AS n FROM documents LEFT JOIN n USING (doc_id) WHERE coalesce(n, 0) < 3")
def a10(spark, sf_dir):
    """Texts with fewer than three entities go to the model, here one that names the text's language."""
    model = lambda d: d.select("doc_id", F.lit("Language").alias("type"), F.col("lang").alias("name"), F.create_map().cast("map<string,string>").alias("props"), F.lit(0.1).alias("confidence"), F.lit(0).cast("long").alias("ord"))
    return extract.funnel(_docs(spark, sf_dir, "text", "lang"), model).where("confidence = 0.7").agg(F.count("*").alias("n"))


@query("p01_mapped_rows", "SELECT p_name AS name, CAST(trunc(p_retailprice) AS INTEGER) AS price, p_size > 0 AS flag FROM part WHERE p_name <> ''")
def p01(spark, sf_dir):
    rule = mapping.Rule(r"parts.*\.csv", "Part", {"p_retailprice": ("price", "int"), "flag": ("flag", "boolean"), "missing": ("missing", "string")}, key="p_name")
    rows = read(spark, sf_dir, "part").withColumn("flag", F.when(F.col("p_size") > 0, "yes").otherwise("no"))
    out = mapping.to_entities(rows, rule)
    return out.select("name", F.col("props")["price"].cast("int").alias("price"), F.col("props")["flag"].cast("boolean").alias("flag"))


@query("p04_mapped_relations", "SELECT 'L' || l_orderkey AS src_name, 'P' || l_partkey AS dst_name, l_linenumber AS quantity FROM lineitem WHERE l_orderkey % 10 <> 0")
def p04(spark, sf_dir):
    rule = mapping.Rule(r"lines.*\.csv", "contains", {"l_linenumber": ("quantity", "int")}, src=("Order", "a"), dst=("Part", "b"))
    rows = read(spark, sf_dir, "lineitem").withColumn("a", F.when(F.col("l_orderkey") % 10 != 0, F.concat(F.lit("L"), "l_orderkey"))).withColumn("b", F.concat(F.lit("P"), "l_partkey"))
    return mapping.to_relations(rows, rule).select("src_name", "dst_name", F.col("props")["quantity"].cast("int").alias("quantity"))


@query("p02_conversions", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS whole, o_orderkey % 2 = 0 AS flag, CAST(NULL AS DOUBLE) AS unreadable FROM orders")
def p02(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", fn.converted(F.col("o_totalprice"), "integer").alias("whole"), fn.converted(F.when(F.col("o_orderkey") % 2 == 0, "TRUE").otherwise("0"), "boolean").alias("flag"), fn.converted(F.col("o_orderpriority"), "float").alias("unreadable"))


@query("p16_dimension_text", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'diameter' WHEN 1 THEN 'thread' ELSE 'linear' END AS kind, p_size::DOUBLE AS value FROM part")
def p16(spark, sf_dir):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Ø"), n)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("M"), n)).otherwise(F.concat(n, F.lit(" mm")))
    return read(spark, sf_dir, "part").select("p_partkey", cad.dimension(text).alias("d")).select("p_partkey", "d.kind", "d.value")


@query("s19_step_scan", "SELECT p_partkey, p_name AS product, p_brand AS part_number FROM part WHERE p_name <> ''")
def s19(spark, sf_dir):
    """A STEP text written for every part and read again."""
    text = F.concat(F.lit("ISO-10303-21;\nDATA;\n#1=PRODUCT('"), "p_brand", F.lit("','"), "p_name", F.lit("','',(#2));\n#3=CARTESIAN_POINT('',(1.,2.5,-3.E1));\nENDSEC;"))
    meta = cad.step_metadata(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))
    return cad.step_products(meta).select(F.col("path").cast("long").alias("p_partkey"), "product", "part_number")


@query("s16_dxf_scan", "SELECT s_suppkey, 'S' || s_nationkey AS layer FROM supplier")
def s16(spark, sf_dir):
    """A DXF text with one layer written for every supplier and read again."""
    text = F.concat(F.lit("0\nSECTION\n2\nTABLES\n0\nLAYER\n2\nS"), F.col("s_nationkey").cast("string"), F.lit("\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nINSERT\n2\nBOLT\n10\n1.5\n20\n2.5\n0\nENDSEC\n0\nEOF\n"))
    meta = cad.dxf_metadata(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), text.alias("text")))
    return meta["layers"].select(F.col("path").cast("long").alias("s_suppkey"), F.col("name").alias("layer"))


# Evaluation ----------------------------------------------------------------------------------------------------


@query("a15_precision_recall", "WITH g AS (SELECT doc_id, 'good' AS label FROM labels WHERE quality = 1), p AS (SELECT doc_id, 'good' AS label FROM labels JOIN documents USING (doc_id) WHERE n_chars > 1000), c AS (SELECT count(*) FILTER (WHERE g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id) SELECT 'good' AS label, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall FROM c")
def a15(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    gold = labels.where("quality = 1").select("doc_id", F.lit("good").alias("label"))
    found = labels.join(_docs(spark, sf_dir, "n_chars"), "doc_id").where("n_chars > 1000").select("doc_id", F.lit("good").alias("label"))
    return stats.precision_recall(gold, found, ["doc_id"]).select("label", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("a17_sample_quality", "SELECT CASE WHEN n_chars > 2000 THEN 'good' WHEN n_chars > 500 THEN 'ok' ELSE 'review' END AS quality, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1")
def a17(spark, sf_dir):
    rows = _docs(spark, sf_dir, F.when(F.col("n_chars") > 2000, "good").when(F.col("n_chars") > 500, "ok").otherwise("review").alias("quality"), F.col("n_chars").alias("entities"), F.col("n_chars").alias("relations"))
    return stats.sample_quality(rows).select("quality", "n", F.round("mean_entities", 4).alias("mean"))


@query("c21_grades", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN quality = 1 THEN 'ok' ELSE 'review' END AS grade FROM labels")
def c21(spark, sf_dir):
    return read(spark, sf_dir, "labels").select("doc_id", extract.grade(3 * F.col("quality"), 2 * (1 - F.col("toxic"))).alias("grade"))


@query("a22_log_totals", "SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 7 <> 0) AS succeeded, count(*) FILTER (WHERE doc_id % 7 = 0) AS failed, CAST(sum(n_chars) AS BIGINT) AS entities, CAST(sum(doc_id) AS BIGINT) AS relations FROM documents")
def a22(spark, sf_dir):
    return stats.log_totals(_docs(spark, sf_dir, (F.col("doc_id") % 7 != 0).alias("success"), F.col("n_chars").alias("entities"), F.col("doc_id").alias("relations")))


@query("o08_token_budget", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, CAST(floor(len(regexp_extract_all(x, '[a-zA-Z]+')) * 1.3 + length(x) // 6) AS INTEGER) AS tokens FROM (SELECT *, 'P' || row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) || ': ' || source || ' ' || lang AS x FROM documents)), s AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY rank) AS spent FROM r) SELECT source, doc_id, rank FROM s WHERE rank <= 10 AND (rank = 1 OR spent <= 25)")
def o08(spark, sf_dir):
    rows = _docs(spark, sf_dir, "source", "n_chars", F.concat_ws(" ", "source", "lang").alias("line"))
    return retrieve.budgeted(rows, ["source"], [F.desc("n_chars"), F.col("doc_id")], tokens=25).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("o04_first_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def o04(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return _docs(spark, sf_dir, "source", "n_chars").withColumn("r", r).where("r <= 3").select("source", "doc_id")


# Windows over events -------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("n07_tumbling_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def n07(spark, sf_dir):
    rows = jobs.tumbling(_events(spark, sf_dir))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("n07_sliding_counts", "SELECT strftime(date_trunc('hour', ts) - to_hours(i), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1")
def n07s(spark, sf_dir):
    return jobs.sliding(_events(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "n07_sessions",
    "WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM y GROUP BY user_id, k",
)
def n07x(spark, sf_dir):
    return jobs.sessions(_events(spark, sf_dir)).select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))
