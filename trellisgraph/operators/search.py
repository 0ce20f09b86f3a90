"""Search: inverted index with BM25, substrings, vectors, hybrid lists, entity linking and duplicate candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trellisgraph.functions.text import search_tokens
from trellisgraph.lineage import cut
from trellisgraph.operators import local
from trellisgraph.operators.patterns import occurrences

#: Query vectors that go to every task at once.
QUERY_BYTES = 32 << 20
#: Windows that are compared at once.
WINDOWS = 1 << 18


def inverted_index(rows: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(postings: term, id, tf, len; terms: term, df). A term's postings are spread by the aggregation."""
    words = rows.select(F.col(id_col).alias("id"), search_tokens(F.coalesce(text, F.lit(""))).alias("w"))
    words = words.withColumn("len", F.size("w")).select("id", "len", F.explode("w").alias("term"))
    postings = words.groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    return postings, postings.groupBy("term").agg(F.count("*").alias("df"))


def bm25(rows: DataFrame, id_col: str, text: Column, queries: DataFrame, k1: float = 1.2, b: float = 0.75, limit: int | None = None) -> DataFrame:
    """(query_id, id, score) for queries (query_id, query); the best ``limit`` of each, ties by id.

    Queries of up to ``LOCAL_WORDS`` words in all go to every task, and a text is scored where it lies (k1 and b as given by
    default, ids that are not repeated). Otherwise words that no query has are dropped by a semi join before anything is
    grouped; the term side of that join is as large as the queries.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("query")))).alias("term")).distinct()
    if (k1, b) == (local.K1, local.B) and asked.count() <= local.LOCAL_WORDS and not local.repeated(rows, id_col):
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema[id_col].dataType.simpleString()}, score double"
        found = local.bm25(rows, id_col, text, asked.toArrow(), schema, limit)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found if limit is None else found.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")
    words = rows.select(F.col(id_col).alias("id"), search_tokens(F.coalesce(text, F.lit(""))).alias("w")).withColumn("len", F.size("w"))
    stats = words.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))
    terms = queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("query")))).alias("term"))
    wanted = terms.select("term").distinct()
    hits = words.select("id", "len", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(terms, "term").join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    out = scored.groupBy("query_id", "id").agg(F.sum(weight).alias("score"))
    if limit is None:
        return out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def substring_hits(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(node_id, label, name, score 1.0) of names that contain the query, by id; an empty query matches all."""
    return nodes.where(F.contains("name", F.lit(query))).select("node_id", "label", "name", F.lit(1.0).alias("score")).orderBy("node_id").limit(limit)


def fulltext(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(node_id, label, name, score): BM25 over name and description, or names that contain the query if none scores."""
    spark = nodes.sparkSession
    text = F.concat_ws(" ", "name", F.col("props")["description"])
    found = bm25(nodes, "node_id", text, spark.createDataFrame([(0, query)], "query_id int, query string"), limit=limit)
    hits = found.select(F.col("id").alias("node_id"), "score").join(nodes.select("node_id", "label", "name"), "node_id").select("node_id", "label", "name", "score")
    any_hit = hits.agg(F.count("*").alias("_n"))
    spare = substring_hits(nodes, query, limit).crossJoin(F.broadcast(any_hit)).where("_n = 0").drop("_n")  # one row
    return hits.unionByName(spare)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(v: Column) -> Column:
    """Neither null nor all zero."""
    return v.isNotNull() & F.exists(v, lambda x: x != 0)


def _regular(v: Column) -> Column:
    """Numbers only, none so great or small that a product overflows or vanishes: what matrix products may be used for."""
    return F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e100) & ((x == 0) | (F.abs(x) > 1e-100)))


def _rescored(v: np.ndarray, q: np.ndarray, cosine_: bool) -> np.ndarray:
    """The score of each pair of rows, summed place by place as ``dot`` does, so equal vectors score the same."""
    total = [np.zeros(len(v)) for _ in range(3 if cosine_ else 1)]
    for i in range(v.shape[1]):
        total[0] = total[0] + v[:, i] * q[:, i]
        if cosine_:
            total[1], total[2] = total[1] + v[:, i] * v[:, i], total[2] + q[:, i] * q[:, i]
    return total[0] / (np.sqrt(total[1]) * np.sqrt(total[2])) if cosine_ else total[0]


def _best_of(held, top_k: int, cosine_: bool, rows: int = 2048, queries: int = 1024):
    """The ``top_k`` of each query among a task's vectors. Matrix products choose, with room for their rounding, which pairs
    are scored in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flat, lengths = held.value
        ends = np.cumsum(lengths)
        groups = []  # queries of one length at a time
        for n in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == n)
            for at in range(0, len(own), queries):
                number = own[at : at + queries]
                q = flat[(ends[number] - n)[:, None] + np.arange(n)]
                size = np.linalg.norm(q, axis=1)
                groups.append([n, number, q, size, np.full(len(q), -np.inf), None])
        for batch in batches:
            size_of = np.asarray(batch.column("v").value_lengths())
            for group in groups:
                n, number, q, size, least, best = group
                some = batch.filter(pa.array(size_of == n))
                for at in range(0, some.num_rows, rows):
                    part = some.slice(at, rows)
                    v = np.asarray(part.column("v").flatten(), np.float64).reshape(-1, n)
                    norm = np.linalg.norm(v, axis=1)
                    if cosine_:
                        near, slack = (v / norm[:, None]) @ (q / size[:, None]).T, np.full(len(q), 1e-9)
                    else:
                        near, slack = v @ q.T, 1e-9 * size * norm.max(initial=0.0)
                    floor = least
                    if len(v) >= top_k and not np.isfinite(least).all():
                        floor = np.maximum(least, np.partition(near, len(v) - top_k, axis=0)[len(v) - top_k])
                    r, c = np.nonzero(near >= floor - 2 * slack)
                    if not len(r):
                        continue
                    new = pa.table({"q": number[c], "score": _rescored(v[r], q[c], cosine_), "id": part.column("id").take(pa.array(r)), "c": c})
                    best = new if best is None else pa.concat_tables([best, new])
                    best = best.take(pc.sort_indices(best, [("c", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
                    c = best.column("c").to_numpy()
                    place = np.arange(len(c)) - np.searchsorted(c, c)
                    last = place == top_k - 1
                    least = least.copy()
                    least[c[last]] = best.column("score").to_numpy()[last]
                    group[4], group[5] = least, best.filter(pa.array(place < top_k))
                    best = group[5]
        for *_, best in groups:
            if best is not None:
                best = best.combine_chunks()
                yield from pa.table({"query_id": ids.take(best.column("q").combine_chunks()), "id": best.column("id"), "score": best.column("score")}).to_batches(1 << 16)

    return run


def _by_pairs(base: DataFrame, queries: DataFrame, normalized: bool) -> DataFrame:
    """(query_id, id, score) of all pairs of one length; the queries go to every task."""
    score = dot(F.col("v"), F.col("q")) if normalized else cosine(F.col("v"), F.col("q"))
    return base.join(F.broadcast(queries), F.size("v") == F.size("q")).select("query_id", "id", score.alias("score"))


def vector_search(rows: DataFrame, id_col: str, vec_col: str, queries: DataFrame, top_k: int = 10, normalized: bool = True) -> DataFrame:
    """(query_id, id, score): the exact best by dot product (or cosine) for queries (query_id, q), ties by id.

    The query side is a stated set; it is measured and goes to every task in blocks of at most ``QUERY_BYTES``. A task keeps
    the best of its vectors before the shuffle. Vectors and queries with nulls, numbers that are none or very great ones,
    and queries of zeros, are compared pair by pair.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v")))
    size = queries.agg(F.coalesce(F.sum(8 * F.size("q") + 32), F.lit(0))).first()[0]
    blocks = 1 + int(size) // QUERY_BYTES
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    plain = _regular(F.col("q")) & usable(F.col("q"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    sc, out = rows.sparkSession.sparkContext, None
    for b in range(blocks):
        own = queries.select("query_id", "q") if blocks == 1 else queries.select("query_id", "q").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        listed = own.where(plain).withColumn("q", F.col("q").cast("array<double>")).toArrow().combine_chunks()
        if listed.num_rows:
            q = listed.column("q").combine_chunks()
            ids = listed.column("query_id").combine_chunks()
            held = sc.broadcast((ids, np.asarray(q.flatten(), np.float64), np.asarray(q.value_lengths(), np.int64)))
            numbered = base.where(_regular(F.col("v"))).select("id", F.col("v").cast("array<double>").alias("v"))
            near = numbered.mapInArrow(_best_of(held, top_k, not normalized), f"query_id {kind(queries, 'query_id')}, id {kind(base, 'id')}, score double")
        else:
            near = base.limit(0).crossJoin(own.select("query_id").limit(0)).select("query_id", "id", F.lit(0.0).alias("score"))
        pairs = near.unionByName(_by_pairs(base.where(~_regular(F.col("v"))), own, normalized)).unionByName(_by_pairs(base.where(_regular(F.col("v"))), own.where(~F.coalesce(plain, F.lit(False))), normalized))
        best = pairs.withColumn("rank", rank).where(F.col("rank") <= top_k)
        out = best if out is None else out.unionByName(best)
    return out


def hyperplane_buckets(rows: DataFrame, id_col: str, vec_col: str, dim: int, bits: int = 8, tables: int = 4) -> DataFrame:
    """(id, table, bucket): sign patterns on fixed pseudo-random planes, for approximate candidates."""
    sign = lambda t, k: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.pmod(F.xxhash64(F.lit(t), F.lit(k), i), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    cols = [F.struct(F.lit(t).alias("table"), sum((F.when(dot(F.col("v"), sign(t, k)) > 0, F.lit(1 << k)).otherwise(0) for k in range(bits)), F.lit(0)).alias("bucket")) for t in range(tables)]
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v"))).select("id", F.inline(F.array(*cols)))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int = 10) -> DataFrame:
    """(name, score, source, rank) of two lists (name, score): vector hits first, the first of each name stays."""
    def part(df: DataFrame, source: str, n: int) -> DataFrame:
        best = df.groupBy("name").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "name").limit(limit)  # so the windows below hold few rows
        return best.select("name", "score", F.lit(source).alias("source"), F.lit(n).alias("_s"), F.row_number().over(Window.orderBy(F.desc("score"), "name")).alias("_r"))

    rows = part(vector_hits, "vector", 0).unionByName(part(keyword_hits, "fulltext", 1))
    first = rows.withColumn("_f", F.row_number().over(Window.partitionBy("name").orderBy("_s", "_r"))).where("_f = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("_s", "_r")))
    return ranked.where(F.col("rank") <= limit).select("name", "score", "source", "rank")


def _subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of the table being the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - (insertions + deletions) / total length; 1 for two empty strings, a null is empty."""
    return pd.Series([2 * _subsequence(x or "", y or "") / (len(x or "") + len(y or "")) if x or y else 1.0 for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best indel ratio of the shorter string with a window of the longer one, of its length or shorter at the ends;
    0 if either is null or empty."""

    pairs = [tuple(sorted((x, y), key=len)) if x and y else None for x, y in zip(a, b)]
    out = np.zeros(len(pairs))
    short = [i for i, p in enumerate(pairs) if p and len(p[0]) <= 64]
    size = np.cumsum([len(pairs[i][0]) + len(pairs[i][1]) for i in short]) // WINDOWS  # windows of a piece
    for piece in np.unique(size):
        own = [i for i, k in zip(short, size) if k == piece]
        out[own] = _partial_ratios([pairs[i] for i in own])
    for i, p in enumerate(pairs):
        if p and len(p[0]) > 64:
            out[i] = max(2 * _subsequence(p[0], p[1][u:v]) / (len(p[0]) + v - u) for u, v in _spans(len(p[0]), len(p[1])))
    return pd.Series(out)


def _spans(m: int, n: int) -> list[tuple[int, int]]:
    return [(i, i + m) for i in range(n - m + 1)] + [(0, k) for k in range(1, m)] + [(n - k, n) for k in range(1, m)]


def _partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The partial ratio of each (shorter of at most 64 characters, longer), all windows of all pairs at once, a row of each
    table being the bits of one number as in ``_subsequence``."""
    known = {c: k for k, c in enumerate(dict.fromkeys("".join(x for x, _ in pairs)), 1)}
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    places = np.zeros((len(pairs), len(known) + 1), np.uint64)
    for i, (x, _) in enumerate(pairs):
        for k, c in enumerate(x):
            places[i, known[c]] |= np.uint64(1 << k)
    # ``m`` zeros on either side of the longer text: a window at its ends is one that hangs over, and zeros hit nothing
    text = np.array([k for x, y in pairs for k in [0] * len(x) + [known.get(c, 0) for c in y] + [0] * len(x)], np.int64)
    first = np.cumsum(np.append(0, n + 2 * m))[:-1]
    windows = n + m - 1
    pair = np.repeat(np.arange(len(pairs)), windows)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(windows) - windows, windows) + 1  # from 1: one character inside
    length = np.minimum(np.minimum(at, m[pair]), n[pair] + m[pair] - at)
    full = np.array([(1 << int(k)) - 1 for k in m], np.uint64)[pair]
    row, start = full.copy(), first[pair] + at
    for k in range(int(m.max())):
        inside = k < m[pair]
        hit = row & np.where(inside, places[pair, text[np.where(inside, start + k, 0)]], np.uint64(0))
        row = (row + hit) | (row - hit)
    common = m[pair] - np.bitwise_count(row & full).astype(np.int64)
    return np.maximum.reduceat(2 * common / (m[pair] + length), np.cumsum(windows) - windows)


def match_score(query: Column, name: Column) -> Column:
    """How well a name fits a query: equal 100; name in query 85 + 10 r; query in name 80 + 10 r, r the ratio of their
    lengths; word Jaccard over 0.3 gives 60 + 20 j; a partial ratio s over 80 of 100 gives 55 + 0.25 (s - 80); else 0.

    The partial ratio is worked out only where nothing before it fits.
    """
    q, n = F.lower(F.trim(query)), F.lower(F.trim(name))
    ratio = F.least(F.length(q), F.length(n)) / F.greatest(F.length(q), F.length(n))
    a, b = F.split(q, r"\s+"), F.split(n, r"\s+")
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    plain = F.when((q == "") | (n == ""), 0.0).when(q == n, 100.0).when(F.contains(q, n), 85 + 10 * ratio).when(F.contains(n, q), 80 + 10 * ratio).when(jaccard > 0.3, 60 + 20 * jaccard)
    alike = 100 * partial_ratio(F.when(plain.isNull(), q), F.when(plain.isNull(), n))
    return F.coalesce(plain, F.when(alike > 80, 55 + 0.25 * (alike - 80)), F.lit(0.0))


def link(mentions: DataFrame, candidates: DataFrame, top_k: int = 5, min_score: float = 60.0, aliases: DataFrame | None = None) -> DataFrame:
    """(mention_id, node_id, score, rank) from candidate pairs (mention_id, mention, node_id, name); best of each first.

    aliases: (name, canonical); a candidate is scored under each of its canonical names too, the best counts. A null
    mention names nothing.
    """
    rows = mentions.where("mention is not null").join(candidates, "mention_id")
    score = match_score(F.col("mention"), F.col("name"))
    if aliases is not None:
        rows = rows.join(aliases.select("name", "canonical").where("canonical is not null").distinct(), "name", "left")
        score = F.greatest(score, match_score(F.col("mention"), F.coalesce("canonical", "name")))
    rows = rows.withColumn("score", score).where(F.col("score") >= min_score)
    best = rows.groupBy("mention_id", "node_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "node_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top_k)


def span_links(pairs: DataFrame, top: int = 10, min_score: float = 70.0) -> DataFrame:
    """(query_id, name, span, score, rank) from candidate pairs (query_id, query, name).

    A name in the query is its span, 85 + 10 r; otherwise the longest common substring of two characters or more is,
    if the match score is ``min_score`` or more. The best of each name, ``top`` a query.
    """
    q, n = F.lower("query"), F.lower("name")
    inside = F.expr("locate(lower(name), lower(query))") > 0
    rows = pairs.where("name <> ''").withColumn("_in", inside).withColumn("_score", F.when(~inside, match_score(F.col("query"), F.col("name"))))
    near = F.col("_score") >= min_score  # only there is the common substring worked out
    rows = rows.withColumn("_common", longest_common(F.when(near, q), F.when(near, n)))
    span = F.when(F.col("_in"), F.expr("substring(query, locate(lower(name), lower(query)), length(name))")).otherwise(F.col("_common"))
    score = F.when(F.col("_in"), 85 + 10 * F.least(F.length("name") / F.length("query"), F.lit(1.0))).when((F.length("_common") >= 2) & (F.col("_score") >= min_score), F.col("_score"))
    found = rows.select("query_id", "name", span.alias("span"), score.alias("score")).where("score is not null")
    best = found.groupBy("query_id", "name").agg(F.max_by("span", "score").alias("span"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)


@F.pandas_udf(T.StringType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """The first longest common substring."""

    def one(x: str | None, y: str | None) -> str:
        x, y = x or "", y or ""
        at = n = 0
        for i in range(len(x)):
            while i + n < len(x) and x[i : i + n + 1] in y:
                at, n = i, n + 1
        return x[at : at + n]

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def spans(queries: DataFrame, entities: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, name, start, score): entity names that occur in a query, 85 + 10 r; best of each name, ``top`` each.

    An automaton over the names reads each query once; ``start`` counts from 1.
    """
    q = queries.select("query_id", F.lower("query").alias("q"))
    n = entities.select("name", F.lower("name").alias("n")).where("n <> ''").distinct()
    found = occurrences(q, "query_id", "q", n, "n", first=True).select(F.col("id").alias("query_id"), F.col("name").alias("n"), (F.col("start") + 1).alias("start"), "length")
    scored = found.join(n, "n").select("query_id", "name", "start", (85 + 10 * F.length("n") / F.col("length")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def exact_duplicates(names: DataFrame) -> DataFrame:
    """(type, a, b) of different names (type, name) that are one after normalisation; pairs with the group's least."""
    key = F.regexp_replace(F.lower("name"), r"[\s\-]", "")
    rows = names.select("type", "name", key.alias("k")).distinct()
    least = rows.groupBy("type", "k").agg(F.min("name").alias("a"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, ["type", "k"]).where("name <> a").select("type", "a", F.col("name").alias("b"))


def _subsequences(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each row of ``a`` with each of ``b``: characters as numbers from 1, at most 64 a row,
    zeros behind. A row of the table is the bits of one number, as in ``_subsequence``."""
    out = np.empty((len(a), len(b)), np.int64)
    columns = [np.ascontiguousarray(b[:, j]) for j in range(int(lb.max(initial=0)))]
    places = np.zeros(int(max(a.max(initial=0), b.max(initial=0))) + 1, np.uint64)
    for i, (x, n) in enumerate(zip(a, la)):
        places[:] = 0
        for k, c in enumerate(x[:n]):
            places[c] |= np.uint64(1 << k)
        full = np.uint64((1 << int(n)) - 1)
        row = np.full(len(b), full)
        for column in columns:  # behind the end of a name nothing is hit, and the row stays
            hit = row & places[column]
            row = (row + hit) | (row - hit)
        out[i] = n - np.bitwise_count(row & full)
    return out


def _fitting(low: float, high: float):
    """The pairs of two blocks of names of one type, or of one block: see ``_all_pairs``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        name, side = table.column("name").combine_chunks(), np.asarray(table.column("side"))
        rank = np.empty(len(name), np.int64)  # Arrow orders texts by their bytes, as Spark does
        rank[np.asarray(pc.sort_indices(name))] = np.arange(len(name))
        lower = table.column("lower").to_pylist()
        known = {c: k for k, c in enumerate(dict.fromkeys("".join(lower)), 1)}
        length = np.array([len(x) for x in lower])
        codes = np.zeros((len(lower), 64), np.int64)
        for i, x in enumerate(lower):
            if len(x) <= 64:
                codes[i, : len(x)] = [known[c] for c in x]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = table.column("x")[0] == table.column("y")[0]  # then both sides hold the same names
        total = length[first][:, None] + length[second][None, :]
        common = np.zeros(total.shape, np.int64)
        short = [np.flatnonzero(length[x] <= 64) for x in (first, second)]
        common[np.ix_(*short)] = _subsequences(codes[first[short[0]]], length[first[short[0]]], codes[second[short[1]]], length[second[short[1]]])
        near = 2 * np.minimum(length[first][:, None], length[second][None, :]) >= low * total - 1e-9
        for i, j in np.argwhere(near & ((length[first] > 64)[:, None] | (length[second] > 64)[None, :])):
            common[i, j] = _subsequence(lower[first[i]], lower[second[j]])
        ratio = 2 * common / total
        i, j = np.nonzero((ratio >= low) & (ratio < high) & ((rank[first][:, None] < rank[second][None, :]) | (not same)))
        one, other = first[i], second[j]
        turned = rank[one] > rank[other]
        a, b = np.where(turned, other, one), np.where(turned, one, other)
        return pa.table({"type": table.column("type").take(pa.array(a)), "a": name.take(pa.array(a)), "b": name.take(pa.array(b)), "score": ratio[i, j]})

    return run


def _all_pairs(n: DataFrame, low: float, high: float, block: int = 1000) -> DataFrame:
    """(type, a, b, score) of all pairs of names (type, name, lower) of one type: every block of names with itself and with
    each later one. A task holds two blocks and the scores of their pairs."""
    many = n.groupBy("type").agg(F.ceil(F.count("*") / block).cast("int").alias("m"))
    rows = n.join(many, "type").withColumn("g", F.pmod(F.xxhash64("name"), F.col("m")).cast("int"))
    to = lambda low, high, make: F.transform(F.sequence(low, high), make)
    sides = F.concat(
        to(F.col("g"), F.col("m") - 1, lambda k: F.struct(F.col("g").alias("x"), k.alias("y"), F.lit(0).alias("side"))),
        to(F.lit(0), F.col("g"), lambda k: F.struct(k.alias("x"), F.col("g").alias("y"), F.lit(1).alias("side"))),
    )
    pairs = rows.select("type", "name", "lower", F.inline(sides)).groupBy("type", "x", "y")
    return pairs.applyInArrow(_fitting(low, high), f"type {n.schema['type'].dataType.simpleString()}, a string, b string, score double")


def fuzzy_duplicates(names: DataFrame, low: float = 0.85, high: float = 0.98) -> DataFrame:
    """(type, a, b, score) of names of one type whose lower-cased forms have an indel ratio in [low, high).

    Of a shorter name of n characters at most k = 2 n (1 - low) / low may be lost or parted by insertions, so one of k + 1
    equal pieces of it is in the other unchanged; pairs meet on such pieces at every place they can shift to, so no
    name is compared with all others. Where names are so alike that they would meet more often than there are pairs, all
    pairs are compared, in blocks and many at once.
    """
    n = names.select("type", "name", F.lower("name").alias("lower")).distinct().withColumn("l", F.length("lower")).where("l > 0")
    edits = F.floor(2 * (1 - low) * F.col("l") / low + F.lit(1e-9)).cast("int")
    a = n.withColumn("k", F.least(edits + 1, F.col("l"))).withColumn("w", F.greatest(F.floor(F.col("l") / F.col("k")), F.lit(1)).cast("int"))
    cuts = a.select("type", F.col("name").alias("a"), "l", "w", F.explode(F.expr("transform(sequence(0, k - 1), i -> substring(lower, i * w + 1, w))")).alias("piece")).distinct()
    sizes = a.select("type", "w").distinct()
    b = n.select("type", F.col("name").alias("b"), F.col("lower").alias("bl"), F.col("l").alias("lb")).join(sizes, "type").where("w <= lb")
    grams = b.select("type", "b", "lb", "w", F.explode(F.expr("array_distinct(transform(sequence(1, lb - w + 1), i -> substring(bl, i, w)))")).alias("piece"))
    key = ["type", "w", "piece"]
    meet = cuts.groupBy(*key).agg(F.count("*").alias("x")).join(grams.groupBy(*key).agg(F.count("*").alias("y")), key).groupBy("type").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("meet"))
    # a pair that meets costs a row of an exchange, one of a block a few steps of an array
    alike = cut(meet.join(n.groupBy("type").agg(F.count("*").alias("n")), "type").where("meet * 10 > n * n").select("type"))
    fits = "l <= lb and l * %r >= lb and a <> b" % ((2 - low) / low)
    cuts = cuts.join(alike, "type", "left_anti")
    pairs = cuts.join(grams, key).where(fits).select("type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = pairs.withColumn("score", indel_ratio(F.lower("a"), F.lower("b"))).where((F.col("score") >= low) & (F.col("score") < high))
    return found.unionByName(_all_pairs(n.join(alike, "type", "left_semi").select("type", "name", "lower"), low, high))


def _summed(dim: int):
    """From the signed places (from 1) of a text's words to their sums, of length one; a text without words has nulls."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n = len(column)
            flat = np.asarray(column.flatten(), np.int64)
            row = np.repeat(np.arange(n), np.asarray(column.value_lengths().fill_null(0)))
            at = np.bincount(row * dim + np.abs(flat) - 1, np.sign(flat), n * dim).reshape(n, dim)
            norm = np.sqrt((at * at).sum(1, keepdims=True))
            unit = pa.array((at / np.where(norm == 0, 1, norm)).astype(np.float32).ravel(), mask=np.repeat(norm.ravel() == 0, dim))
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), unit, mask=column.is_null())

    return F.arrow_udf(run, "array<float>")


def embedding_text(label: Column, name: Column, description: Column) -> Column:
    return F.concat_ws(" ", label, name, F.coalesce(description, F.lit("")))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed word hashes, of length one."""
    place = F.transform(search_tokens(text), lambda w: (F.pmod(F.xxhash64(w), F.lit(dim)).cast("int") + 1) * F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1).otherwise(-1))
    return _summed(dim)(place)
