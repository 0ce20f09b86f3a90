"""Words counted and texts scored where they lie: a text's words are in one row, so neither needs an exchange of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

K1, B = 1.2, 0.75
#: Words of all queries up to which they go to every task.
LOCAL_WORDS = 1 << 14
#: Rows counted at once, and postings that one segment of an index holds.
ROWS, POSTINGS = 2000, 1 << 21


def repeated(rows: DataFrame, id_col: str) -> bool:
    """Whether an id has several rows, whose words count together."""
    return not rows.groupBy(id_col).count().where("count > 1").isEmpty()


def counted(low: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, tf, length of each row, terms) of lower-cased texts, tokens as in ``search_tokens``; by row, then code."""
    low = pc.fill_null(low, "")
    if pc.any(pc.match_substring_regex(low, "[一-鿿]")).as_py():
        low = pc.replace_substring_regex(low, "([一-鿿])", r" \1 ")
    lists = pc.split_pattern(pc.replace_substring_regex(low, "[^a-z0-9一-鿿]+", " "), " ")
    flat, row = lists.flatten(), np.asarray(pc.list_parent_indices(lists), np.int64)
    real = pc.not_equal(flat, "")
    coded, row = flat.filter(real).dictionary_encode(), row[np.asarray(real)]
    size = max(1, len(coded.dictionary))
    key, tf = np.unique(row * size + np.asarray(coded.indices, np.int64), return_counts=True)
    return key // size, key % size, tf.astype(np.int32), np.bincount(row, minlength=len(low)).astype(np.int32), coded.dictionary


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, row, code, tf, length of each posting, terms) of (id, low), some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            row, code, tf, lens, terms = counted(part.column("low"))
            yield part.column("id"), row, code, tf, lens[row], terms


def lowered(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))


def _segment(held: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``block`` postings of one term, of all pieces together."""
    terms = pa.concat_arrays([x[5] for x in held]).dictionary_encode()
    first = np.cumsum([0] + [len(x[5]) for x in held])
    new = np.asarray(terms.indices, np.int64)
    code = np.concatenate([new[x[2] + n] for x, n in zip(held, first)])
    if not len(code):
        return
    row = np.concatenate([x[1] + n for x, n in zip(held, np.cumsum([0] + [len(x[0]) for x in held]))])
    order = np.argsort(code, kind="stable")
    code, n = code[order], len(order)
    tf, length = (np.concatenate([x[k] for x in held])[order] for k in (3, 4))
    since = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, code[1:] != code[:-1]), np.arange(n), 0))
    cuts = np.flatnonzero(since % block == 0)
    offsets = pa.array(np.append(cuts, n), pa.int32())
    ids = pa.concat_arrays([x[0] for x in held]).take(pa.array(row[order]))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids, pa.array(tf, pa.int32()), pa.array(length, pa.int32()))]
    most, least = (pa.array(f.reduceat(x, cuts), pa.int32()) for f, x in ((np.maximum, tf), (np.minimum, length)))
    seg = pa.array(np.full(len(cuts), uuid.uuid4().int >> 65, np.int64))
    out = pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[cuts])), seg, most, least, *lists], ["term", "seg", "max_tf", "min_len", "ids", "tfs", "lens"])
    for at in range(0, out.num_rows, 4096):
        yield out.slice(at, 4096)


def blocks(rows: DataFrame, id_col: str, text: Column, block: int) -> DataFrame:
    """(term, seg, max_tf, min_len, ids, tfs, lens) of all words. A segment holds all postings of its texts."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for piece in _pieces(batches):
            held.append(piece)
            n += len(piece[1])
            if n >= POSTINGS:
                yield from _segment(held, block)
                held, n = [], 0
        if held:
            yield from _segment(held, block)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            coded = b.column("term").dictionary_encode()
            held.append((b.column("id"), np.arange(b.num_rows), np.asarray(coded.indices, np.int64), np.asarray(b.column("tf"), np.int32), np.asarray(b.column("len"), np.int32), coded.dictionary))
        if held:
            yield from _segment(held, block)

    schema = f"term string, seg long, max_tf int, min_len int, ids array<{kind}>, tfs array<int>, lens array<int>"
    if not repeated(rows, id_col):
        return lowered(rows, id_col, text).mapInArrow(run, schema)
    from trellisgraph.operators.search import inverted_index

    # the words of an id's rows meet, and all postings of an id are in one segment
    return inverted_index(rows, id_col, text)[0].select("id", "term", F.col("tf").cast("int").alias("tf"), "len").repartition("id").mapInArrow(whole, schema)


class Asked:
    """The words of some queries, as one object that goes to every task: (query_id, term, idf)."""

    def __init__(self, words: pa.Table, mean: float):
        words = words.combine_chunks()
        coded = words.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.ids, who = coded.dictionary, np.asarray(coded.indices)
        terms = words.column("term").combine_chunks().dictionary_encode()
        self.terms, which = terms.dictionary, np.asarray(terms.indices)
        idf = np.asarray(words.column("idf"), np.float64)
        self.words = [(which[who == q], idf[who == q]) for q in range(len(self.ids))]
        self.mean = mean

    def best(self, ids: pa.Array, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, limit: int | None) -> Iterator[pa.RecordBatch]:
        """(query_id, id, score) for postings of whole texts: document number, number of the term in ``terms``, tf, length."""
        order = np.argsort(term, kind="stable")
        doc, term = doc[order], term[order]
        part = tf[order] * (K1 + 1) / (tf[order] + K1 * (1 - B + B * length[order] / self.mean))
        edge = np.searchsorted(term, np.arange(len(self.terms) + 1))
        for q, (which, idf) in enumerate(self.words):
            spans = [(slice(edge[t], edge[t + 1]), x) for t, x in zip(which, idf) if edge[t] < edge[t + 1]]
            if not spans:
                continue
            score = np.bincount(np.concatenate([doc[s] for s, _ in spans]), np.concatenate([part[s] * x for s, x in spans]), len(ids))
            hits = np.flatnonzero(score)
            if limit is not None and len(hits) > limit:
                least = np.partition(score[hits], -limit)[-limit]
                hits = hits[score[hits] >= least]
                own = pa.table({"score": score[hits], "id": ids.take(pa.array(hits))})
                hits = hits[np.asarray(pc.sort_indices(own, [("score", "descending"), ("id", "ascending")], null_placement="at_start"))[:limit]]
            n = len(hits)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(np.full(n, q))), ids.take(pa.array(hits)), pa.array(score[hits])], ["query_id", "id", "score"])


def bm25(rows: DataFrame, id_col: str, text: Column, words: pa.Table, schema: str, limit: int | None) -> DataFrame:
    """(query_id, id, score) of ``words`` (query_id, term) by BM25; with a limit the best of each query of every piece.

    The texts are read twice: once for how many have each word, once for the scores of each text where it lies.
    """
    sc, low = rows.sparkSession.sparkContext, lowered(rows, id_col, text)
    wanted = sc.broadcast(words.column("term").combine_chunks().unique())

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        df = np.zeros(len(wanted.value), np.int64)
        for ids, row, code, tf, length, terms in _pieces(batches):
            docs, total = docs + len(ids), total + int(tf.sum())
            at = pc.index_in(wanted.value, terms)
            has = np.asarray(at.is_valid())
            df[has] += np.bincount(code, minlength=max(1, len(terms)))[np.asarray(at.filter(at.is_valid()))] if len(terms) else 0
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([wanted.value, pa.array([None, None], pa.string())]), pa.array([*range(len(df)), -1, -2], pa.int32()), pa.array([*df, docs, total], pa.int64())], ["term", "at", "n"])

    sums = {x["at"]: (x["term"], x["n"]) for x in low.mapInArrow(frequency, "term string, at int, n long").groupBy("at").agg(F.first("term").alias("term"), F.sum("n").alias("n")).collect()}  # a row a wanted word
    docs, total = (sums.get(k, (None, 0))[1] for k in (-1, -2))
    idf = {term: np.log(1 + (docs - n + 0.5) / (n + 0.5)) for term, n in sums.values() if term is not None}
    asked = sc.broadcast(Asked(words.append_column("idf", pa.array([float(idf.get(t, 0.0)) for t in words.column("term").to_pylist()], pa.float64())), total / docs if total else 1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, code, tf, length, terms in _pieces(batches):
            at = np.asarray(pc.fill_null(pc.index_in(terms, asked.value.terms), -1))[code] if len(terms) else np.empty(0, np.int64)
            has = at >= 0
            yield from asked.value.best(ids, row[has], at[has], tf[has], length[has], limit)

    return low.mapInArrow(score, schema)


def of_segments(table: DataFrame, words: pa.Table, mean: float, schema: str, limit: int | None) -> DataFrame:
    """(query_id, id, score) of ``words`` (query_id, term, idf) from blocks, a segment at a time; with a limit the best of each."""
    asked = table.sparkSession.sparkContext.broadcast(Asked(words, mean))
    kinds = [words.schema.field("query_id").type, to_arrow_type(table.schema["ids"].dataType.elementType), pa.float64()]
    named = pa.schema(list(zip(["query_id", "id", "score"], kinds)))

    def run(own: pa.Table) -> pa.Table:
        ids, tfs, lens, term = (own.column(c).combine_chunks() for c in ("ids", "tfs", "lens", "term"))
        docs = ids.flatten().dictionary_encode(null_encoding="encode")
        at = np.asarray(pc.index_in(term, asked.value.terms))[np.asarray(pc.list_parent_indices(ids))]
        out = list(asked.value.best(docs.dictionary, np.asarray(docs.indices), at, np.asarray(tfs.flatten()), np.asarray(lens.flatten()), limit))
        return pa.Table.from_batches(out) if out else named.empty_table()

    return table.groupBy("seg").applyInArrow(run, schema)
