"""A stored inverted index: postings in blocks by term bucket, read with bucket pruning and upper bounds, plus new texts.

Below ``path``: ``postings`` (partitioned by bucket: term, segment, ids, tfs, lens of a block, its greatest tf and least
length; a segment is some texts, all of whose postings it holds),
``terms`` (partitioned by bucket: term, df, greatest tf, least length) and ``stats`` (documents, words). Bounds are kept as
tf and length, not as weights, so they stay right when new texts change the mean length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.functions.text import search_tokens
from trellisgraph.lineage import cut, stored
from trellisgraph.operators import local
from trellisgraph.operators.local import B, K1

#: Postings of a block.
BLOCK = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """A stored index; ``fresh`` holds blocks of texts that came after it was built."""

    spark: SparkSession
    path: str
    fresh: DataFrame | None = None
    fresh_docs: int = 0
    fresh_words: int = 0

    def __post_init__(self):
        self.buckets, self.docs, self.words, self.id_type = self.spark.read.parquet(f"{self.path}/stats").first()

    def table(self, name: str) -> DataFrame:
        """``postings`` or ``terms``; the schema is given, as an index of no words has no files."""
        lists = f", seg long, ids array<{self.id_type}>, tfs array<int>, lens array<int>" if name == "postings" else ", df long"
        return self.spark.read.schema(f"term string, max_tf int, min_len int{lists}, bucket int").parquet(f"{self.path}/{name}")

    def with_new(self, rows: DataFrame, id_col: str, text: Column) -> Index:
        """This index and rows that it does not hold yet; only they are read as texts."""
        fresh = stored(local.blocks(rows, id_col, text, BLOCK))
        n, words = _sums(rows, fresh)
        if self.fresh is not None:
            fresh, n, words = self.fresh.unionByName(fresh), n + self.fresh_docs, words + self.fresh_words
        return Index(self.spark, self.path, fresh, n, words)

    def merged(self, path: str) -> Index:
        """A new stored index of the old and the new blocks as they are; no text is read."""
        every = self.table("postings").drop("bucket")
        every = every if self.fresh is None else every.unionByName(self.fresh)
        return _written(self.spark, every, self.docs + self.fresh_docs, path, self.buckets, self.words + self.fresh_words)


def _sums(rows: DataFrame, blocks: DataFrame) -> tuple[int, int]:
    """How many texts and words there are; no text is read."""
    words = blocks.agg(F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0]
    return rows.count(), words


def _exploded(blocks: DataFrame, *more: str) -> DataFrame:
    return blocks.select("term", *more, F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")).select("term", *more, F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))


def build(rows: DataFrame, id_col: str, text: Column, path: str, buckets: int = 32, block: int = BLOCK) -> Index:
    """Writes the index of ``rows`` to a folder that driver and executors share. Every task writes the blocks of its own
    texts, so postings are neither exchanged nor sorted, and a word that is in a third of all texts is written by all."""
    return _written(rows.sparkSession, local.blocks(rows, id_col, text, block), rows.count(), path, buckets)


def _written(spark: SparkSession, blocks: DataFrame, docs: int, path: str, buckets: int, words: int | None = None) -> Index:
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    blocks.withColumn("bucket", _bucket(buckets)).write.partitionBy("bucket").parquet(f"{path}/postings")
    stats = lambda words, mode: spark.createDataFrame([(buckets, docs, words, kind)], "buckets int, docs long, words long, id_type string").coalesce(1).write.mode(mode).parquet(f"{path}/stats")
    stats(words or 0, "error")
    index = Index(spark, path)
    if words is None:
        stats(index.table("postings").agg(F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0], "overwrite")
        index = Index(spark, path)
    terms = index.table("postings").groupBy("bucket", "term").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"), F.sum(F.size("ids")).alias("df"))
    terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")
    return index


def search(index: Index, queries: DataFrame, limit: int | None = 10, local_words: int = local.LOCAL_WORDS) -> DataFrame:
    """(query_id, id, score[, rank]) of queries (query_id, query): BM25 as ``search.bm25`` gives it, ties by id.

    No text is read; of the stored postings only the buckets of the queries' words. Queries of up to ``local_words`` words in
    all go to every task, and each segment scores its own texts; only the best are exchanged. More words meet postings by
    joins: with a limit k, each word's k best
    postings give every query a score that its k-th best must reach. Words that together cannot reach it bring in no
    document, and blocks are passed over whose bound with all other words stays below it. What is left is scored in full.
    """
    n_docs = index.docs + index.fresh_docs
    mean = (index.words + index.fresh_words) / n_docs if n_docs else 1.0
    weight = lambda tf, length: F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.lit(mean)))
    words = cut(queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("query")))).alias("term")).withColumn("bucket", _bucket(index.buckets)))
    wanted = words.select("term", "bucket").distinct()
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most index.buckets numbers
    pruned = lambda table: index.table(table).where(F.col("bucket").isin(buckets))
    terms = pruned("terms").select("term", "df", "max_tf", "min_len")
    if index.fresh is not None:
        own = index.fresh.join(wanted.select("term"), "term", "left_semi").groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len")).select("term", "df", "max_tf", "min_len")
        terms = terms.unionByName(own).groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = cut(words.join(terms, "term").select("query_id", "term", idf.alias("idf"), (idf * weight("max_tf", "min_len")).alias("bound")))
    known = words.select("term", "idf").distinct()
    blocks = pruned("postings").drop("bucket")
    blocks = blocks if index.fresh is None else blocks.unionByName(index.fresh)
    blocks = blocks.join(known.select("term"), "term", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    if words.count() <= local_words:
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.id_type}, score double"
        found = local.of_segments(blocks, words.select("query_id", "term", "idf").toArrow(), mean, schema, limit)
        return found if limit is None else found.withColumn("rank", rank).where(F.col("rank") <= limit)
    lists = _exploded(blocks)
    part = (F.col("idf") * weight("tf", "len")).alias("part")
    total = lambda rows: rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    if limit is None:
        return total(lists.join(words, "term").select("query_id", "id", part))
    best = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part"), "id"))
    heads = cut(lists.join(known, "term").select("term", "id", part).withColumn("r", best).where(F.col("r") <= limit).drop("r"))
    near = cut(total(heads.join(words.select("query_id", "term"), "term")))
    least = near.withColumn("rank", rank).where(F.col("rank") <= limit).groupBy("query_id").agg(F.when(F.count("*") == limit, F.min("score")).alias("least"))
    # the least reached score, shrunk a little: partial sums may round otherwise than full ones
    least = least.select("query_id", (F.coalesce("least", F.lit(0.0)) * (1 - 1e-9)).alias("least"))
    tail = Window.partitionBy("query_id").orderBy("bound", "term")  # as many rows as a query has words
    graded = words.join(least, "query_id").withColumn("tail", F.sum("bound").over(tail)).withColumn("at", F.row_number().over(tail)).withColumn("all", F.sum("bound").over(Window.partitionBy("query_id")))
    # a single word's k best are in ``near`` already, so at an equal score it may be left out too
    idle = (F.col("tail") < F.col("least")) | (F.col("at") == 1) & (F.col("tail") * (1 - 1e-9) <= F.col("least"))
    needed = cut(graded.where(~idle).select("query_id", "term", (F.col("least") - (F.col("all") - F.col("bound"))).alias("need"), "idf"))
    strong = blocks.join(needed, "term").where(F.col("idf") * weight("max_tf", "min_len") >= F.col("need")).select("query_id", F.explode("ids").alias("id"))
    chosen = strong.unionByName(near.select("query_id", "id")).distinct()
    full = total(chosen.join(words, "query_id").join(lists, ["term", "id"]).select("query_id", "id", part))
    return full.withColumn("rank", rank).where(F.col("rank") <= limit)
