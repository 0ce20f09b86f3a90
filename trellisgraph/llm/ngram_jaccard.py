"""Exact Jaccard join of documents on word shingles, by set-relation skipping.

A document's set holds its distinct shingles of ``words`` words (64-bit hashes). Two sets link when
``100 * intersection >= percent * union``. Steps:

1. Equal sets become one class with one representative; only representatives go on.
2. Cheap necessary test. Of a set of n shingles at least ``ceil(percent * n / 100)`` are in a linked set, so of its
   p smallest hashes at most ``n - ceil(...)`` are in no other set. Only such sets survive.
3. The survivors' shingles are ordered by document frequency, rare first; a linked pair shares one of the first
   ``n - ceil(...) + 1`` (prefix filter). Index lists hold (set, size, position) per shingle, cut into blocks by size
   band and position; a block is skipped as a whole when its smallest position or its sizes cannot give the overlap.
4. First every set is compared with two leaders of each of its lists and size bands. Verified pairs make families. A set
   then takes over the answers of its family: lists are probed only across families, and only for links that a member
   adds to what the family has, so no pairs are made inside a family, however large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm import common
from trellisgraph.llm.common import lean, mixed, saved, sliced, small
from trellisgraph.llm.links import components

#: Shingles whose sampled hashes one bucket holds, in mean.
SHINGLES = 1 << 22

_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) | 1 for k in range(1, 65)], dtype=object)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes: ``width`` words, or the whole of a shorter text."""
    data, offsets = common.buffers(column)
    doc, _, _, h = common.words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    sums = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        sums += h[k : len(h) - width + 1 + k] * np.uint64(int(_ODD[k]) & (2**64 - 1))
    sums = mixed(sums)
    out = []
    for i in range(n):
        if count[i] >= width:
            out.append(np.unique(sums[first[i] : first[i + 1] - width + 1]))
        elif count[i]:
            odd = np.array([int(x) & (2**64 - 1) for x in _ODD[: count[i]]], np.uint64)
            out.append(mixed(np.array([(h[first[i] : first[i + 1]] * odd).sum(dtype=np.uint64) + np.uint64(count[i])], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n, percent: int):
    """The least number of a set's n members that a linked set shares."""
    return (percent * n + 99) // 100


def _prints(s: np.ndarray) -> tuple[int, int]:
    one = mixed(s ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64)
    two = mixed(s ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _fingerprints(width: int):
    def run(batches):
        for whole in batches:
            for batch in sliced([whole]):
                sets = shingle_sets(batch.column(1), width)
                both = [_prints(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())], ["doc_id", "text_hash", "n_shingles", "f1", "f2"])

    return run


def _samples(width: int, percent: int, buckets: int):
    """Smallest hashes of each set, dealt by hash range; what one slice alone shows to be shared is counted at once."""

    def run(batches):
        edges = (np.arange(1, buckets, dtype=object) * 2**64 // buckets).astype(np.uint64)
        for batch in sliced(batches):
            taken = {}
            for s in shingle_sets(batch.column(0), width):
                if len(s):
                    taken[_prints(s)[0]] = s[: len(s) - needed(len(s), percent) + max(1, len(s) // 8)]
            if not taken:
                continue
            tokens = mixed(np.concatenate(list(taken.values())))  # the least hashes, mixed again, spread over all buckets
            prints = np.repeat(np.fromiter(taken, np.int64, len(taken)), [len(s) for s in taken.values()])
            order = np.argsort(tokens, kind="stable")
            tokens, prints = tokens[order], prints[order]
            head = np.ones(len(tokens), bool)
            head[1:] = tokens[1:] != tokens[:-1]
            run_of = np.cumsum(head) - 1
            many = np.bincount(run_of)[run_of] > 1
            local, n_local = np.unique(prints[many], return_counts=True)
            own = -1 - int(np.bitwise_xor.reduce(prints).view(np.uint64) % np.uint64(buckets))
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([local.tobytes()], pa.binary()), pa.array([n_local.astype(np.int64).tobytes()], pa.binary())], ["bucket", "x", "y"])
            prints = np.where(many, np.int64(0), prints)[head]
            tokens = tokens[head]
            at = [0, *np.searchsorted(tokens, edges).tolist(), len(tokens)]
            rows = [(k, tokens[a:b].tobytes(), prints[a:b].tobytes()) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "x", "y"])

    return run


def _shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one hash range: for each set the number of its hashes that another set has. Below zero: what slices counted."""
    if key[0].as_py() < 0:
        prints = np.frombuffer(b"".join(table.column("x").to_pylist()), np.int64)
        counts = np.frombuffer(b"".join(table.column("y").to_pylist()), np.int64)
        hit, at = np.unique(prints, return_inverse=True)
        return pa.table({"f1": pa.array(hit, pa.int64()), "n": pa.array(np.bincount(at, weights=counts, minlength=len(hit)).astype(np.int64), pa.int64())})
    tokens = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint64)
    prints = np.frombuffer(b"".join(table.column("y").to_pylist()), np.int64)
    order = np.lexsort((prints, tokens))
    tokens, prints = tokens[order], prints[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (prints[1:] != prints[:-1])
    # a zero stands for several sets of a slice: alone it already counts as shared
    tokens, prints = tokens[new], prints[new]
    head = np.ones(len(tokens), bool)
    head[1:] = tokens[1:] != tokens[:-1]
    run_of = np.cumsum(head) - 1
    weight = np.bincount(run_of)
    hit, n = np.unique(prints[(weight[run_of] > 1) & (prints != 0)], return_counts=True)
    return pa.table({"f1": pa.array(hit, pa.int64()), "n": pa.array(n, pa.int64())})


def _members(width: int, most: int = 1 << 17):
    """(class, shingle) of every text, a bounded number at once."""

    def run(batches):
        for batch in sliced(batches):
            sets = [s for s in shingle_sets(batch.column(0), width) if len(s)]
            ids = np.repeat(np.array([_prints(s)[0] for s in sets], np.int64), [len(s) for s in sets])
            every = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            del sets
            for a in range(0, len(ids), most):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + most]), pa.array(every[a : a + most])], ["id", "token"])

    return run


def _verify(percent: int):
    """Pairs whose shared members meet the threshold."""

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            keep = []
            for i, (x, y) in enumerate(zip(cols["x"], cols["y"])):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                total = cols["na"][i] + cols["nb"][i]
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (total - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([cols["a"][i] for i in keep], pa.int64()), pa.array([cols["b"][i] for i in keep], pa.int64())], ["a", "b"])

    return run


def _packed(batches):
    for batch in batches:
        lists = batch.column(2)
        values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
        offsets = np.asarray(lists.offsets.to_numpy(), np.int64)
        offsets = offsets - offsets[0]
        raw = [np.sort(values[a:b]).tobytes() for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["id", "n", "members"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("members").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("members").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_verify(percent), "a long, b long")


def jaccard_links(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows has doc_id, text_hash, n_shingles, class (a print of the set; null for an empty one) and rep (the least
    doc_id with an equal set); links has verified pairs of classes that connect every group of linked sets.

    Nulls: a null text is empty; rows with a null id are left out. Rows that repeat an id stand each for their own set. An
    empty table gives empty results; other columns are not read. Links inside a family that its leader already connects
    are not listed. Hashes have 64 bits: two different shingles of a compared pair, or two sets, are taken for equal with
    a probability of about n * m / 2**64.
    """
    spark = docs.sparkSession
    lean(spark)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = base.withColumn("text_hash", F.xxhash64("text"))
    prints = saved(hashed.mapInArrow(_fingerprints(width), "doc_id long, text_hash long, n_shingles long, f1 long, f2 long"))
    reps = prints.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = prints.join(reps, ["f1", "f2", "n_shingles"], "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("rep").isNotNull(), F.col("f1")).alias("class"), "rep")

    # a bucket holds the sampled hashes of a bounded number of shingles
    total = prints.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(16, int(total) // SHINGLES)
    dealt = base.select("text").mapInArrow(_samples(width, percent, buckets), "bucket int, x binary, y binary")
    counts = dealt.groupBy("bucket").applyInArrow(_shared, "f1 long, n long").groupBy("f1").agg(F.sum("n").alias("hits"))
    alive = saved(reps.join(counts, "f1").where(F.col("hits") >= F.greatest(F.lit(1), F.expr("n_shingles div 8"))).select(F.col("f1").alias("id"), F.col("n_shingles").alias("n"), F.col("rep").alias("doc_id")))

    # rows that repeat an id may bring a set twice, or one that is not alive
    repeats = prints.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    tokens = base.join(small(alive.select("doc_id"), 16), "doc_id", "left_semi").select("text").mapInArrow(_members(width), "id long, token long")
    if repeats:
        tokens = tokens.distinct().join(alive.select("id"), "id", "left_semi")
    tokens = saved(tokens)
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    grouped = tokens.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    rich = saved(grouped.join(alive.toDF("id", "n", "rep"), "id").where(F.expr(f"size(t) >= ({percent} * n + 99) div 100")).select("id", "n", "rep", F.transform("t", lambda x: x["token"]).alias("tokens")))
    sets = rich.select("id", "n", "tokens").mapInArrow(_packed, "id long, n long, members binary")

    # Index lists over the prefix: positions count the rare members that no other set has.
    unshared = F.expr("n - size(tokens)")
    length = F.expr(f"n - ({percent} * n + 99) div 100 + 1") - unshared
    index = rich.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")).select("id", "n", "rep", "band", (F.size("tokens") / F.col("n")).alias("core"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("pos", "token"), unshared.alias("skip"))
    index = saved(index.select("token", "band", "id", "n", "rep", "core", (F.col("pos") + F.col("skip")).alias("pos")))

    # two leaders of a list: the first of all, and the one that shares the largest part of itself with others
    leaders = index.groupBy("token", "band").agg(F.array(F.min(F.struct("rep", "id"))["id"], F.max(F.struct("core", -F.col("rep"), "id"))["id"]).alias("leaders"))
    stars = index.join(leaders, ["token", "band"]).select(F.explode(F.array_distinct("leaders")).alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    star_links = saved(verified(stars, sets, percent))
    family = saved(components(star_links).toDF("id", "family"))

    # Lists that reach more than one family, as blocks of one family, size band and position band.
    entries = index.join(family, "id", "left").withColumn("family", F.coalesce("family", "id"))
    cells = entries.groupBy("token", "band", "family").agg(F.expr("1 + count(*) div 256").alias("cells"))
    entries = entries.join(cells, ["token", "band", "family"]).withColumn("cell", F.expr("pmod(xxhash64(id), cells)"))
    blocks = entries.groupBy("token", "band", "family", "cell").agg(F.collect_list(F.struct("id", "n", "pos")).alias("of"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.expr("n - pos")).alias("rest"))
    several = blocks.groupBy("token").agg(F.count_distinct("family").alias("families")).where("families > 1").select("token")
    blocks = blocks.join(several, "token", "left_semi")
    left = blocks.select("token", *[F.col(c).alias(f"l_{c}") for c in ("band", "family", "of", "least", "most", "rest")])
    # positional skipping of whole blocks: the overlap is at most 1 + what follows the shared member in either set
    both = left.join(blocks, "token").where("l_family < family and abs(l_band - band) <= 2").where(f"100 * l_most >= {percent} * least and 100 * most >= {percent} * l_least").where(f"(100 + {percent}) * least(l_rest, rest) >= {percent} * (l_least + least)")
    one = both.select(F.explode("l_of").alias("p"), "of").select("p", F.explode("of").alias("q"))
    fits = f"100 * p.n >= {percent} * q.n and 100 * q.n >= {percent} * p.n and (100 + {percent}) * least(p.n - p.pos, q.n - q.pos) >= {percent} * (p.n + q.n)"
    cross = one.where(fits).select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
    links = star_links.union(verified(cross, sets, percent))
    return classes, saved(links)


def jaccard_join(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), text_hash for every row."""
    classes, links = jaccard_links(docs, percent, width, id_col, text_col)
    of = saved(components(links))
    least = of.join(classes.select(F.col("class").alias("node"), "rep").distinct(), "node").groupBy("component").agg(F.min("rep").alias("least"))
    out = classes.join(of.join(least, "component").select("node", "least"), F.col("class") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "rep", "doc_id").alias("component_id"), "text_hash")
