"""A prefix trie of conversations, built by distributed MSD radix partitioning.

Turns become codes of a dictionary of (role, text). Equal sequences are counted once. A bucket holds the sequences
below one node; the root's is always dealt by its sequences' next code, and so is, round by round, every bucket of more
than ``local_turns`` codes, after a jump over the codes that all of it share. Smaller buckets meet in a task each, many
a task, where multikey quicksort orders them and emits their nodes. A node is known by its smallest member and its depth.

A conversation is a row: its codes (12 bytes a turn, no texts) must fit in a task. Numbers of members are never bounded:
their ids are hashed from sorted streams.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm.common import saved, small, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encoded(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, code, words: ``code`` numbers the distinct (role, text), null ones being empty.

    Codes are 64-bit hashes under the first seed that gives different pairs different codes, which is counted."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    for seed in range(8):
        out = rows.withColumn("code", F.xxhash64(F.lit(seed), "role", "text"))
        exact = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        if out.groupBy("code").agg(F.min(exact).alias("a"), F.max(exact).alias("b")).where("a <> b").isEmpty():
            return out.withColumn("words", F.regexp_count("text", F.lit(WORD)))
    raise ValueError("no seed tells the turns apart")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and seq, its turns' codes and words by turn (null first), then role, then code."""
    one = F.struct("turn", "role", "code", F.col("words").cast("int").alias("words"))
    rows = encoded(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["code"].alias("code"), x["words"].alias("words"))).alias("seq"))


def shared_starts(convs: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % ``group``, h = crc32(c) % (``most`` + 1).

    A base is joined by fewer than ``group`` others, so no key is hot."""
    c = F.col("conv_id")
    heads = convs.where(c % group == 0).select(c.alias("_base"), F.slice("seq", 1, most).alias("_head"))
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = convs.join(heads, c - c % group == F.col("_base"), "left")
    none = F.slice("seq", 1, 0)
    head = F.slice(F.coalesce("_head", none), F.lit(1), h)
    return rows.select("conv_id", F.concat(head, F.slice("seq", h + 1, F.size("seq"))).alias("seq"))


def _chunks(batches):
    """Sorted (k1, k2, conv_id) rows: the ids of each key in a batch as one text."""
    for batch in batches:
        k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
        if len(ids):
            cut = [0, *(np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1).tolist(), len(ids)]
            text, at = ids.astype(str).tolist(), np.array(cut[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(ids[at]), pa.array([",".join(text[a:b]) for a, b in zip(cut, cut[1:])])], ["k1", "k2", "first", "ids"])


def _digests(batches):
    """The hash of each key's chunks, comma-joined in order; a key may run over many batches."""
    key = first = h = None
    for batch in batches:
        out = []
        for k1, k2, f, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (k1, k2) != key:
                if h:
                    out.append((first, h.hexdigest()))
                key, first, h = (k1, k2), f, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], ["rep", "ends"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([h.hexdigest()])], ["rep", "ends"])


def ends(convs: DataFrame) -> DataFrame:
    """rep, ends: for each distinct sequence its smallest conv_id and the SHA-256 of all its conv_ids, ascending.

    Ids are sorted over ranges that split a hot sequence and joined into texts there; a last task hashes a sequence's
    texts as they stream by."""
    keys = convs.select(F.xxhash64("seq").alias("k1"), F.xxhash64(F.lit(1), "seq").alias("k2"), "conv_id")
    dealt = keys.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    chunks = dealt.mapInArrow(_chunks, "k1 long, k2 long, first long, ids string")
    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "rep long, ends string")


def finished(table: pa.Table) -> pa.RecordBatch:
    """All nodes of whole buckets: multikey quicksort of the sequences below each, emitting a node at every equal part."""
    seq = table.column("seq").combine_chunks()
    offsets, flat = seq.offsets.to_numpy().astype(np.int64), seq.values
    codes, words = flat.field("code").to_numpy(), flat.field("words").to_numpy()
    base, n, rep = (table.column(c).to_numpy() for c in ("d", "n", "rep"))
    last, bucket_conv = table.column("ends").to_pylist(), table.column("node_conv").to_numpy()
    start, stop = offsets[:-1] + base, offsets[1:]
    key = np.stack([bucket_conv, base, codes[start]])
    cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(start)]
    conv, depth, up, up_conv, count, weight, end = [], [], [], [], [], [], []
    todo = [(np.arange(a, b), 0, -1) for a, b in zip(cut, cut[1:])]
    while todo:
        rows, k, parent = todo.pop()
        if len(rows) == 1:
            r = int(rows[0])
            a, b, c, m, d = int(start[r]) + k, int(stop[r]), int(rep[r]), int(n[r]), int(base[r]) + k
            own = len(conv)
            conv += [c] * (b - a)
            depth += range(d + 1, d + 1 + b - a)
            up += [parent, *range(own, own + b - a - 1)]
            up_conv += [conv[parent] if parent >= 0 else int(bucket_conv[r]), *[c] * (b - a - 1)]
            count += [m] * (b - a)
            weight += words[a:b].tolist()
            end += [EMPTY] * (b - a - 1) + [last[r]]
            continue
        here = codes[start[rows] + k]
        pivot = here[len(here) // 2]
        less, equal, more = (rows[x] for x in (here < pivot, here == pivot, here > pivot))
        todo += [(x, k, parent) for x in (less, more) if len(x)]
        r, node = int(equal[0]), len(conv)
        conv.append(int(rep[equal].min()))
        depth.append(int(base[r]) + k + 1)
        up.append(parent)
        up_conv.append(conv[parent] if parent >= 0 else int(bucket_conv[r]))
        count.append(int(n[equal].sum()))
        weight.append(int(words[start[r] + k]))
        over = start[equal] + k + 1 == stop[equal]
        end.append(last[int(equal[over][0])] if over.any() else EMPTY)
        if not over.all():
            todo.append((equal[~over], k + 1, node))
    kids, leaves, saving = [0] * len(conv), [0] * len(conv), [(m - 1) * w for m, w in zip(count, weight)]
    for i in range(len(conv) - 1, -1, -1):  # a node comes after its parent
        leaves[i] = leaves[i] or 1
        p = up[i]
        if p >= 0:
            kids[p] += 1
            leaves[p] += leaves[i]
            saving[p] += saving[i]
    longs = [pa.array(x, pa.int64()) for x in (conv, depth, up_conv, count, kids, leaves, saving)]
    return pa.RecordBatch.from_arrays([*longs, pa.array(end, pa.string()), pa.array([p < 0 for p in up], pa.bool_())], ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top"])


def _finish(enough: int):
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held)
            key = [table.column(c).to_numpy() for c in ("node_conv", "d", "code")]
            same = np.logical_and.reduce([x == x[-1] for x in key])
            cut = int(np.argmax(same))  # the last bucket may go on
            if cut:
                yield finished(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        if rows:
            yield finished(pa.Table.from_batches(held))

    return run


def _shared(lo: Column, hi: Column) -> Column:
    """How many first items two arrays share."""
    first = F.array_position(F.zip_with(lo, hi, lambda a, b: a["code"].eqNullSafe(b["code"])), False)
    return F.when(first == 0, F.size(lo)).otherwise(first - 1).cast("long")


def trie(convs: DataFrame, local_turns: int = 500_000) -> DataFrame:
    """One row for every node of the trie of ``convs`` (conv_id, seq), the root included: see ``NODE``.

    A bucket of two or more different sequences and over ``local_turns`` codes below its node is dealt again, others end
    in a task; memory of a task follows from that number and from the longest conversation. Rounds follow from branchings
    inside large buckets; what they broadcast is their list of large buckets, if its counted size allows. Without
    conversations there are no nodes."""
    spark = convs.sparkSession
    convs = saved(convs)
    groups = convs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"))
    live = saved(groups.join(ends(convs), "rep").select("seq", "n", "rep", "ends"))
    root, members = live.agg(F.min("rep"), F.sum("n")).first()
    if root is None:
        return spark.createDataFrame([], NODE)
    buckets = [spark.createDataFrame([(root, 0, 0, None, members, [], [(root, 0)])], "conv long, depth long, first long, parent long, n_convs long, chain array<int>, up array<struct<conv:long,depth:long>>")]
    live = live.select(F.lit(root).alias("node_conv"), F.lit(0).cast("long").alias("d"), "*")
    key, local, over = ["node_conv", "d", "code"], [], []
    while True:
        over.append(live.where(F.size("seq") == F.col("d")).select("node_conv", "d", "ends"))
        live = live.where(F.size("seq") > F.col("d")).withColumn("code", F.get("seq", F.col("d").cast("int"))["code"])
        left = (F.size("seq") - F.col("d")).cast("long")
        large = live.groupBy(*key).agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv"), F.sum(left).alias("turns"), F.count("*").alias("seqs")).where((F.col("turns") > local_turns) & (F.col("seqs") > 1)).drop("turns", "seqs")
        large = saved(large)
        if large.isEmpty():
            local.append(live)
            break
        span = live.join(small(large, 100), key).groupBy(*key, "n_convs", "conv").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        span = saved(span.select(*key, "n_convs", "conv", _shared(F.col("lo"), F.col("hi")).alias("depth"), "lo"))
        parent = buckets[-1].select(F.col("conv").alias("node_conv"), F.col("depth").alias("d"), F.col("up").alias("_up"))
        made = span.join(parent, ["node_conv", "d"]).select(
            "conv", "depth", (F.col("d") + 1).alias("first"), F.col("node_conv").alias("parent"), "n_convs",
            F.slice(F.transform("lo", lambda x: x["words"]), (F.col("d") + 1).cast("int"), (F.col("depth") - F.col("d")).cast("int")).alias("chain"),
            F.concat("_up", F.array(F.struct("conv", "depth"))).alias("up"),
        )
        buckets.append(saved(made))
        to = small(span.select(*key, "conv", F.col("depth").alias("to")), 100)
        local.append(live.join(to, key, "left_anti"))
        live = saved(live.join(to, key).select(F.col("conv").alias("node_conv"), F.col("to").alias("d"), "seq", "n", "rep", "ends"))
    wanted = ["node_conv", "d", "code", "seq", "n", "rep", "ends"]
    rest = local[0].select(*wanted)
    for x in local[1:]:
        rest = rest.unionByName(x.select(*wanted))
    rest = saved(rest.repartition(*key).sortWithinPartitions(*key).mapInArrow(_finish(1000), NODE + ", top boolean"))
    below = rest.where("top").groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saving"))
    top, done = buckets[0], over[0]
    for x, y in zip(buckets[1:], over[1:]):
        top, done = top.unionByName(x), done.unionByName(y)
    return rest.drop("top").unionByName(_large(top, below, done))


def _large(buckets: DataFrame, below: DataFrame, over: DataFrame) -> DataFrame:
    """The nodes of large buckets: ``below`` has what the nodes right below each sum to, ``over`` the ends at each."""
    zero, at = F.lit(0).cast("long"), ["conv", "depth"]
    own = buckets.join(below, at, "left").withColumns({c: F.coalesce(c, zero) for c in ("kids", "leaves", "saving")})
    own = own.withColumn("along", (F.col("n_convs") - 1) * F.aggregate("chain", zero, lambda a, x: a + x))
    up = own.select(F.explode("up").alias("a"), (F.col("a.conv") == F.col("conv")) & (F.col("a.depth") == F.col("depth")), "leaves", "saving", "along").toDF("a", "self", "leaves", "saving", "along")
    total = up.groupBy(F.col("a.conv").alias("conv"), F.col("a.depth").alias("depth")).agg(F.sum("leaves").alias("all_leaves"), F.sum(F.col("saving") + F.when(F.col("self"), 0).otherwise(F.col("along"))).alias("under"))
    kids = buckets.where("parent is not null").select(F.get("up", F.size("up") - 2).alias("p")).groupBy(F.col("p.conv").alias("conv"), F.col("p.depth").alias("depth")).agg(F.count("*").alias("more"))
    done = over.groupBy(F.col("node_conv").alias("conv"), F.col("d").alias("depth")).agg(F.max("ends").alias("ends"))
    rows = own.join(total, at).join(kids, at, "left").join(done, at, "left").withColumn("e", F.explode(F.sequence("first", "depth")))
    bottom, d = F.col("e") == F.col("depth"), (F.col("e") - F.col("first") + 1).cast("int")
    along = F.aggregate(F.slice("chain", d, F.size("chain") + 1), zero, lambda a, x: a + x)
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("e").alias("depth"), F.when(F.col("e") == F.col("first"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("kids") + F.coalesce("more", zero)).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.greatest("all_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("under") + F.when(F.size("chain") > 0, (F.col("n_convs") - 1) * along).otherwise(zero)).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def nodes(turns: DataFrame, local_turns: int = 500_000) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text, any others).

    Rows without a conv_id belong to no conversation. Turns are ordered by ``turn`` (null first), ties by role and then by
    code; repeated rows are repeated turns. Null roles and texts are empty."""
    return trie(shared_starts(saved(sequences(turns))), local_turns)


#: DuckDB SQL for ``nodes``; CRC-32 is folded over the digits with its table.
ORACLE = """
WITH b0 AS (SELECT range AS i, range AS v FROM range(256)),
b1 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b0),
b2 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b1),
b3 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b2),
b4 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b3),
b5 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b4),
b6 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b5),
b7 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b6),
b8 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b7),
crc AS (SELECT list(CAST(v AS BIGINT) ORDER BY i) AS t FROM b8),
convs AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (
  SELECT c.conv_id, c.seq, b.seq AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 4 AS h
  FROM convs AS c CROSS JOIN crc LEFT JOIN convs AS b ON b.conv_id = c.conv_id - c.conv_id % 20
),
rebuilt AS (SELECT conv_id, list_concat(list_slice(coalesce(base, []), 1, h), list_slice(seq, h + 1, len(seq))) AS seq FROM h),
member AS (SELECT conv_id, d, list_slice(seq, 1, d) AS p, d = len(seq) AS e FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE e), '') AS ends,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS saving
  FROM member GROUP BY p, d
),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
up AS (SELECT list_slice(p, 1, a) AS p, sum(saving) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT p, saving, n_children, unnest(range(d + 1)) AS a FROM own) GROUP BY 1)
SELECT o.conv_id, o.d AS depth, q.conv_id AS parent_conv_id, o.n AS n_convs, CAST(o.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own AS o JOIN up USING (p) LEFT JOIN node AS q ON o.d > 0 AND q.p = list_slice(o.p, 1, o.d - 1)
"""
