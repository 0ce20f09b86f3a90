"""Near-duplicate vectors by sorted projection passes.

Equal vectors become one class first. In each of a number of passes the classes are ordered by a key of concatenated
random-hyperplane bits, dealt to tasks by ranges of that order, and each is compared with the ``window`` before it, also
across the edges of the ranges. One bit is equal for two vectors at an angle x with probability 1 - x / pi, so a pass
brings them within a window with about (n / window) ** log2(1 - x / pi); the number of passes follows from that and n.
Verified pairs that join two groups not yet joined in the task are emitted, so a dense group costs one pair a
member and not one a pair. Passes are united into components. Inside a component every pair is then verified, block
by block, so links there that the windows never met are counted too; a link whose ends no chain of met pairs joins is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm.common import gapless, parts, saved
from trellisgraph.llm.links import components


def _matrix(column) -> np.ndarray:
    """The vectors of an array column as rows of a matrix; all have one length here."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return values.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # keeps squares of very large or small components finite
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _keys(passes: int, bits: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.asarray(batch.column(1).value_lengths().to_numpy(), np.int64)
            for size in np.unique(lengths):
                own = np.flatnonzero(lengths == size)
                part = batch.take(pa.array(own))
                m = _unit(_matrix(part.column(1)))
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((int(size), passes * bits))
                for p in range(passes):
                    on = m @ planes[size][:, p * bits : (p + 1) * bits] > 0
                    key = (on.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), p * 65536 + int(size) % 65536, np.int64)), pa.array(key), part.column(0), part.column(1)], ["pass", "key", "id", "v"])

    return run


def _passes(n: int, window: int, threshold: float, least: int, recall: float) -> int:
    """The passes, ``least`` or more, after which two of ``n`` vectors at the threshold have met with probability ``recall``."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    if n <= window or same >= 1:
        return least
    met = (n / window) ** math.log2(max(same, 1e-3))
    return max(least, math.ceil(math.log(1 - recall) / math.log1p(-met)))


def _windows(window: int, threshold: float):
    """Links (a, b) of one range, and its first and last ``window`` vectors (edge, late, pass, id, v) for its two edges."""
    names = ["a", "b", "edge", "late", "pass", "id", "v"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float64())]

    def rows(count, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in zip(names, types)], names)

    def edge(at, late, which, ids, unit):
        n = len(ids)
        return rows(n, edge=np.full(n, at, np.int32), late=np.full(n, late), id=ids, v=list(unit), **{"pass": np.full(n, which, np.int64)})

    def run(batches):
        own = TaskContext.get().partitionId()
        first, sent = None, 0
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        last, ids, unit = None, np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            which = np.asarray(batch.column(0).to_numpy(), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), batch.num_rows]
            found = []
            for a, b in zip(cuts, cuts[1:]):
                for c in range(a, b, 512):
                    part = batch.slice(c, min(512, b - c))
                    new_ids, new = np.asarray(part.column(2).to_numpy(), np.int64), _unit(_matrix(part.column(3)))
                    if last != which[a]:
                        last, ids, unit, above = which[a], new_ids[:0], new[:0], {}
                    near_ids, near = np.concatenate([ids, new_ids]), np.concatenate([unit, new])
                    k = len(ids)
                    if first is None:
                        first = which[a]
                    if first == which[a] and sent < window:
                        yield edge(own - 1, True, first, new_ids[: window - sent], new[: window - sent])
                        sent += len(new_ids)
                    i, j = np.nonzero(new @ near.T >= threshold)
                    i += k
                    fits = (j < i) & (j >= i - window)
                    for x, y in zip(near_ids[i[fits]].tolist(), near_ids[j[fits]].tolist()):
                        p, q = top(x), top(y)
                        if p != q:
                            above[p] = q
                            found.append((x, y))
                    ids, unit = near_ids[-window:], near[-window:]
            yield rows(len(found), a=[x for x, _ in found], b=[y for _, y in found])
        if last is not None:
            yield edge(own, False, last, ids, unit)

    return run


def _across(threshold: float):
    """Links between the last vectors before an edge and the first ones after it."""

    def run(table: pa.Table) -> pa.Table:
        late, which = table.column("late").to_numpy(), table.column("pass").to_numpy()
        ids, unit = table.column("id").to_numpy(), table.column("v").to_pylist()
        before, after = np.flatnonzero(~late), np.flatnonzero(late)
        a, b = [], []
        if len(before) and len(after) and which[before[0]] == which[after[0]]:
            i, j = np.nonzero(np.array([unit[x] for x in after]) @ np.array([unit[x] for x in before]).T >= threshold)
            a, b = ids[after[i]], ids[before[j]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _counts(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        block = np.asarray(table.column("block").to_numpy(), np.int64)
        ids, size = np.asarray(table.column("id").to_numpy(), np.int64), np.asarray(table.column("size").to_numpy(), np.int64)
        lists = table.column("v").combine_chunks()
        unit = _unit(_matrix(lists if isinstance(lists, pa.Array) else lists.chunk(0)))
        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block == j)
        found, back = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for a in range(0, len(left), 512):
            part = left[a : a + 512]
            near = unit[part] @ unit[right].T >= threshold
            if i == j:
                near[np.arange(len(part)), a + np.arange(len(part))] = False
            found[a : a + 512] = near @ size[right]
            back += near.T @ size[part]
        if i == j:
            return pa.table({"id": pa.array(ids[left]), "n": pa.array(found)})
        return pa.table({"id": pa.array(np.concatenate([ids[left], ids[right]])), "n": pa.array(np.concatenate([found, back]))})

    return run


def near_vectors(table: DataFrame, threshold: float = 0.9, passes: int | None = None, window: int = 64, bits: int = 48, block: int = 4096, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing: n_links 0, a component
    of their own, kept. Vectors of different lengths never link. Rows that repeat an id count as further vectors. Every
    link has a cosine >= threshold in double precision; whether all are found depends on the passes. Unless given they
    are 12 or as many more as the number of different vectors needs for ``recall`` of the pairs at the threshold, if
    vectors lie in all directions alike. Other columns are not read.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    hashed = rows.withColumn("h", F.when(F.coalesce(fine, F.lit(False)), F.struct(F.xxhash64("v").alias("x"), F.hash("v").alias("y"), F.size("v").alias("z"))))
    classes = saved(hashed.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("v").alias("v")))
    n = classes.count()
    passes = passes or _passes(n, window, threshold, 12, recall)
    keyed = classes.select("id", "v").mapInArrow(_keys(passes, bits, seed), "pass long, key long, id long, v array<double>")
    # ranges much longer than a window, so that a window reaches over one edge only
    ranges = max(1, min(parts(table.sparkSession), n * passes // (8 * window)))
    dealt = keyed.repartitionByRange(ranges, "pass", "key", "id").sortWithinPartitions("pass", "key", "id")
    met = saved(dealt.mapInArrow(_windows(window, threshold), "a long, b long, edge int, late boolean, pass long, id long, v array<double>"))
    links = met.where("edge is not null").groupBy("edge").applyInArrow(_across(threshold), "a long, b long").union(met.where("edge is null").select("a", "b"))
    of = components(links)
    members = gapless(classes.join(of, F.col("id") == F.col("node")).select("component", "id", "size", "v"), ["component"], ["id"], "rank", max(16, n // 1_000_000))
    members = saved(members.withColumn("block", F.expr(f"cast(rank div {block} as int)")))
    blocks = members.groupBy("component").agg((F.max("block") + 1).alias("blocks"))
    dealt = members.join(blocks, "component").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "size", "v")
    linked = dealt.groupBy("component", "i", "j").applyInArrow(_counts(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    of_class = classes.select("h", "id", "size").join(linked, "id", "left").join(of.select(F.col("node").alias("id"), "component"), "id", "left")
    of_class = of_class.select(F.col("h"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = hashed.select("vec_id", "h").join(of_class, "h", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
