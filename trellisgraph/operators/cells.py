"""A stored vector index: vectors partitioned by coarse cell, searched in the cells nearest to each query.

Below ``path``: ``vectors`` (partitioned by cell: id, v) and ``centres`` (cell, v, the type of ids; -1 stands for none). Centres are fitted on a bounded sample;
every usable vector is stored in the cell of its nearest centre by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.operators.search import QUERY_BYTES, cosine, dot, usable, vector_search


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fitted(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means, at most one a vector; an empty cell takes the vector worst served."""
    x = _unit(vectors)
    cells = min(cells, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        score = x @ centres.T
        own, best = score.argmax(1), score.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        none = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[none] = x[np.argsort(best, kind="stable")[: len(none)]]
        centres = _unit(sums)
    return centres


def _nearest(centres: np.ndarray, most: int, dim: int):
    """The numbers of the ``most`` nearest centres of each vector, best first; none for one of another length."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            length = np.asarray(column.value_lengths().fill_null(0))
            good = length == dim
            flat = np.asarray(column.filter(pa.array(good)).flatten().cast(pa.float64())).reshape(-1, dim)
            order = np.argsort(-(flat @ centres.T), axis=1, kind="stable")[:, :most].astype(np.int32)
            offsets = np.append(0, np.cumsum(np.where(good, order.shape[1], 0)))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(order.ravel()))

    return F.arrow_udf(run, "array<int>")


@dataclass
class Cells:
    """A stored vector index."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()  # as many rows as cells, and one
        self.id_type = rows.column("id_type")[0].as_py()
        self.centres = np.array(rows.column("v").to_pylist()[1:], np.float64)
        self.dim = self.centres.shape[1] if len(self.centres) else 0

    def vectors(self) -> DataFrame:
        """(id, v, cell); the schema is given, as an index of no vectors has no files."""
        return self.spark.read.schema(f"id {self.id_type}, v array<float>, cell int").parquet(f"{self.path}/vectors")

    def add(self, rows: DataFrame, id_col: str, vec_col: str) -> None:
        """Stores further vectors in the cells there are."""
        _stored(rows, id_col, vec_col, self.centres, self.dim, self.path, "append")


def _stored(rows: DataFrame, id_col: str, vec_col: str, centres: np.ndarray, dim: int, path: str, mode: str) -> None:
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(usable(F.col("v")) & (F.size("v") == dim))
    cell = F.get(_nearest(centres, 1, dim)("v"), F.lit(0))
    # no exchange by cell, so that a crowded cell is written by many tasks
    base.select("id", "v", cell.alias("cell")).write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")


def build(rows: DataFrame, id_col: str, vec_col: str, path: str, cells: int | None = None, sample: int = 20_000) -> Cells:
    """Writes the index of ``rows`` to a folder that driver and executors share.

    Centres are fitted on at most ``sample`` vectors, those with the least hash of their id; ``cells`` is the square root of
    the number of vectors unless given, at most an eighth of the sample. Null, zero and non-finite vectors and those of
    another length than most are not stored."""
    spark = rows.sparkSession
    finite = usable(F.col("v")) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(finite)
    sizes = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim, total = (sizes["n"], sizes["count"]) if sizes else (0, 0)
    base = base.where(F.size("v") == dim)
    some = base.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").to_pylist()
    cells = cells or max(1, min(round(total**0.5), sample // 8))
    centres = fitted(np.array(some, np.float64), cells) if some else np.zeros((0, 0))
    listed = [(-1, [])] + [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(listed, "cell int, v array<double>").withColumn("id_type", F.lit(base.schema["id"].dataType.simpleString())).coalesce(1).write.parquet(f"{path}/centres")
    _stored(base, "id", "v", centres, dim, path, "overwrite")
    return Cells(spark, path)


def search(index: Cells, queries: DataFrame, top_k: int = 10, probes: int = 8, normalized: bool = True, exact: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the best of each query (query_id, q) by dot product (or cosine), ties by id.

    Only the ``probes`` cells nearest to a query are compared with it, and only the probed cells are read; exact reads and
    compares all. Queries are a stated set: they are measured and go to every task in blocks of ``QUERY_BYTES``."""
    if exact or not index.dim:
        return vector_search(index.vectors().select("id", "v"), "id", "v", queries, top_k, normalized)
    near = queries.select("query_id", "q").where(usable(F.col("q")))
    near = near.select("query_id", "q", F.explode(_nearest(index.centres, probes, index.dim)(F.col("q").cast("array<double>"))).alias("cell"))
    size, number = near.agg(F.coalesce(F.sum(8 * F.size("q") + 40), F.lit(0)), F.countDistinct("cell")).first()
    if not number:
        return vector_search(index.vectors().select("id", "v").limit(0), "id", "v", queries, top_k, normalized)
    wanted = sorted(r[0] for r in near.select("cell").distinct().collect())  # at most as many as cells
    base = index.vectors().where(F.col("cell").isin(wanted))
    score = dot(F.col("v"), F.col("q")) if normalized else cosine(F.col("v"), F.col("q"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    blocks, out = 1 + int(size) // QUERY_BYTES, None
    for b in range(blocks):
        own = near if blocks == 1 else near.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        best = base.join(F.broadcast(own), "cell").select("query_id", "id", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= top_k)
        out = best if out is None else out.unionByName(best)
    return out
