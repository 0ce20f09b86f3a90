"""What the corpus operators share: scratch tables, gapless ranks, Arrow text buffers and hashing."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.lineage import shared_folder

#: A side is broadcast only when its measured size stays below this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Text handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Text of one block: a Python task holds one block, or the share of one hash range, whatever the corpus holds.
BLOCK_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/trellis-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: its lineage ends there."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``saved``, and the shuffle files that the writing made are removed when it ends; else they stay on the executors'
    disks until the driver happens to collect its garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return saved(df)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay under ``BROADCAST_BYTES``, else as it is."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions in force."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each ``group``, without bringing a group to one task.

    Each group is dealt into ``buckets`` by a hash of ``order``; buckets get offsets from their counts (a table of
    at most groups x buckets rows), and rows are numbered inside a bucket. Rows equal in ``order`` share a bucket.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    count = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = count.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_bucket").alias("_g_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    match = F.col("_bucket") == F.col("_g_bucket")
    for c in group:
        match &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    rank = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order))
    ranked = df.withColumn("_rank", rank)
    out = ranked.join(offsets, match, "left")
    return out.withColumn(name, (F.col("_from") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_rank", "_from", "_g_bucket", *[f"_g_{c}" for c in group])


def lean(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows from now on: rows here hold whole texts, and both the JVM and Python keep a
    batch outside the heap. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def give_back() -> None:
    """Returns freed memory of this worker to the system: workers live on from stage to stage, and what one stage needed
    once would stay with them beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sliced(batches, size: int = SLICE_BYTES, column: str = "text"):
    """Arrow batches cut so that the text of each piece stays near ``size`` bytes; rows are never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False), np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column, one after another, and the offsets between them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        fill = np.full(max(n, 1 << 16), base, np.uint64)
        fill[0] = 1
        _powers[base] = have = np.cumprod(fill, dtype=np.uint64)
    return have[:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(values)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(_UNBASE, len(values) + 1)[starts])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z in lower case: text number, start, end and hash of each."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, span_hashes(LOWER[data] if lower else data, starts, ends)


def _dealt(size: int, column: str):
    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        block, weight = TaskContext.get().partitionId() << 32, 0
        for part, batch in enumerate(sliced(batches, size // 8, column)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                writer.write_batch(batch)
            if weight >= size:
                block, weight = block + 1, 0
            weight += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "part", "rows"])

    return run


def dealt(df: DataFrame, size: int = BLOCK_BYTES, column: str = "text") -> DataFrame:
    """(block, part, rows): the rows of ``df``, many in one compressed value.

    A block holds rows of one input partition, in order, until the bytes of ``column`` reach ``size``; a text is never cut.
    """
    return df.mapInArrow(_dealt(size, column), "block long, part long, rows binary")


def blocked(df: DataFrame, size: int = BLOCK_BYTES, column: str = "text") -> DataFrame:
    """``dealt`` rows, partitioned by block. Several reads in one plan share the exchange; ``df`` must give its partitions
    the same rows whenever it is read."""
    return dealt(df, size, column).repartition("block")


def unpacked(rows: pa.Table) -> list[pa.RecordBatch]:
    """The record batches of a block, in order."""
    order = np.argsort(rows.column("part").to_numpy())
    out = []
    for i in order:
        with pa.ipc.open_stream(pa.py_buffer(rows.column("rows")[int(i)].as_py())) as reader:
            out += list(reader)
    return out


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def hash_ranges(total: int, size: int = BLOCK_BYTES) -> int:
    """Hash ranges for what ``total`` bytes of text send, so that one holds about what a block sends."""
    return max(8, -(-total // size))


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each key; ranges ascend with the keys."""
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def plain(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one value: bytes of equal weight together, empty ones left out."""
    head, body = [len(columns)], []
    for x in columns:
        x = np.ascontiguousarray(x).astype("<u8")
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head += [len(x), width]
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(head, "<i8").tobytes() + b"".join(body)


def numbers(raw: bytes, most: int | None = None) -> list[np.ndarray]:
    """The columns of a ``plain`` value, or the first ``most``, as unsigned 64-bit numbers; what follows them is not read."""
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * count, 8).reshape(-1, 2)[:most].tolist()
    at, out = 8 + 16 * count, []
    for n, width in head:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(x.reshape(-1).view("<u8").astype(np.uint64, copy=False) if n else np.zeros(0, np.uint64))
        at += n * width
    return out


def coded(*columns: np.ndarray) -> bytes:
    """A ``plain`` value, compressed."""
    raw = plain(*columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def decoded(value: bytes) -> list[np.ndarray]:
    """The columns of a ``coded`` value."""
    return numbers(pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True))


def steps(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as the first and the differences that follow."""
    return key[:1], np.diff(key)


def walked(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The keys that ``steps`` took apart."""
    return np.cumsum(np.concatenate([first, rest]), dtype=np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of either sign as unsigned ones, small where they are near zero."""
    return (x << 1 ^ x >> 63).view(np.uint64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each item, ``count`` numbers long, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
