"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards are the leaves of a tree of regions and racks, which follows from their numbers alone. A row draws for each shard
an exponential variate of rate weight from a hash of its key and the shard. The draw of a rack is the least of its shards',
that of a region the least of its racks': again exponential, of the weight below it. A row descends to the least draw on
every level. Draws below a node depend on nothing else, so a change of weights moves rows only into subtrees that gained or
out of those that lost, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm.common import gapless


def tree(shards: int, racks: int = 2, per_rack: int = 4) -> dict[int, dict[int, list[int]]]:
    """region -> rack -> shards: shards fill racks, and racks fill regions, in order of their numbers."""
    out: dict[int, dict[int, list[int]]] = {}
    for s in range(shards):
        out.setdefault(s // (racks * per_rack), {}).setdefault(s // per_rack, []).append(s)
    return out


def _draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1); a shard without weight is never drawn."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit("shard"), F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(weight) if weight > 0 else F.lit(float("inf"))


def _least(draws: Column, groups: dict[int, list[int]]) -> Column:
    """(draw, number) of the group with the least draw; groups: number -> places in ``draws``, which follow one another."""
    return F.array_min(F.array(*[F.struct(F.array_min(F.slice(draws, min(at) + 1, len(at))).alias("d"), F.lit(g).alias("c")) for g, at in groups.items()]))


def shard_of(df: DataFrame, key: str, shards: int, name: str, weights: dict[int, float] | None = None) -> DataFrame:
    """``df`` with column ``name``: the shard of each row. weights: of shards, 1 unless given."""
    weight = {s: float((weights or {}).get(s, 1.0)) for s in range(shards)}
    regions = tree(shards)
    # draws by shard, regions and racks one after another
    df = df.withColumn("_draws", F.array(*[_draw(F.col(key), s, weight[s]) for s in range(shards)]))
    df = df.withColumn("_region", _least(F.col("_draws"), {r: [s for kids in racks.values() for s in kids] for r, racks in regions.items()})["c"])
    rack = leaf = F.lit(None).cast("int")
    for r, racks in regions.items():
        rack = F.when(F.col("_region") == r, _least(F.col("_draws"), racks)["c"]).otherwise(rack)
    df = df.withColumn("_rack", rack)
    for racks in regions.values():
        for k, kids in racks.items():
            leaf = F.when(F.col("_rack") == k, _least(F.col("_draws"), {s: [s] for s in kids})["c"]).otherwise(leaf)
    return df.withColumn(name, leaf.cast("int")).drop("_draws", "_region", "_rack")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``key``: the id and the number of shards decide, whatever number there was before; one more shard takes rows only
    into itself. A null text has no bytes (size 1, checksum 0). Rows with the same
    id share a shard, a null id has one too. Slots are numbered by id within hash buckets of each shard.
    """
    data = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"))
    rows = shard_of(shard_of(rows, "doc_id", shards, "shard"), "doc_id", shards + 1, "grown_shard")
    out = gapless(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", 256)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
