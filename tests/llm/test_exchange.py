"""The exchange between blocks and hash ranges: answers, hops and the rows they take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trellisgraph.llm import exchange
from trellisgraph.llm.common import numbers, plain, steps, walked


def keys_for(n):
    return lambda block: np.unique(np.random.default_rng(block % 7).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))


def ask(n, way):
    keys_of = keys_for(n)

    def run(rows):  # functions for workers stand inside others: workers do not import this module
        block = rows.column("block")[0].as_py()
        keys = keys_of(block)
        used, (cut,) = exchange.cuts(way.ranges, keys)
        return exchange.posted(block, np.append(used, ~(block % way.ranges)), [*(plain(*steps(keys[i:j])) for i, j in zip(cut, cut[1:])), plain(np.array([block]))], way)

    return run


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_every_key_is_answered(spark, fan):
    blocks, n = 21, 40
    way = exchange.route(50, fan)
    texts = spark.range(blocks).select(F.col("id").alias("block"))

    def how_many(_, values):
        """In how many blocks each key is."""
        keys = [walked(*numbers(x)) for x in values]
        _, number, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        return [plain(exchange.check(k), c) for k, c in zip(keys, np.split(count[number], np.cumsum([len(k) for k in keys])[:-1]))]

    def results(rows, answers):
        block = rows.column("block")[0].as_py()
        notes, found = exchange.noted(answers)
        return pa.table({"block": [block], "note": [int(numbers(notes[0])[0][0])], "counts": [np.concatenate([x[0] for x in found]).astype(np.int64).tolist()]})

    back = exchange.answered(exchange.arrived(texts.groupBy("block"), ask(n, way), way), how_many, way)
    got = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(results, "block long, note long, counts array<long>").collect()
    assert {(r["block"], r["note"], len(r["counts"]), set(r["counts"]).pop()) for r in got} == {(b, b, n, 3) for b in range(blocks)}
    assert all(len(set(r["counts"])) == 1 for r in got)  # each set of keys is in three blocks


def test_rows_follow_the_blocks(spark):
    """With as many ranges as blocks, rows of all hops stay below fan * hops a block; pairs would grow with the square."""
    fan = 4
    for blocks in (16, 64, 256):
        way = exchange.route(blocks, fan)
        texts = spark.range(blocks).select(F.col("id").alias("block"))
        first = texts.groupBy("block").applyInArrow(ask(2 * blocks, way), "to long, head binary, body binary")
        mail = exchange.arrived(texts.groupBy("block"), ask(2 * blocks, way), way)
        assert (way.base, way.base**way.hops) == (fan, blocks)
        assert first.count() <= (fan + 1) * blocks and mail.count() <= (fan + 1) * blocks
        assert mail.select("to").distinct().count() == blocks


@pytest.mark.parametrize("ranges, fan, base, hops", [(8, 256, 8, 1), (256, 256, 256, 1), (257, 256, 17, 2), (3840, 256, 62, 2), (13_000_000, 256, 236, 3)])
def test_route(ranges, fan, base, hops):
    assert exchange.route(ranges, fan) == (ranges, base, hops)
    way, r = exchange.route(ranges, fan), np.arange(0, ranges, max(1, ranges // 1000))
    b = np.full(len(r), 12345)
    assert (way.address(b, r, 0) == b).all() and (way.address(b, r, hops) == r).all() and (way.address(b, ~r, hops) == r).all()
    for hop in range(1, hops):
        assert len(np.unique(way.address(b, r, hop))) <= base**hop


def test_other_answers_are_an_error():
    way = exchange.route(8)
    keys = keys_for(5)(1)
    used, (cut,) = exchange.cuts(8, keys)
    values = [plain(exchange.check(keys[i:j]), keys[i:j]) for i, j in zip(cut, cut[1:])]
    mail = exchange.posted(1, used, values, way)
    checks = {r: int(exchange.check(keys[i:j])[0]) for r, i, j in zip(used.tolist(), cut, cut[1:])}
    assert np.concatenate([x[0] for x in exchange.answers(mail, checks)]).tolist() == keys.tolist()
    for wrong in ({r: c + 1 for r, c in checks.items()}, dict(list(checks.items())[1:])):
        with pytest.raises(ValueError, match="other answers"):
            exchange.answers(mail, wrong)
