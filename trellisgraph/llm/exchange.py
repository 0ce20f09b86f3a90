"""Blocks ask hash ranges about keys and get an answer to each, over hops of bounded fan-out.

A block sends a message only to a range that it has keys for. Ranges have addresses of ``hops`` digits to base ``base``,
and so do blocks, by a hash. Each hop fixes the next digit of the range and gives up the last one left of the block, so
that messages between the same two addresses travel as one row. With F = ``base`` a hop has at most F rows a block or F
rows an address; there are about as many addresses as blocks, so all hops together carry at most F * hops rows a block,
whatever the corpus holds, where a row for every (block, range) pair would grow with its square. Answers take the hops
back. Every task holds the messages of one address, which is what a block sends.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trellisgraph.llm.common import coded, decoded, mixed, numbers, range_of, signed, unsigned

#: The most rows that a block or an address sends in one hop.
FAN = 256
_MAIL = "to long, head binary, body binary"


class Route(NamedTuple):
    ranges: int
    base: int
    hops: int

    def address(self, block: np.ndarray, range_: np.ndarray, hop: int) -> np.ndarray:
        """Where messages are after ``hop`` hops; after none they are at their block, after the last at their range."""
        if not hop:
            return block
        ahead, behind = self.base ** (self.hops - hop), self.base**hop
        own = (mixed(block.view(np.uint64)) % np.uint64(self.base**self.hops)).astype(np.int64)
        return np.where(range_ < 0, ~range_, range_) // ahead * ahead + own // behind


def route(ranges: int, fan: int = FAN) -> Route:
    """The fewest hops with at most ``fan`` rows each, and the least base that does with them."""
    hops = 1
    while fan**hops < ranges:
        hops += 1
    base = 1
    while base**hops < ranges:
        base += 1
    return Route(ranges, base, hops)


def _bundled(block: np.ndarray, range_: np.ndarray, values: list[bytes], to: np.ndarray) -> pa.Table:
    order = np.argsort(to, kind="stable")
    size = np.fromiter(map(len, values), np.int64, len(values))
    first = np.flatnonzero(np.diff(to[order], prepend=-1))
    head, body = [], []
    for own in np.split(order, first[1:]) if len(order) else []:
        head.append(coded(block[own], signed(range_[own]), size[own]))
        body.append(pa.compress(b"".join([values[i] for i in own.tolist()]), codec="zstd", asbytes=True))
    return pa.table({"to": pa.array(to[order][first], pa.int64()), "head": pa.array(head, pa.binary()), "body": pa.array(body, pa.binary())})


def _opened(mail: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(block, range, value) of every message of some rows."""
    blocks, ranges, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for head, body in zip(mail.column("head").to_pylist(), mail.column("body").to_pylist()):
        block, range_, size = decoded(head)
        end = np.cumsum(size).astype(np.int64)
        raw = pa.decompress(body, int(end[-1]), codec="zstd", asbytes=True)
        values += [raw[b - n : b] for b, n in zip(end.tolist(), size.tolist())]
        blocks.append(block.astype(np.int64))
        ranges.append(unsigned(range_))
    return np.concatenate(blocks), np.concatenate(ranges), values


def posted(block: int, range_: np.ndarray, values: list[bytes], way: Route) -> pa.Table:
    """What a block sends: a value to each range, on its first hop. A range ~r stands for a note that r sends back as it is."""
    range_ = np.asarray(range_, np.int64)
    block = np.full(len(range_), block, np.int64)
    return _bundled(block, range_, values, way.address(block, range_, 1))


def _onward(way: Route, hop: int):
    def run(mail: pa.Table) -> pa.Table:
        block, range_, values = _opened(mail)
        return _bundled(block, range_, values, way.address(block, range_, hop))

    return run


def _replies(answer: Callable, way: Route):
    def run(mail: pa.Table) -> pa.Table:
        block, range_, values = _opened(mail)
        asked = np.flatnonzero(range_ >= 0)
        if len(asked):
            for i, value in zip(asked.tolist(), answer(block[asked], [values[i] for i in asked.tolist()])):
                values[i] = value
        return _bundled(block, range_, values, way.address(block, range_, way.hops - 1))

    return run


def arrived(texts, ask: Callable, way: Route) -> DataFrame:
    """The messages that ``ask`` posts for every group of ``texts`` (grouped or cogrouped by block), at their ranges."""
    mail = texts.applyInArrow(ask, _MAIL)
    for hop in range(2, way.hops + 1):
        mail = mail.groupBy("to").applyInArrow(_onward(way, hop), _MAIL)
    return mail


def answered(mail: DataFrame, answer: Callable, way: Route) -> DataFrame:
    """(block, head, body): the answers to what ``arrived``, back at their blocks. ``answer`` takes the blocks and values
    of all messages of one range and gives a value for each."""
    mail = mail.groupBy("to").applyInArrow(_replies(answer, way), _MAIL)
    for hop in range(way.hops - 2, -1, -1):
        mail = mail.groupBy("to").applyInArrow(_onward(way, hop), _MAIL)
    return mail.withColumnRenamed("to", "block")


def values_at(mail: pa.Table) -> list[bytes]:
    """The messages of one range."""
    return _opened(mail)[2]


def check(*keys: np.ndarray) -> np.ndarray:
    """A number that other keys do not have; an answer starts with that of the keys it answers."""
    return np.array([sum(int(k.sum(dtype=np.uint64)) for k in keys) & 0xFFFFFFFFFFFFFFFF], np.uint64)


def cuts(ranges: int, *keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ranges that sorted keys have, and for each list of keys where they start and end."""
    of = [range_of(k, ranges) for k in keys]
    used = np.unique(np.concatenate(of))
    edge = np.append(used, ranges)
    return used, [np.searchsorted(x, edge) for x in of]


def answers(mail: pa.Table, checks: dict[int, int]) -> list[list[np.ndarray]]:
    """The answers that a block got, by range; ``checks``: of each range asked, the ``check`` of its keys."""
    _, range_, values = _opened(mail)
    order = np.argsort(range_)
    found = [numbers(values[i]) for i in order.tolist()]
    if dict(zip(range_[order].tolist(), (int(x[0][0]) for x in found))) != checks:
        raise ValueError("a block got other answers than it asked for: the input gave other rows when it was read again")
    return [x[1:] for x in found]


def noted(mail: pa.Table) -> tuple[list[bytes], list[list[np.ndarray]]]:
    """The notes that came back as they were, and the answers by range."""
    _, range_, values = _opened(mail)
    order = np.argsort(range_, kind="stable").tolist()
    return [values[i] for i in order if range_[i] < 0], [numbers(values[i])[1:] for i in order if range_[i] >= 0]
