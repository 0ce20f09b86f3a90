"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that occurs in a text with at most k = max_error * m edits shares at least m + 1 - q * (k + 1) of
its q-grams with the place, all on diagonals within k of each other. Shared q-grams are counted in overlapping bands of
diagonals; a band under the bound cannot hold a match and is dropped, the rest is aligned in a band around it. To keep
counts short an item's most common q-grams are left out and the bound is lowered by as many, which loses nothing. An item
too short for the bound to be above zero takes the longest q for which it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm import common
from trellisgraph.llm.common import BROADCAST_BYTES, lean, sliced

_BITS = 22
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: A-Z in lower case, white space as blank.
_FOLD = common.LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 32
#: Bytes of letters, digits and of all that is not ASCII.
_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(data) - q + 1)
    key = np.zeros(n, np.uint64)
    for i in range(q):
        key = (key << np.uint64(8)) | data[i : i + n].astype(np.uint64)
    return key


class ItemIndex:
    """The q-grams of a block of benchmark items, with places, bounds and a bit table for quick misses."""

    def __init__(self, ids: list, items: list[np.ndarray], edits: list[int], whole: list[bool], q: int, spare: int = 32):
        """whole: of items that count only where no word goes on before or after them."""
        self.q, self.ids, self.items, self.whole = q, ids, items, whole
        self.edits = np.array(edits, np.int64)
        own = [_grams(x, q) for x in self.items]
        every = np.concatenate([np.zeros(0, np.uint64), *own])
        kinds, counts = np.unique(every, return_counts=True)
        keys, items, places, bounds = [], [], [], []
        for i, g in enumerate(own):
            bound = len(self.items[i]) + 1 - q * (int(self.edits[i]) + 1)
            often = counts[np.searchsorted(kinds, g)] if len(g) else np.zeros(0, np.int64)
            drop = np.argsort(-often, kind="stable")[: max(0, bound - spare)]
            drop = drop[often[drop] > 1]
            kept = np.setdiff1d(np.arange(len(g)), drop)
            keys.append(g[kept])
            items.append(np.full(len(kept), i))
            places.append(kept)
            bounds.append(max(1, bound - len(drop)))
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(key, kind="stable")
        self.bounds = np.array(bounds, np.int64)
        self.item = np.concatenate([np.zeros(0, np.int64), *items])[order].astype(np.int64)
        self.place = np.concatenate([np.zeros(0, np.int64), *places])[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self._spot(self.keys)] = True
        self.band = int(max([16, *(self.edits + 1).tolist()]))

    @staticmethod
    def _spot(keys):
        return ((keys * _MULTIPLY) >> np.uint64(64 - _BITS)).astype(np.int64)

    def regions(self, data: np.ndarray, offsets: np.ndarray):
        """(text, item, least diagonal) of every band of 2 * self.band diagonals that meets its item's bound."""
        keys = _grams(data, self.q)
        if not len(keys) or not len(self.keys):
            return []
        at = np.flatnonzero(self.bits[self._spot(keys)])
        found = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[found] == keys[at]
        at, found = at[same], found[same]
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.q <= offsets[doc + 1]
        at, found, doc = at[inside], found[inside], doc[inside]
        n = self.count[found]
        row = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, diagonal = self.item[row], np.repeat(at - offsets[doc], n) - self.place[row]
        doc = np.repeat(doc, n)
        band = diagonal // self.band
        span = int(band.max() - band.min() + 3) if len(band) else 1
        low = int(band.min()) - 1 if len(band) else 0
        code = ((doc * len(self.items) + item) * span + (band - low)).astype(np.int64)
        # a q-gram of the item counts once in a band, however often the text repeats it there
        place = self.place[row]
        both, place = np.concatenate([code, code - 1]), np.concatenate([place, place])
        order = np.lexsort((place, both))
        both, place = both[order], place[order]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]) | (place[1:] != place[:-1])
        both, total = np.unique(both[new], return_counts=True)
        pair = both // span
        good = total >= self.bounds[pair % len(self.items)]
        return list(zip((pair[good] // len(self.items)).tolist(), (pair[good] % len(self.items)).tolist(), ((both[good] % span + low) * self.band).tolist()))

    def aligned(self, text: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best match of the item on diagonals near the band, or None over the budget."""
        pattern, k = self.items[item], int(self.edits[item])
        low = max(0, diagonal - k)
        near = text[low : max(0, diagonal + 2 * self.band + k + len(pattern))].tobytes()
        at = near.find(pattern.tobytes())
        while at >= 0 and self.whole[item] and not _apart(text, low + at, low + at + len(pattern)):
            at = near.find(pattern.tobytes(), at + 1)
        if at >= 0:
            return 0, low + at, low + at + len(pattern)
        if not k:
            return None
        a, width = diagonal - k, 2 * self.band + 2 * k + 1
        far = len(pattern) + 1
        column = np.arange(width)
        place = a + column  # text position before row 0
        cost = np.where((place >= 0) & (place <= len(text)), 0, far)
        start = place.copy()
        for i, c in enumerate(pattern):
            # in row i + 1 column j stands for text position a + j + i + 1; a step in the row is an inserted character
            pos = place + i + 1
            ok = (pos >= 1) & (pos <= len(text))
            step = np.where(ok, text[np.clip(pos - 1, 0, max(0, len(text) - 1))] != c, True) if len(text) else np.ones(width, bool)
            diag = np.where(ok, cost + step, far)
            up = np.append(cost[1:], far) + 1
            best = np.minimum(diag, up)
            from_ = np.where(diag <= up, start, np.append(start[1:], 0))
            best = np.where((pos >= 0) & (pos <= len(text)), best, far)
            slide = np.minimum.accumulate((best - column) * (width + 1) + column)
            source = np.mod(slide, width + 1)
            cost = np.minimum(best[source] + column - source, far)
            start = from_[source]
            if i % 8 == 7 and cost.min() > k:
                return None
        end = int(np.argmin(cost))
        edits = int(cost[end])
        return (edits, int(start[end]), a + end + len(pattern)) if edits <= k else None


def _apart(text: np.ndarray, start: int, end: int) -> bool:
    """Whether no letter, digit or byte of another script touches text[start:end]."""
    return not ((start and _WORD[text[start - 1]] and _WORD[text[start]]) or (end < len(text) and _WORD[text[end]] and _WORD[text[end - 1]]))


def indexes(ids: list, texts: list[str], q: int, max_error: float, least: int) -> list[ItemIndex]:
    """The items by the q they can be found with; those under ``least`` bytes have no edits and must be whole words."""
    by: dict[int, tuple[list, ...]] = {}
    for key, text in zip(ids, texts):
        item = _FOLD[np.frombuffer(" ".join(text.split()).encode(), np.uint8)]
        if not len(item):
            continue
        short = len(item) < least
        edits = 0 if short else int(max_error * len(item))
        own = by.setdefault(max(1, min(q, len(item) // (edits + 1))), ([], [], [], []))
        for column, value in zip(own, (key, item, edits, short)):
            column.append(value)
    return [ItemIndex(*own, q=size) for size, own in sorted(by.items())]


def _collapsed(data: np.ndarray, offsets: np.ndarray):
    """(data, offsets, places): folded texts with runs of blanks as one, and where each byte was before."""
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == 32) & (data[:-1] == 32)
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    places = np.flatnonzero(~again)
    return data[places], np.searchsorted(places, offsets), places


def _matches(held):
    def run(batches):
        for batch in batches:
            schema = batch.schema
            for part in sliced([batch]):
                data, offsets = common.buffers(part.column(1))
                was = offsets
                data, offsets, places = _collapsed(_FOLD[data], offsets)
                ids = part.column(0).to_pylist()
                for index in held.value:
                    best: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for doc, item, diagonal in index.regions(data, offsets):
                        if best.get((doc, item), (1,))[0] == 0:
                            continue
                        got = index.aligned(data[offsets[doc] : offsets[doc + 1]], item, diagonal)
                        if got and got < best.get((doc, item), (1 << 60,)):
                            best[doc, item] = got
                    for (doc, item), (edits, start, end) in best.items():
                        best[doc, item] = edits, int(places[offsets[doc] + start] - was[doc]), int(places[offsets[doc] + end - 1] + 1 - was[doc])
                    keys = list(best)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[d] for d, _ in keys], schema.field(0).type), pa.array([index.ids[i] for _, i in keys], pa.string()), *(pa.array([best[k][j] for k in keys], pa.int64()) for j in range(3))],
                        ["doc_id", "item_id", "n_edits", "start_byte", "end_byte"],
                    )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.1, q: int = 8, id_col: str = "doc_id", text_col: str = "text", least: int = 24) -> DataFrame:
    """doc_id, item_id, n_edits, start_byte, end_byte: for every text and item the best match within the edit budget.

    Texts and items are compared as UTF-8 bytes with A-Z in lower case and white space as blanks, runs of it as one;
    start_byte and end_byte count in the text as it is. Null texts match nothing; null and blank items are left out. Items
    under ``least`` bytes, which chance would match with edits, are found only as they are, where no word goes on before
    or after them. Repeated ids are searched each for itself, repeated items give a row each. Items go to the tasks in
    blocks whose text stays under a bound.
    """
    spark = docs.sparkSession
    lean(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id string, n_edits long, start_byte long, end_byte long"
    kind = benchmark.schema["item_id"].dataType
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + 40 * size // BROADCAST_BYTES  # an index takes up to 40 bytes for each byte of text
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(indexes([r["item_id"] for r in own], [r["text"] for r in own], q, max_error, least))
        found = rows.mapInArrow(_matches(held), schema)
        out = found if out is None else out.union(found)
    return out.withColumn("item_id", F.col("item_id").cast(kind))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; each row is judged by its own text."""
    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    bad = leaks(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, id_col="key", **options).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(key.alias("key"), F.struct("*").alias("row")).join(bad, "key", "left_anti").select("row.*")
