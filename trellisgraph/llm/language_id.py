"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a byte context tree of order up to ``order``, learnt once and then frozen. A byte seen in a context
costs -log2 of count / (total + kinds); any other byte pays the context's escape, kinds / (total + kinds) (method C),
and is looked up in the next shorter context; below the empty context all 256 bytes are alike. A text's code length
in each language is the exact sum over all its bytes, and the shortest wins.

All languages share one table of byte strings, so one look-up per byte serves every language: a row holds the
finished code length of its last byte after the bytes before it, escapes included, for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.llm import common
from trellisgraph.llm.common import SLICE_BYTES, lean, sliced

#: A letter of any script, as Java's regular expressions see it.
LETTER = r"\p{L}"


def _keys(data: np.ndarray, length: int) -> np.ndarray:
    """Each run of ``length`` bytes as one number, the first byte highest."""
    n = max(0, len(data) - length + 1)
    key = np.zeros(n, np.uint64)
    for k in range(length):
        key = (key << np.uint64(8)) | data[k : k + n].astype(np.uint64)
    return key


def _counts(order: int):
    def run(batches):
        for batch in sliced(batches):
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(labels.tolist()):
                data, offsets = common.buffers(batch.column(1).filter(pa.array(labels == lang)))
                for length in range(1, order + 2):
                    key = _keys(data, length)
                    inside = np.searchsorted(offsets, np.arange(len(key)), "right") == np.searchsorted(offsets, np.arange(len(key)) + length - 1, "right")
                    key, n = np.unique(key[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array([length] * len(key), pa.int32()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "length", "key", "n"])

    return run


class ContextTrees:
    """Frozen PPM statistics of several languages: for each string length a sorted table with code lengths."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]], order: int):
        """counts: for each string length the sorted strings, and their counts by language."""
        self.langs, self.order = langs, order
        k = len(langs)
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.cost: list[np.ndarray] = [np.full((1, k), 8.0)]
        self.escape: list[np.ndarray] = []
        contexts, base = np.zeros(1, np.uint64), self.cost[0]
        for length in range(1, order + 2):
            keys, n = counts.get(length, (np.zeros(0, np.uint64), np.zeros((0, k))))
            if length > 1:
                contexts = self.keys[length - 1]
            at = np.searchsorted(contexts, keys >> np.uint64(8)) if length > 1 else np.zeros(len(keys), np.int64)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, at, n)
            np.add.at(kinds, at, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[at])
            lower = self._lookup(keys & np.uint64((1 << (8 * (length - 1))) - 1), length - 1)
            self.escape.append(escape)
            self.cost.append(np.where(n > 0, seen, escape[at] + lower))
            self.keys.append(keys)
        self._index()

    def _find(self, keys: np.ndarray, length: int) -> np.ndarray:
        have = self.keys[length]
        if not len(have):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, at, -1)

    def _lookup(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Code lengths of the last byte of strings of ``length`` bytes, by backing off where they are unknown."""
        if length == 0:
            return np.repeat(self.cost[0], len(keys), 0)
        at = self._find(keys, length)
        out = self.cost[length][np.maximum(at, 0)] if len(self.cost[length]) else np.zeros((len(keys), len(self.langs)))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            shorter = keys[miss] & np.uint64((1 << (8 * (length - 1))) - 1)
            rest = self._lookup(shorter, length - 1)
            if length == 1:
                rest = rest + self.escape[0]
            else:
                context = self._find(keys[miss] >> np.uint64(8), length - 1)
                rest = rest + np.where((context >= 0)[:, None], self.escape[length - 1][np.maximum(context, 0)], 0.0)
            out[miss] = rest
        return out

    def _index(self) -> None:
        """An open hash table over the longest strings, for constant-time look-ups."""
        keys = self.keys[self.order + 1]
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        spot = self._spot(keys)
        self.steps = 0
        while len(left):
            free = self.slots[spot[left]] < 0
            self.slots[spot[left][free]] = left[free]
            left = left[self.slots[spot[left]] != left]
            spot[left] = (spot[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1
        self.table = self.cost[self.order + 1].astype(np.float32)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length in bits of each text in each language."""
        n, k, top = len(offsets) - 1, len(self.langs), self.order + 1
        bits = np.zeros((len(data), k), np.float32)
        place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        full = place >= self.order
        have = self.keys[top]
        if len(have) and len(data) >= top:
            ends = np.flatnonzero(full)
            keys = _keys(data, top)[ends - self.order]
            spot, row = self._spot(keys), np.full(len(keys), -1, np.int64)
            left = np.arange(len(keys))
            for _ in range(self.steps):
                got = self.slots[spot[left]]
                hit = (got >= 0) & (have[np.maximum(got, 0)] == keys[left])
                row[left[hit]] = got[hit]
                left = left[~hit & (got >= 0)]
                if not len(left):
                    break
                spot[left] = (spot[left] + 1) & ((1 << self.bits) - 1)
            found = row >= 0
            bits[ends[found]] = self.table[row[found]]
            miss = ends[~found]
            if len(miss):
                distinct, back = np.unique(keys[~found], return_inverse=True)
                bits[miss] = self._lookup(distinct, top)[back]
        elif len(data):
            full[:] = False
        for length in range(1, top):
            at = np.flatnonzero(place == length - 1) if len(have) else np.zeros(0, np.int64)
            if len(at):
                bits[at] = self._lookup(_keys(data, length)[at - length + 1], length)
        if not len(have):
            bits[:] = 8.0
        total = np.zeros((len(data) + 1, k))
        np.cumsum(bits, 0, dtype=np.float64, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]


def _bounds(rows: DataFrame, most: int) -> dict[str, tuple[int, int]]:
    """For each language how many rows of the ``most`` with the least hash there are, and the last one's hash."""
    first = rows.select("lang", "h", "i").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "i"))).where(F.col("r") <= most)
    return {r["lang"]: (r["n"], r["most"]) for r in first.groupBy("lang").agg(F.count("*").alias("n"), F.max("h").alias("most")).collect()}


def train(docs: DataFrame, order: int = 3, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Context trees of every non-null language of ``docs``.

    Learns from at most ``per_language`` rows of each language, those with the least hash of their id: a bounded
    sample, so the frozen trees stay small enough to ship to every task whatever the corpus holds.
    """
    lean(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("i"))
    # hashes spread evenly, so of n rows the wanted ones nearly surely lie below this share; if not, all are ordered
    total = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = {lang: (per_language + 8 * per_language**0.5 + 16) / n for lang, n in total.items()}
    near = F.lit(False)
    for lang, part in share.items():
        near |= (F.col("lang") == lang) & (F.col("h") <= (int(-(2**63) + part * 2**64) if part < 1 else 2**63 - 1))
    bounds = _bounds(rows.where(near), per_language)
    if any(n < min(per_language, total[lang]) for lang, (n, _) in bounds.items()) or set(bounds) != set(total):
        bounds = _bounds(rows, per_language)
    langs = sorted(bounds)
    if not langs:
        return ContextTrees([], {}, order)
    near = F.lit(False)
    for lang, (_, most) in bounds.items():
        near |= (F.col("lang") == lang) & (F.col("h") <= most)
    grams = rows.where(near).select("lang", "text").mapInArrow(_counts(order), "lang string, length int, key long, n long").groupBy("length", "key", "lang").agg(F.sum("n").alias("n")).toArrow()
    lang = np.searchsorted(np.array(langs, dtype=object), np.array(grams.column("lang").to_pylist(), dtype=object)) if grams.num_rows else np.zeros(0, np.int64)
    length, key, n = (grams.column(c).to_numpy() for c in ("length", "key", "n"))
    counts = {}
    for size in range(1, order + 2):
        own = length == size
        keys, at = np.unique(key[own].view(np.uint64), return_inverse=True)
        table = np.zeros((len(keys), len(langs)))
        np.add.at(table, (at, lang[own]), n[own])
        counts[size] = keys, table
    return ContextTrees(langs, counts, order)


def _judge(held):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trees = held.value
        for texts, letters in batches:
            lang, score = [], []
            for batch in sliced([pa.RecordBatch.from_arrays([texts, letters], ["text", "letter"])], SLICE_BYTES // 4):
                data, offsets = common.buffers(batch.column(0))
                letter = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
                if trees.langs:
                    bits = trees.lengths(data, offsets)
                    best = bits.argmin(1)
                    likely = 1 / np.exp2(np.maximum(-1000.0, bits.min(1)[:, None] - bits)).sum(1)
                else:
                    best, likely, letter = np.zeros(len(letter), np.int64), np.zeros(len(letter)), np.zeros(len(letter), bool)
                lang += [trees.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist())]
                score.append(np.where(letter, likely, 0.0))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate([np.zeros(0), *score]))], ["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")


def has_letter(c: Column) -> Column:
    return F.coalesce(c.rlike(LETTER), F.lit(False))


def predict(docs: DataFrame, trees: ContextTrees, row: Column, text_col: str = "text") -> DataFrame:
    """_row (the value of ``row``, as a struct), lang_pred and score, the posterior probability of that language.

    A text that is null or has no letter gets ``und`` and score 0, as does every text if no language was learnt. Ties go
    to the language that sorts first. Repeated rows are judged each for itself; an empty table gives no rows. Only texts
    go to Python; the rest of a row stays where it is.
    """
    lean(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trees)
    text = F.col(text_col).cast("string")
    rows = docs.select(row.alias("_row"), _judge(held)(text, has_letter(text)).alias("_verdict"))
    return rows.select("_row", "_verdict.lang_pred", "_verdict.score")
