"""Substring dedup by sliding sentence spans.

A sentence is a longest run matching ``[^.!?\\n]+[.!?]*`` with its words, between blanks, in their order. One of more than
``long`` words, as in text without sentence marks, is cut after each word whose MD5 (A-Z in lower case) is least among
the four words on either side: equal passages are cut alike wherever they stand. From every sentence the shortest run of
at least two sentences and ``words`` words is hashed, A-Z in lower case; all runs of all texts meet by hash, the first
by (id, place) stays, and sentences covered by any later run are removed.

Texts are dealt to blocks of bounded size. A block sends each different run once, with the least id that has it, to a
hash range, which answers with one bit a run: whether the block has the first of all. So a passage that most texts share
costs a row of a block, not one of a text, wherever it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trellisgraph.llm import common, exchange
from trellisgraph.llm.common import BLOCK_BYTES, LOWER, SPACE, blocked, hash_ranges, lean, numbers, plain, signed, spread, steps, text_bytes, unpacked, unsigned, walked
from trellisgraph.llm.exchange import FAN, Route, route

_MARK = np.zeros(256, bool)
_MARK[[33, 46, 63]] = True
_REACH = 4


class Sentences:
    """The words of some texts, the sentences they make, and the runs that start at sentences."""

    def __init__(self, column: pa.Array, words: int, long: int):
        data, offsets = common.buffers(column)
        self.data, n = data, len(data)
        at, line, starts = np.arange(n), data == 10, np.zeros(n + 1, bool)
        starts[offsets[:-1]] = True
        starts = starts[:n]
        body = ~(_MARK[data] | line)
        head = body.copy()
        head[1:] &= ~body[:-1] | starts[1:]
        sentence = np.cumsum(head) - 1
        # marks belong to the sentence before them unless a line or a text begins in between
        since = np.append(np.flatnonzero(head), 0)[sentence]
        inside = (sentence >= 0) & ~line & (since >= np.maximum.accumulate(np.where(line | starts, at, 0)))
        letter = inside & ~SPACE[data]
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1] | head[1:] | starts[1:]
        last[:-1] &= ~letter[1:] | head[1:] | starts[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        low = LOWER[data]
        print_ = common.span_hashes(low, self.start, self.end)
        of = sentence[self.start]
        cut = np.ones(len(of), bool)
        cut[1:] = of[1:] != of[:-1]
        size = np.diff(np.append(np.flatnonzero(cut), len(of)))
        wide = np.flatnonzero(np.repeat(size, size) > long)
        if len(wide):
            cut[wide[1:]] |= self._cuts(low, wide, of)
        self.first = np.flatnonzero(cut)
        self.stop = np.append(self.first[1:], len(of)).astype(np.int64)
        self.texts = len(offsets) - 1
        self.doc = np.searchsorted(offsets, self.start[self.first], "right") - 1
        to = np.maximum(np.searchsorted(self.stop, self.first + words), np.arange(len(self.first)) + 1)
        fits = np.flatnonzero(to < len(self.first))
        fits = fits[self.doc[to[fits]] == self.doc[fits]]
        #: of each run its first and last sentence and its hash
        self.a, self.b = fits, to[fits]
        self.key = common.span_hashes(print_, self.first[self.a], self.stop[self.b])

    def _cuts(self, low: np.ndarray, wide: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether each word of long sentences but the first starts a new one: the word before has the least MD5 around."""
        raw, known = low.tobytes(), {}

        def rank(word: bytes) -> int:
            if word not in known:
                known[word] = int.from_bytes(hashlib.md5(word).digest()[:8], "big")
            return known[word]

        h = np.array([rank(raw[a:b]) for a, b in zip(self.start[wide].tolist(), self.end[wide].tolist())], np.uint64)
        of = of[wide]
        least = h.copy()
        for k in range(1, _REACH + 1):
            same = of[k:] == of[:-k]
            least[k:][same] = np.minimum(least[k:][same], h[:-k][same])
            least[:-k][same] = np.minimum(least[:-k][same], h[k:][same])
        return (h == least)[:-1] & (of[1:] == of[:-1])

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Each text's words of sentences that stay, parted by one blank."""
        stay = np.repeat(~gone, self.stop - self.first)
        start, size = self.start[stay], (self.end - self.start)[stay]
        place = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        out[spread(place, size)] = self.data[spread(start, size)]
        doc = np.repeat(self.doc, self.stop - self.first)[stay]
        count = np.bincount(doc, weights=size + 1, minlength=self.texts).astype(np.int64)
        ends = np.cumsum(count)
        raw = out.tobytes()
        return [raw[b - n : b - 1] if n else b"" for b, n in zip(ends.tolist(), count.tolist())]


class Block:
    """The sentences of a block, slice by slice, and its runs: place of the text, and number among the different ones."""

    def __init__(self, docs: pa.Table, words: int, long: int):
        self.batches = unpacked(docs)
        self.slices = [Sentences(b.column(2), words, long) for b in self.batches]
        none = np.zeros(0, np.int64)
        ids = np.concatenate([none, *(np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64) for b in self.batches)])
        self.null = np.concatenate([np.zeros(0, bool), *(np.asarray(b.column(0).is_null()) for b in self.batches)])
        before = np.cumsum([0, *(s.texts for s in self.slices)])
        doc = np.concatenate([none, *(s.doc[s.a] + n for s, n in zip(self.slices, before))]).astype(np.int64)
        key = np.concatenate([np.zeros(0, np.uint64), *(s.key for s in self.slices)])
        self.run = np.flatnonzero(~self.null[doc])
        doc, key = doc[self.run], key[self.run]
        self.keys, self.number = np.unique(key, return_inverse=True)
        # the first run of each key: least id, then first in the block
        order = np.lexsort((np.arange(len(doc)), ids[doc], self.number))
        at = np.flatnonzero(np.diff(self.number[order], prepend=-1))
        self.firsts = order[at]
        self.least = ids[doc[self.firsts]]

    def gone(self, own: np.ndarray) -> list[np.ndarray]:
        """For each slice which sentences go; own: whether the block has the first of all runs of a key."""
        late = np.ones(len(self.number), bool)
        late[self.firsts[own]] = False
        run = np.zeros(sum(len(s.a) for s in self.slices), bool)
        run[self.run] = late
        out = []
        for s, hit in zip(self.slices, np.split(run, np.cumsum([len(s.a) for s in self.slices])[:-1])):
            change = np.zeros(len(s.first) + 1, np.int64)
            np.add.at(change, s.a[hit], 1)
            np.add.at(change, s.b[hit] + 1, -1)
            out.append(np.cumsum(change)[:-1] > 0)
        return out


def _ask(words: int, long: int, way: Route):
    """A block's different runs with the least id of each, a message to each hash range that it has runs for."""

    def run(docs: pa.Table) -> pa.Table:
        block = Block(docs, words, long)
        used, (cut,) = exchange.cuts(way.ranges, block.keys)
        asked = [plain(*steps(block.keys[i:j]), signed(block.least[i:j])) for i, j in zip(cut, cut[1:])]
        return exchange.posted(docs.column("block")[0].as_py(), used, asked, way)

    return run


def _owners(block: np.ndarray, values: list[bytes]) -> list[bytes]:
    """For each block and key: 1 if no other block has a smaller id with it, or the same id and a lower number."""
    asked = [numbers(x) for x in values]
    keys = [walked(a[0], a[1]) for a in asked]
    size = [len(k) for k in keys]
    key, least = np.concatenate(keys), unsigned(np.concatenate([a[2] for a in asked]))
    order = np.lexsort((np.repeat(block, size), least, key))
    own = np.zeros(len(key), np.int64)
    own[order[np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))]] = 1
    return [plain(exchange.check(k), x) for k, x in zip(keys, np.split(own, np.cumsum(size)[:-1]))]


def _results(words: int, long: int, ranges: int, kind: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs, words, long)
        used, (cut,) = exchange.cuts(ranges, block.keys)
        checks = {r: int(exchange.check(block.keys[i:j])[0]) for r, i, j in zip(used.tolist(), cut, cut[1:])}
        own = np.concatenate([np.zeros(0, np.uint64), *(a[0] for a in exchange.answers(answers, checks))]) > 0
        out = []
        for batch, s, gone in zip(block.batches, block.slices, block.gone(own)):
            count = [np.bincount(x, minlength=s.texts).astype(np.int64) for x in (s.doc, s.doc[gone])]
            out.append(pa.table({"doc_id": batch.column(0).cast(kind), "n_sentences": count[0], "n_removed": count[1], "kept": pa.array([x.decode() for x in s.kept(gone)], pa.string())}))
        return pa.concat_tables(out)

    return run


def deduplicated(docs: DataFrame, words: int = 20, long: int = 25, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept (the words of the sentences that stay, parted by a blank) for every row.

    A null or blank text has no sentence; texts of one sentence, or of fewer than ``words`` words, have no run. A null
    id takes no part and keeps everything. Ids are whole numbers, of either sign. Rows that repeat an id are judged each
    by its own text; of equal ones the first in the input stays. Other columns are not read. Runs count as equal if 64
    bits of hashes are. ``block_bytes`` bounds the text that one task holds; one longer text is held alone.
    ``fan`` bounds the rows that a block sends in one hop.
    """
    lean(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    way = route(hash_ranges(text_bytes(rows), block_bytes), fan)
    texts = blocked(rows, block_bytes)
    asked = exchange.arrived(texts.groupBy("block"), _ask(words, long, way), way)
    owners = exchange.answered(asked, _owners, way)
    return texts.groupBy("block").cogroup(owners.groupBy("block")).applyInArrow(_results(words, long, way.ranges, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_sentences long, n_removed long, kept string")


def removed(docs: DataFrame, words: int = 20, long: int = 25, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept_sha256 for every row."""
    return deduplicated(docs, words, long, block_bytes, id_col, text_col, fan).select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*'), lambda s: trim(s, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), lambda s: s <> '') AS s FROM documents),
x AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS no FROM d),
w AS (SELECT doc_id, no, s, string_split_regex(s, '[ \t\v\f\r]+') AS w FROM x),
h AS (SELECT doc_id, no, s, w, list_transform(w, lambda y: md5(translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS h FROM w),
c AS (SELECT doc_id, no, s, w, list_filter(range(1, len(w)), lambda k: len(w) > 25 AND h[k] = list_min(h[greatest(1, k - 4):k + 4])) AS cut FROM h),
e AS (SELECT doc_id, no, s, w, list_append(cut, len(w)) AS e FROM c),
o AS (SELECT doc_id, no, list_transform(e, lambda k, i: array_to_string(w[CASE WHEN i = 1 THEN 1 ELSE e[i - 1] + 1 END:k], ' ')) AS o FROM e),
g AS (SELECT doc_id, flatten(list(o ORDER BY no)) AS s FROM o GROUP BY doc_id),
p AS (SELECT doc_id, list_transform(s, lambda y: translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS p, list_transform(s, lambda y: len(string_split_regex(y, '[ \t\v\f\r]+'))) AS c FROM g),
a AS (SELECT doc_id, p, c, unnest(generate_series(1, len(p))) AS pos FROM p),
r AS (SELECT doc_id, p, pos, list_filter(range(2, 21), lambda n: pos + n - 1 <= len(p) AND list_sum(c[pos:pos + n - 1]) >= 20)[1] AS n FROM a),
t AS (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY array_to_string(p[pos:pos + n - 1], ' ') ORDER BY doc_id, pos) AS k FROM r WHERE n IS NOT NULL),
l AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS i FROM t WHERE k > 1) GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(g.s, []) AS s, gone FROM d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)),
k AS (SELECT doc_id, s, list_filter(s, lambda y, i: NOT coalesce(list_contains(gone, i), false)) AS kept FROM f)
SELECT doc_id, len(s) AS n_sentences, len(s) - len(kept) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
