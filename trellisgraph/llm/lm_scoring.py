"""Scoring with a weighted backoff automaton over word trigrams.

Smoothing is by a prior of ``prior`` tokens: p(w | h) = (c(hw) + prior * p(w | h')) / (c(h) + prior), h' being h without its
first word, and p(w) = (c(w) + add) / (N + add * (V + 1)). As an automaton: every history of one or two words seen in
training is a state; a seen n-gram is an arc out of its history with its finished log probability, to the longest history
it ends in; a state's failure arc, to the state of h', weighs log10(prior / (c(h) + prior)) and is taken where no arc fits.
The state without history has an arc for every word. Texts are read once from left to right, the state being carried
from word to word. As two words settle the state, long texts are read in stretches side by side, each led in by the
words before it.

Counts cover all training texts and never meet in one place. Texts are dealt to blocks of bounded size. A block sends
each of its n-grams once, with its count, to a hash range: trigrams travel with the bigram they end in, so a key is
sent once. A range adds up and answers every block with the totals in the order asked. Hot n-grams come once a block.
From these totals a block builds the states and arcs that its texts can reach, and reads them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trellisgraph.llm import common, exchange
from trellisgraph.llm.common import BLOCK_BYTES, blocked, hash_ranges, lean, mixed, numbers, plain, steps, text_bytes, unpacked, walked
from trellisgraph.llm.exchange import FAN, Route, route

_START, _END = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
_PAIR = np.uint64(0xA0761D6478BD642F)
#: Bits that tell apart the words before one bigram.
_BEFORE = np.uint64(40)
#: Words that one stretch of a text reads.
STRETCH = 256


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the number of each key among them."""
    order = np.argsort(key)
    ordered = key[order]
    head = np.ones(len(key), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(head, dtype=np.int32) - 1
    return ordered[head], number


class Grams:
    """The tokens of some texts, each with the number of its word, of its bigram and of its trigram among all of them.

    A text's first token has the bigram after a start mark and no trigram (-1). ``first`` says where texts start.
    """

    def __init__(self, batches: list[pa.RecordBatch], column: int):
        hashes, counts = [], []
        for batch in batches:
            data, offsets = common.buffers(batch.column(column))
            doc, _, _, h = common.words(data, offsets)
            n = np.bincount(doc, minlength=batch.num_rows) + 1
            end = np.cumsum(n)
            word = np.empty(int(end[-1]) if len(end) else 0, np.uint64)
            word[np.arange(len(h)) + doc] = h
            word[end - 1] = _END
            hashes.append(word)
            counts.append(n)
        word = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.size = np.concatenate([np.zeros(0, np.int64), *counts])
        self.first = np.cumsum(self.size) - self.size
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.first] = _START
        self.words, self.word = _numbered(mixed(word + np.uint64(0x2545F4914F6CDD1D)))
        self.pairs, self.pair = _numbered(mixed(before * _PAIR + word))
        longer = np.ones(len(word), bool)
        longer[self.first] = False
        at = np.flatnonzero(longer)
        code = self.pair[at].astype(np.uint64) << _BEFORE | mixed(before[at - 1]) >> (np.uint64(64) - _BEFORE)
        codes, number = _numbered(code)
        self.triple = np.full(len(word), -1, np.int32)
        self.triple[at] = number
        self.pair_of_triple = (codes >> _BEFORE).astype(np.int32)
        self.before = codes & ((np.uint64(1) << _BEFORE) - np.uint64(1))

    def counts(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each word, pair and triple is in texts to learn from."""
        on = np.repeat(learn, self.size)
        triple = self.triple[on]
        return np.bincount(self.word[on], minlength=len(self.words)), np.bincount(self.pair[on], minlength=len(self.pairs)), np.bincount(triple[triple >= 0], minlength=len(self.before))

    def cuts(self, ranges: int):
        """The hash ranges of these n-grams, and the boundaries of each in words, pairs and triples."""
        used, (words, pairs) = exchange.cuts(ranges, self.words, self.pairs)
        return used, words, pairs, np.searchsorted(self.pair_of_triple, pairs)


def _learn(batches) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *(np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool) for b in batches)])


def _ask(way: Route):
    """A block's n-grams and their counts, a message to each hash range that it has some for."""

    def run(docs: pa.Table) -> pa.Table:
        texts = unpacked(docs)
        grams = Grams(texts, 2)
        one, two, three = grams.counts(_learn(texts))
        kinds = np.bincount(grams.pair_of_triple, minlength=len(grams.pairs))
        used, u, b, t = grams.cuts(way.ranges)
        asked = [
            plain(*steps(grams.words[u[r] : u[r + 1]]), one[u[r] : u[r + 1]], *steps(grams.pairs[b[r] : b[r + 1]]), two[b[r] : b[r + 1]], kinds[b[r] : b[r + 1]], grams.before[t[r] : t[r + 1]], three[t[r] : t[r + 1]])
            for r in range(len(used))
        ]
        return exchange.posted(docs.column("block")[0].as_py(), used, asked, way)

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sums by key; for each list its totals in its order; and the number of each key of all lists."""
    key, number = _numbered(np.concatenate(keys))
    total = np.bincount(number, weights=np.concatenate(counts).astype(np.float64), minlength=len(key)).astype(np.int64)
    return total, np.split(total[number], np.cumsum([len(k) for k in keys])[:-1]), number


def _answer(_: np.ndarray, values: list[bytes]) -> list[bytes]:
    """The totals of one hash range for each block that asked."""
    asked = [numbers(x) for x in values]
    words, pairs = [walked(a[0], a[1]) for a in asked], [walked(a[3], a[4]) for a in asked]
    _, one, _ = _totals(words, [a[2] for a in asked])
    _, two, number = _totals(pairs, [a[5] for a in asked])
    pair = np.repeat(number.astype(np.uint64), np.concatenate([a[6] for a in asked]).astype(np.int64))
    cut = np.cumsum([len(a[7]) for a in asked])[:-1]
    _, three, _ = _totals([k << _BEFORE | a[7] for k, a in zip(np.split(pair, cut), asked)], [a[8] for a in asked])
    return [plain(exchange.check(w, p, a[7]), *x) for w, p, a, x in zip(words, pairs, asked, zip(one, two, three))]


def _sums(mail: pa.Table) -> pa.Table:
    """How many tokens and different words of one hash range are in texts to learn from."""
    asked = [numbers(x, 3) for x in exchange.values_at(mail)]
    words, _, _ = _totals([walked(a[0], a[1]) for a in asked], [a[2] for a in asked])
    return pa.table({"tokens": pa.array([int(words.sum())], pa.int64()), "kinds": pa.array([int((words > 0).sum())], pa.int64())})


class Automaton:
    """States, arcs and failure arcs that the texts of ``grams`` can reach.

    State 0 has no history, then come the one-word histories (the last of them is the start of a text) and the two-word
    ones, in the order of ``grams``. An arc belongs to a word, pair or triple; one not seen in training has -1 as its
    source, which no text is ever in.
    """

    def __init__(self, grams: Grams, one: np.ndarray, two: np.ndarray, three: np.ndarray, tokens: int, kinds: int, prior: float, add: float):
        singles, pairs = len(one), len(two)
        end = np.searchsorted(grams.words, mixed(np.array([_END + np.uint64(0x2545F4914F6CDD1D)], np.uint64)))[0]
        texts = one[end] if end < singles else 0
        # the word each pair ends in, the history it starts with, and the pair each triple starts with
        word_of, start_of = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
        word_of[grams.pair] = grams.word
        start_of[grams.pair[1:]] = grams.word[:-1]
        start_of[grams.pair[grams.first]] = singles
        start_pair = np.zeros(len(three), np.int32)
        at = np.flatnonzero(grams.triple >= 0)
        start_pair[grams.triple[at]] = grams.pair[at - 1]
        history = np.append(one, texts)
        with np.errstate(divide="ignore"):
            lower = np.log10(prior) - np.log10(np.concatenate([history, two]) + prior)
        self.weight = np.concatenate([[0.0], lower])
        self.fail = np.concatenate([np.zeros(1 + singles + 1, np.int32), 1 + word_of])
        p1 = (one + add) / (tokens + add * (kinds + 1))
        p2 = (two + prior * p1[word_of]) / (history[start_of] + prior)
        p3 = (three + prior * p2[grams.pair_of_triple]) / (two[start_pair] + prior)
        self.log1, self.log2, self.log3 = np.log10(p1), np.log10(p2), np.log10(p3)
        self.from2 = np.where(two > 0, 1 + start_of, -1)
        self.from3 = np.where(three > 0, 2 + singles + start_pair, -1)
        ends = np.arange(singles) == end
        self.to1 = np.where((one > 0) & ~ends, 1 + np.arange(singles, dtype=np.int32), 0)
        self.to2 = 2 + singles + np.arange(pairs, dtype=np.int32)
        self.to3 = self.to2[grams.pair_of_triple]
        self.start = 1 + singles if texts else 0
        self.long = 2 + singles

    def step(self, state, word, pair, triple):
        """(log10 probability, next state) of reading one more word in each of many texts."""
        arc3 = (triple >= 0) & (self.from3[triple] == state) if len(self.from3) else np.zeros(len(state), bool)
        falls = (state >= self.long) & ~arc3
        fell = np.where(falls, self.weight[state], 0.0)
        state = np.where(falls, self.fail[state], state)
        arc2 = ~arc3 & (self.from2[pair] == state)
        fell += np.where(arc3 | arc2, 0.0, self.weight[state])
        log = np.where(arc2, self.log2[pair], self.log1[word])
        to = np.where(arc2, self.to2[pair], self.to1[word])
        if len(self.from3):
            log, to = np.where(arc3, self.log3[triple], log), np.where(arc3, self.to3[triple], to)
        return log + fell, to

    def read(self, grams: Grams) -> np.ndarray:
        """The log10 probability of every token; stretches of texts are read side by side, longest first."""
        out = np.zeros(len(grams.word))
        pieces = -(-grams.size // STRETCH)
        text = np.repeat(np.arange(len(pieces)), pieces)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        stop = grams.first[text] + np.minimum(place + STRETCH, grams.size[text])
        begin = grams.first[text] + place
        lead = np.where(place > 0, begin - 2, begin)  # two words settle the state
        order = np.argsort(-(stop - lead), kind="stable")
        begin, stop, lead = begin[order], stop[order], lead[order]
        state = np.where(lead == begin, self.start, 0)
        many = np.searchsorted(-(stop - lead), -np.arange(STRETCH + 2), "left")
        for t, n in enumerate(many.tolist()):
            if not n:
                break
            at = lead[:n] + t
            log, state = self.step(state[:n], grams.word[at], grams.pair[at], grams.triple[at])
            out[at] = log  # those of a lead-in are written again by the stretch before, which reads them last
        return out


def _score(prior: float, add: float, ranges: int, kind: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = unpacked(docs)
        grams = Grams(texts, 2)
        used, u, b, t = grams.cuts(ranges)
        checks = {r: int(exchange.check(grams.words[u[i] : u[i + 1]], grams.pairs[b[i] : b[i + 1]], grams.before[t[i] : t[i + 1]])[0]) for i, r in enumerate(used.tolist())}
        parts = exchange.answers(answers, checks)
        one, two, three = (np.concatenate([np.zeros(0, np.uint64), *(p[k] for p in parts)]).astype(np.int64) for k in range(3))
        tokens, kinds = answers.column("sums")[0].as_py() if answers.num_rows else (0, 0)
        model = Automaton(grams, one, two, three, tokens, kinds, prior, add)
        doc = np.repeat(np.arange(len(grams.size)), grams.size)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(grams.size))
        values = [grams.size, total(one[grams.word] > 0).astype(np.int64), np.full(len(grams.size), tokens, np.int64), total(model.log1[grams.word]), total(model.read(grams))]
        ids = pa.concat_arrays([b.column(0) for b in texts]) if texts else pa.array([], kind)
        return pa.table({"doc_id": ids.cast(kind), "held_out": pa.array(~_learn(texts))} | {c: pa.array(x, t) for (c, t), x in zip(_NUMBERS.items(), values)})

    return run


_NUMBERS = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def scored(docs: DataFrame, learn: Column, prior: float = 64.0, add: float = 0.1, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; it learns where ``learn``.

    A null text is empty and has only its end token; a null id is kept. Rows that repeat an id are scored and counted
    each. Without training rows N and V are 0 and every token has the same probability. An empty table gives no rows.
    Other columns are not read. ``block_bytes`` bounds the text that one task holds; one longer text is held alone.
    ``fan`` bounds the rows that a block sends in one hop.
    """
    spark = docs.sparkSession
    lean(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    way = route(hash_ranges(text_bytes(rows), block_bytes), fan)
    texts = blocked(rows, block_bytes)
    asked = exchange.arrived(texts.groupBy("block"), _ask(way), way)
    sums = asked.groupBy("to").applyInArrow(_sums, "tokens long, kinds long").agg(F.array(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds")]).alias("sums"))
    answers = exchange.answered(asked, _answer, way).withColumn("sums", sums.scalar())
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(prior, add, way.ranges, arrow), schema)
