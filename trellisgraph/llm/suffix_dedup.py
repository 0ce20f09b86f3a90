"""Exact substring dedup: every byte covered by a 50-byte string that also starts in an earlier document goes.

Suffix sorting is by linear grouping (Baier 2016): suffixes are grouped by their Lyndon prefix, groups are processed from
the highest down, previous-smaller pointers say whose prefix a group's members extend, and the final order inside groups
is emitted in one sweep; no ranks are renamed recursively.

To have equal strings meet, windows of ``length`` bytes are dealt by their minimizer: the least hash of the ``seed``-byte
strings in a window. Equal windows have equal minimizers, and consecutive windows with one minimizer travel as one
segment. Texts are dealt to blocks of bounded size, and each step asks hash ranges, which answer every block:

1. Equal texts become one class; only the first is looked at, the others go as a whole.
2. A block sends its distinct minimizers with the number of its texts and of its different segments that have each; a
   range answers whether a minimizer is in one text only (it cannot hold a repeat), in several, or in more than ``crowd``
   segments as well.
3. A block sends each different segment with a shared minimizer once, with its least document. Of a crowded minimizer
   it sends single windows instead, which spread over all ranges by their own hash. Where a range has different segments
   of a minimizer, parts whose strings of half the length no other segment has are cut away, the suffix array of the rest
   is built, and each run of suffixes with ``length`` equal bytes tells its first document. Every block learns the
   least document of each window it sent.
4. A block removes from its texts what a smaller document has, in every place where they hold it.

Answers are written before the next step, and the shuffle files of a step go with it. Step 3 moves the most bytes, once in
each hop; it runs in as many rounds as there are hops, each for an equal share of the ranges, so that the bytes on disk at
one time do not grow with the hops.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm import common, exchange
from trellisgraph.llm.common import BLOCK_BYTES, dealt, hash_ranges, lean, mixed, numbers, plain, settled, signed, spread, steps, unpacked, unsigned, walked
from trellisgraph.llm.exchange import FAN, Route, route

_WINDOW = np.uint64(0x452821E638D01377)


def suffix_array(text) -> list[int]:
    """The suffix array of a sequence of small integers, by linear grouping."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # Groups are intervals of ``order``; lo[i] is the start of the interval of suffix i's group, size[lo] its length.
    order = sorted(range(n), key=text.__getitem__)
    at, lo, size = [0] * n, [0] * n, [0] * n
    start = 0
    for p, i in enumerate(order):
        at[i] = p
        if text[i] != text[order[start]]:
            start = p
        lo[i] = start
        size[start] += 1
    before = [-1] * n
    end = n
    while end:
        first = lo[order[end - 1]]
        group = order[first:end] if end - first == 1 else sorted(order[first:end])
        end = first
        hung: dict[int, int] = {}
        for i in group:
            p = i - 1
            while p >= 0 and lo[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                hung[p] = hung.get(p, 0) + 1
        if not hung:
            continue
        # Those that more members hang on are higher; each lot leaves its group upwards, as a group of its own.
        if len(group) == 1:
            lots = [list(hung)]
        else:
            by: dict[int, list[int]] = {}
            for p, k in hung.items():
                by.setdefault(k, []).append(p)
            lots = [by[k] for k in sorted(by, reverse=True)]
        for lot in lots:
            moved: dict[int, int] = {}
            for p in lot:
                home = lo[p]
                size[home] -= 1
                to = home + size[home]
                other, here = order[to], at[p]
                order[here], order[to] = other, p
                at[other], at[p] = here, to
                moved[home] = to
            for p in lot:
                home = lo[p]
                if moved[home] != home:
                    new = moved[home]
                    lo[p] = new
                    size[new] += 1
                else:
                    size[home] += 1
    # In order of suffixes, place those whose Lyndon prefix ends where the suffix just emitted starts.
    out, spot, done = [0] * n, list(range(n)), bytearray(n)
    p = n - 1
    while p >= 0:
        home = lo[p]
        out[spot[home]] = p
        spot[home] += 1
        done[p] = 1
        p = before[p]
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            home = lo[p]
            out[spot[home]] = p
            spot[home] += 1
            done[p] = 1
            p = before[p]
    return out


def first_documents(segments: list[bytes], firsts: list[int], length: int) -> list[np.ndarray]:
    """For every window of every segment the least document that has it; firsts: the least document of each segment."""
    text = b"\0".join(segments) + b"\0" if all(b"\0" not in s for s in segments) else None
    if text is None:
        text = [x for s in segments for x in [*(b + 1 for b in s), 0]]
    order = suffix_array(text)
    size = [len(s) for s in segments]
    begin = np.concatenate([[0], np.cumsum(np.array(size) + 1)[:-1]])
    owner = np.repeat(np.arange(len(size)), np.array(size) + 1)
    out = [np.full(max(0, s - length + 1), f, np.int64) for s, f in zip(size, firsts)]
    place = np.arange(len(owner)) - begin[owner]
    whole = place + length <= np.array(size)[owner]
    raw = bytes(text) if isinstance(text, bytes) else text
    run: list[int] = []

    def close() -> None:
        if len(run) > 1:
            least = min(firsts[owner[i]] for i in run)
            for i in run:
                out[owner[i]][place[i]] = least

    last = None
    for i in order:
        if not whole[i]:
            continue
        now = raw[i : i + length]
        if now != last:
            close()
            run = []
            last = now
        run.append(i)
    close()
    return out


def _minimizers(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """(text, first window, end window, minimizer) of every run of at most length - seed + 1 windows with one minimizer."""
    n = len(data) - seed + 1
    wide = length - seed + 1
    if n < wide:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n)
    h = common.span_hashes(data, at, at + seed)
    # sliding minimum over ``wide`` hashes, from running minima of blocks
    pad = -n % wide
    blocks = np.concatenate([h, np.full(pad, ~np.uint64(0), np.uint64)]).reshape(-1, wide)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - wide + 1
    least = np.minimum(right[:windows], left[wide - 1 : wide - 1 + windows])
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)[:windows]
    inside = np.arange(windows) + length <= offsets[1:][doc]
    head = inside.copy()
    head[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    tail = inside.copy()
    tail[:-1] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[1:]
    first, last = np.flatnonzero(head), np.flatnonzero(tail) + 1
    key = mixed(least[first])  # least hashes are small ones; mixed again they spread over all ranges
    # a text of short periods has one minimizer throughout; its segments are cut to the usual length, and become equal
    n = -(-(last - first) // wide)
    part = spread(np.zeros(len(n), np.int64), n)
    first, last = np.repeat(first, n) + part * wide, np.minimum(np.repeat(first, n) + (part + 1) * wide, np.repeat(last, n))
    return doc[first], first - offsets[doc[first]], last - offsets[doc[first]], np.repeat(key, n)


class Texts:
    """The texts of a block and their segments: text number, first window, end window, minimizer."""

    def __init__(self, docs: pa.Table, length: int, seed: int, piece: int = 1 << 20):
        batches = unpacked(docs)
        both = [common.buffers(b.column(1)) for b in batches]
        self.ids = np.concatenate([np.zeros(0, np.int64), *(np.asarray(b.column(0).to_numpy(), np.int64) for b in batches)])
        self.data = np.concatenate([np.zeros(0, np.uint8), *(d for d, _ in both)])
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(o) for _, o in both)]))])
        cut = [0, *(np.flatnonzero(np.diff(self.offsets[1:] // piece)) + 1).tolist(), len(self.ids)] if len(self.ids) else [0]
        found = []
        for i, j in zip(cut, cut[1:]):
            o = self.offsets[i : j + 1]
            doc, first, last, key = _minimizers(self.data[o[0] : o[-1]], o - o[0], length, seed)
            found.append((doc + i, first, last, key))
        self.doc, self.first, self.last, self.key = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, np.int64, np.uint64), zip(*found) if found else ((),) * 4))

    def prints(self, start: np.ndarray, size: np.ndarray, reach: int = 1 << 20) -> np.ndarray:
        """Hashes of data[start : start + size], looking at about ``reach`` bytes at once."""
        order = np.argsort(start, kind="stable")
        cut = np.flatnonzero(np.diff(start[order] // reach)) + 1
        out = np.empty(len(start), np.uint64)
        for own in np.split(order, cut):
            if len(own):
                a, b = start[own], start[own] + size[own]
                low = int(a[0])
                out[own] = common.span_hashes(self.data[low : int(b.max())], a - low, b - low)
        return out


def _ask(length: int, seed: int, way: Route):
    """A block's distinct minimizers, for each how many texts and how many different segments have it, by range."""

    def run(docs: pa.Table) -> pa.Table:
        texts = Texts(docs, length, seed)
        size = texts.last - texts.first + length - 1
        print_ = texts.prints(texts.offsets[texts.doc] + texts.first, size)
        counts = []
        for other in (texts.doc, print_):
            order = np.lexsort((other, texts.key))
            key, other = texts.key[order], other[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            fresh = head.copy()
            fresh[1:] |= other[1:] != other[:-1]
            counts.append(np.bincount((np.cumsum(head) - 1)[fresh]))
        key = key[head]
        used, (cut,) = exchange.cuts(way.ranges, key)
        asked = [plain(*steps(key[i:j]), *(n[i:j] for n in counts)) for i, j in zip(cut, cut[1:])]
        return exchange.posted(docs.column("block")[0].as_py(), used, asked, way)

    return run


def _known(crowd: int):
    """For each block and minimizer: 0 if one text of all has it, 1 if several, 2 if with more than ``crowd`` segments."""

    def run(_: np.ndarray, values: list[bytes]) -> list[bytes]:
        asked = [numbers(x) for x in values]
        keys = [walked(a[0], a[1]) for a in asked]
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        texts, segments = (np.bincount(number, weights=np.concatenate([a[k] for a in asked]).astype(np.float64)) for k in (2, 3))
        kind = ((texts > 1).astype(np.int64) + ((texts > 1) & (segments > crowd)))[number]
        return [plain(exchange.check(k), x) for k, x in zip(keys, np.split(kind, np.cumsum([len(k) for k in keys])[:-1]))]

    return run


def _pieces(length: int, seed: int, way: Route, low: int, high: int):
    """Different pieces of a block that may hold a repeat, a message to each hash range from ``low`` to below ``high``; and,
    with the first ranges, a note where all pieces are, which comes back with the answers."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        texts = Texts(docs, length, seed)
        keys, number = np.unique(texts.key, return_inverse=True)
        used, (cut,) = exchange.cuts(way.ranges, keys)
        checks = {r: int(exchange.check(keys[i:j])[0]) for r, i, j in zip(used.tolist(), cut, cut[1:])}
        kind = np.concatenate([np.zeros(0, np.uint64), *(a[0] for a in exchange.answers(answers, checks))])
        kind = kind[number]
        start = texts.offsets[texts.doc] + texts.first
        whole, crowded = kind == 1, kind == 2
        n = (texts.last - texts.first)[crowded]
        single = spread(start[crowded], n)
        doc = np.concatenate([texts.doc[whole], np.repeat(texts.doc[crowded], n)])
        size = np.concatenate([(texts.last - texts.first)[whole] + length - 1, np.full(len(single), length)])
        start = np.concatenate([start[whole], single])
        print_ = texts.prints(start, size)
        key = np.concatenate([texts.key[whole], mixed(print_[whole.sum() :] ^ _WINDOW)])
        order = np.lexsort((size, print_, key))
        head = np.ones(len(order), bool)
        for x in (key, print_, size):
            x = x[order]
            head[1:] &= x[1:] == x[:-1]
        head[1:] = ~head[1:]
        at = np.flatnonzero(head)
        piece = np.empty(len(order), np.int64)
        piece[order] = np.cumsum(head) - 1
        least = np.minimum.reduceat(texts.ids[doc[order]], at) if len(at) else np.zeros(0, np.int64)
        some = order[at]  # one place of each piece
        raw = texts.data.tobytes()
        used, (cut,) = exchange.cuts(way.ranges, key[some])
        now, asked = [], []
        for r, i, j in zip(used.tolist(), cut, cut[1:]):
            if not low <= r < high:
                continue
            now.append(r)
            own = some[i:j]
            body = b"".join([raw[a : a + b] for a, b in zip(start[own].tolist(), size[own].tolist())])
            asked.append(plain(*steps(key[own]), size[own], signed(least[i:j])) + body)
        if not low:
            order = np.lexsort((start, doc))
            asked.append(plain(piece[order], doc[order], start[order] - texts.offsets[doc[order]]))
            now.append(~(block % way.ranges))
        return exchange.posted(block, now, asked, way)

    return run


def _firsts(length: int):
    """Of one hash range: for each block the runs (number of windows, least document) of every piece it sent."""

    def run(_: np.ndarray, values: list[bytes]) -> list[bytes]:
        asked = [numbers(x) for x in values]
        bodies, prints = [], []
        for a, value in zip(asked, values):
            bodies.append(value[len(value) - int(a[2].sum()) :])
            ends = np.cumsum(a[2]).astype(np.int64)
            prints.append(common.span_hashes(np.frombuffer(bodies[-1], np.uint8), ends - a[2].astype(np.int64), ends))
        body = b"".join(bodies)
        del bodies
        key = np.concatenate([walked(a[0], a[1]) for a in asked])
        size = np.concatenate([a[2] for a in asked]).astype(np.int64)
        ids = unsigned(np.concatenate([a[3] for a in asked]))
        print_ = np.concatenate(prints)
        at = np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((size, print_, key))
        head, other = np.ones(len(order), bool), np.ones(len(order), bool)
        other[1:] = key[order][1:] != key[order][:-1]
        head[1:] = other[1:] | (print_[order][1:] != print_[order][:-1]) | (size[order][1:] != size[order][:-1])
        first = np.flatnonzero(head)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(head) - 1
        least = np.minimum.reduceat(ids[order], first) if len(first) else np.zeros(0, np.int64)
        some = order[first]
        # keys with different pieces
        group = np.cumsum(other[first]) - 1
        several = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if len(group) else group
        cuts = [0, *(np.flatnonzero(np.diff(group[several])) + 1).tolist(), len(several)] if len(several) else []
        groups = [some[several[i:j]].tolist() for i, j in zip(cuts, cuts[1:])]
        changed: dict[int, np.ndarray] = {}
        for found in _shared_parts(body, at, groups, length):
            same: dict[bytes, list[tuple[int, int]]] = {}
            for r, a, b in found:
                same.setdefault(body[at[r] + a : at[r] + b], []).append((int(of[r]), a))
            texts = list(same)
            firsts = [min(int(least[c]) for c, _ in same[t]) for t in texts]
            windows = first_documents(texts, firsts, length) if len(texts) > 1 else [np.full(len(texts[0]) - length + 1, firsts[0], np.int64)]
            for t, m in zip(texts, windows):
                for c, a in same[t]:
                    if (m < least[c]).any():
                        if c not in changed:
                            changed[c] = np.full(size[some[c]] - length + 1, least[c])
                        np.minimum(changed[c][a : a + len(m)], m, out=changed[c][a : a + len(m)])
        runs, count, value = np.ones(len(first), np.int64), [size[some] - length + 1], [least]
        base = np.arange(len(first))
        extra = 0
        for c, m in changed.items():
            cut = np.concatenate([[0], np.flatnonzero(np.diff(m)) + 1])
            runs[c] = len(cut)
            base[c] = len(first) + extra
            extra += len(cut)
            count.append(np.diff(np.append(cut, len(m))))
            value.append(m[cut])
        count, value = np.concatenate(count), np.concatenate(value)
        answers = []
        for a, own in zip(asked, np.split(of, np.cumsum([len(a[2]) for a in asked])[:-1])):
            take = spread(base[own], runs[own])
            answers.append(plain(exchange.check(walked(a[0], a[1])), runs[own], count[take], signed(value[take])))
        return answers

    return run


def _shared_parts(body: bytes, at: np.ndarray, groups: list[list[int]], length: int, most: int = 1 << 20):
    """For each group of rows its (row, start, end) parts of at least ``length`` bytes in which every string of half that
    length occurs twice in the group; nothing outside them can be in a window that two rows share. Groups are looked at
    together, up to ``most`` bytes."""
    half = length // 2
    lot: list[list[int]] = []
    size = 0
    for n, rows in enumerate(groups):
        lot.append(rows)
        size += sum(int(at[r + 1] - at[r]) for r in rows)
        if size < most and n < len(groups) - 1:
            continue
        flat = [r for g in lot for r in g]
        data = np.frombuffer(b"".join([body[at[r] : at[r + 1]] for r in flat]), np.uint8)
        sizes = np.array([at[r + 1] - at[r] for r in flat], np.int64)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        group = np.repeat(np.arange(len(lot)), [len(g) for g in lot])
        places = np.arange(max(0, len(data) - half + 1))
        owner = np.repeat(np.arange(len(flat)), sizes)[: len(places)]
        inside = places + half <= ends[owner]
        places, owner = places[inside], owner[inside]
        h = common.span_hashes(data, places, places + half) ^ mixed(group[owner].astype(np.uint64))
        order = np.argsort(h, kind="stable")
        twice = np.zeros(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        places, owner = places[twice], owner[twice]
        cut = np.ones(len(places), bool)
        cut[1:] = (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:], [len(places)]]) - 1 if len(first) else first
        a, b = places[first], places[last] + half
        long = b - a >= length
        a, b, owner = a[long], b[long], owner[first][long]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for o, x, y in zip(owner.tolist(), (a - begin[owner]).tolist(), (b - begin[owner]).tolist()):
            out.setdefault(int(group[o]), []).append((flat[o], x, y))
        yield from (p for p in out.values() if len(p) > 1)
        lot, size = [], 0


def _results(length: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        notes, found = exchange.noted(answers)
        places = numbers(notes[0]) if notes else [np.zeros(0, np.uint64)] * 3
        piece, doc, start = (x.astype(np.int64) for x in places)
        runs, count, least = (np.concatenate([np.zeros(0, np.uint64), *(x[k] for x in found)]) for k in range(3))
        runs, count, least = runs.astype(np.int64), count.astype(np.int64), unsigned(least)
        begin = np.cumsum(runs) - runs
        before = np.cumsum(count) - count
        take = spread(begin[piece], runs[piece])
        place = np.repeat(np.arange(len(piece)), runs[piece])
        batches = unpacked(docs)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.asarray(b.column(0).to_numpy(), np.int64) for b in batches)])
        late = least[take] < ids[doc[place]]
        take, place = take[late], place[late]
        a = start[place] + before[take] - before[begin[piece[place]]]
        b = a + count[take] + length - 1
        doc = doc[place]
        order = np.lexsort((a, doc))
        a, b = a[order].tolist(), b[order].tolist()
        cut = np.searchsorted(doc[order], np.arange(len(ids) + 1)).tolist()
        n = -1
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n += 1
                raw = (text or "").encode()
                kept, spans, upto = [], 0, 0
                for x, y in zip(a[cut[n] : cut[n + 1]], b[cut[n] : cut[n + 1]]):
                    if x > upto or not spans:
                        kept.append(raw[upto:x])
                        spans += 1
                        upto = y
                    elif y > upto:
                        upto = y
                kept.append(raw[upto:])
                rest = b"".join(kept)
                for column, value in zip(out, (key, len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest())):
                    column.append(value)
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_bytes": pa.array(out[1], pa.int64()), "n_removed": pa.array(out[2], pa.int64()), "n_spans": pa.array(out[3], pa.int64()), "kept_sha256": pa.array(out[4], pa.string())})

    return run


def repeats_removed(docs: DataFrame, length: int = 50, seed: int = 16, crowd: int = 1000, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row with an id.

    A null text is empty; rows with a null id are left out; texts shorter than ``length`` keep all. Rows that repeat an id
    are judged each for itself, and none removes anything from another: its id is not smaller. Ids may be negative. An
    empty table gives no rows. Other columns are not read. Pieces of one minimizer, and texts, count as equal if 64 and
    128 bits of hashes and their sizes are. ``block_bytes`` bounds the text that one task holds; one longer text is held alone.
    ``fan`` bounds the rows that a block sends in one hop.
    """
    spark = docs.sparkSession
    lean(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    n = F.octet_length("text").cast("long")
    sums = settled(rows.select("doc_id", "h1", "h2", n.alias("n"), F.sha2(F.when(n < length, F.col("text")).otherwise(""), 256).alias("sha")))
    first = sums.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"))
    copies = settled(sums.join(first, ["h1", "h2", "n"]).where("doc_id > first").select("doc_id", "h1", "h2", "n", "sha"))
    late = common.small(copies.select("doc_id", "h1", "h2").distinct(), 32)
    looked = rows.join(late, ["doc_id", "h1", "h2"], "left_anti").select("doc_id", "text")
    way = route(hash_ranges(int(sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), block_bytes), fan)
    texts = settled(dealt(looked, block_bytes)).repartition("block")  # rows out of a join may come in another order when read again
    asked = exchange.arrived(texts.groupBy("block"), _ask(length, seed, way), way)
    known = settled(exchange.answered(asked, _known(crowd), way))
    edges = [way.ranges * k // way.hops for k in range(way.hops + 1)]
    rounds = [_pieces(length, seed, way, *edge) for edge in zip(edges, edges[1:])]
    asked = [exchange.arrived(texts.groupBy("block").cogroup(known.groupBy("block")), ask, way) for ask in rounds]
    firsts = reduce(DataFrame.unionByName, [settled(exchange.answered(x, _firsts(length), way)) for x in asked])
    kept = texts.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(_results(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    short = F.col("n") < length
    gone = copies.select("doc_id", F.col("n").alias("n_bytes"), F.when(short, 0).otherwise(F.col("n")).cast("long").alias("n_removed"), F.when(short, 0).otherwise(1).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return kept.unionByName(gone)
