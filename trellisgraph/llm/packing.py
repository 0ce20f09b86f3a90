"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents meet the packer only as counts by length, at most ``capacity`` numbers whatever the corpus size. On these the
driver fixes dominating sets for good and best-fits the rest, both with multiplicities: one step places all bins of a
kind. The plan is a short table of kinds of bins; pieces find their place by their gapless rank among equal lengths.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm.common import gapless, lean, saved, sliced

#: A blank between two other characters always parts two tokens of byte-level BPE, so what lies between is a unit.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")


class _Units(dict):
    """Text between two blanks, the blank before it included -> its ids as little-endian bytes."""

    most = 250_000

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.encode(" " + unit)).tobytes()
        if len(unit) <= 64 and len(self) < self.most:
            self[unit] = ids
        return ids


_open: dict[str, object] = {}
#: How byte-level BPE files part a text before they merge, unless they say otherwise.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def same_by_ranks(model: dict) -> bool:
    """Whether a tokenizer file parts texts by ``_PATTERN`` and merges by the order of its ids, so that an encoder that
    knows the ranks alone gives the same ids. A file with any other rule, or merges in another order, does not."""
    pre, bpe = model.get("pre_tokenizer") or {}, model["model"]
    plain = bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or not level or model.get("normalizer") or model.get("truncation"):
        return False
    vocab, special = bpe["vocab"], {x["content"] for x in model["added_tokens"]}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in bpe["merges"]]
    whole = {i for t, i in vocab.items() if t not in special and len(t) > 1}
    return None not in made and all(a < b for a, b in zip(made, made[1:])) and whole <= set(made)


def id_bytes(tokenizer_file: str):
    """A function from a text to its token ids as little-endian unsigned 32-bit numbers."""
    if tokenizer_file in _open:
        return _open[tokenizer_file]
    import json

    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file)
    model = json.loads(own.to_str())
    if not same_by_ranks(model):
        _open[tokenizer_file] = lambda text: array("I", own.encode(text, add_special_tokens=False).ids).tobytes()
        return _open[tokenizer_file]
    # Byte-level BPE writes bytes as printable characters; the same ranks serve the faster encoder.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    special = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    units = _Units(fast)
    specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def run(text: str) -> bytes:
        if specials.search(text):
            return array("I", own.encode(text, add_special_tokens=False).ids).tobytes()
        # without two white spaces in a row, every blank is such a break
        first, *rest = _BREAK.split(text) if _DOUBLE.search(text) else text.split(" ")
        return array("I", fast(first)).tobytes() + b"".join([units[u] for u in rest])

    _open[tokenizer_file] = run
    return run


def _pieces(tokenizer_file: str, capacity: int, end_id: int):
    def run(batches):
        encode, end = id_bytes(tokenizer_file), array("I", [end_id]).tobytes()
        for batch in sliced(batches):
            out = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = encode(text or "") + end
                n = len(raw) // 4
                first = n % capacity or capacity
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if not piece else start + capacity
                    for column, value in zip(out, (doc, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut only where longer than capacity."""
    lean(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_file, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def reduced(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of count[length] for good: (lengths of one bin, number of such bins).

    For the longest piece j and the longest other piece k that fits with it, {j, k} dominates every set with j if k
    fills the rest, or if no two others that fit are together longer than k and no three others fit at all. A piece
    with which nothing fits stands alone.
    """
    fixed = []
    for j in range(capacity, 0, -1):
        while count[j]:
            room = capacity - j
            count[j] -= 1
            have = np.flatnonzero(count[: room + 1])
            have = have[have > 0]
            count[j] += 1
            if not len(have):
                fixed.append(((j,), int(count[j])))
                count[j] = 0
                break
            k = int(have[-1])
            least = np.repeat(have, np.minimum(count[have] - (have == j), 3))[:3]
            dominates = k == room or len(least) < 2 or least[:2].sum() > room
            if not dominates and (len(least) < 3 or least.sum() > room):
                pair = max((int(a + have[np.searchsorted(have, room - a, "right") - 1]) for a in have if a + have[0] <= room), default=0)
                dominates = k >= pair
            if not dominates:
                break
            m = int(count[j] // 2 if j == k else min(count[j], count[k]))
            fixed.append(((j, k), m))
            count[j] -= m
            count[k] -= m
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts by length: each piece joins the fullest bin that still takes it."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            pattern, bins = open_bins[room].pop() if room is not None else ((), left)
            if room is not None and not open_bins[room]:
                del open_bins[room]
            room = capacity if room is None else room
            each = room // length
            full, over = divmod(left, each)
            use = min(bins, full)
            if use:
                open_bins.setdefault(room - each * length, []).append((pattern + (length,) * each, use))
            left -= use * each
            bins -= use
            if use == full and over and bins:
                open_bins.setdefault(room - over * length, []).append((pattern + (length,) * over, 1))
                left, bins = 0, bins - 1
            if bins and pattern:
                open_bins.setdefault(room, []).append((pattern, bins))
    return [x for kinds in open_bins.values() for x in kinds]


def plan(count: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a bin, first bin, offset in the bin) for every run of equal places."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in count.items():
        left[length] = n
    kinds = reduced(left, capacity) + best_fit(left, capacity)
    taken, rows, bin_no = dict.fromkeys(range(capacity + 1), 0), [], 0
    for pattern, bins in kinds:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length, taken[length], taken[length] + each * bins, each, bin_no, offset))
            taken[length] += each * bins
            offset += each * length
        bin_no += bins
    return rows


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A null text is empty and gives one piece with the end id. Rows that repeat an id are packed each for itself; a
    null id stays null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col))
    count = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = spark.createDataFrame(plan(count, capacity) or [(0, 0, 0, 1, 0, 0)], "p_length long, p_from long, p_to long, p_each long, p_bin long, p_offset long")
    # a bucket numbers about a million pieces of one length, whatever the number of pieces
    ranked = gapless(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", max(64, max(count.values(), default=0) // 1_000_000))
    here = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to"))
    out = ranked.join(F.broadcast(places), here)  # at most a few kinds of bins for each length
    at = F.col("rank") - F.col("p_from")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("p_bin") + F.expr("(rank - p_from) div p_each")).alias("sequence_id"), (F.col("p_offset") + F.pmod(at, F.col("p_each")) * F.col("length")).alias("offset"))
