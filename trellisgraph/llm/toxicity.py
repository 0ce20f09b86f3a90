"""Toxicity by gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Tokens are read through common disguises (digits and signs for letters, points between them). A lexicon of words and
beginnings of words is learnt from labelled texts: those whose odds of a toxic text, at the lower end of their error, pass
``LEAST``. Its hits, their nearness to a second person, capitals, punctuation and disguises become densities and counts.
Lexicon hits of a labelled text are counted with a lexicon learnt without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm import common
from trellisgraph.llm.common import SLICE_BYTES, lean, saved, sliced, span_hashes, text_or_empty

#: Fixed lists: insults that need no learning, and words for the person spoken to, in four languages.
INSULTS = "idiot stupid moron loser scum trash clown pathetic disgusting worthless dumb fool ugly jerk bastard bitch shit fuck crap asshole dumm blöd arschloch trottel scheiße depp connard merde salaud débile imbécile idiota estúpido estúpida mierda imbécil cabrón"
PERSONS = "you your yours yourself ur youre du dich dir dein deine deinen deiner euch euer tu toi vous votre vos tú usted ustedes vosotros"
#: Bytes of the beginnings of words that may enter the lexicon.
HEADS = range(4, 9)
#: A word or beginning enters with a lower bound of its log odds ratio of at least this much.
LEAST = 1.5
#: Texts that must share a beginning before it is looked at.
SEEN = 4
FOLDS = 3

BREAK, LETTER, LEET, JOINER = range(4)
KIND = np.full(256, JOINER, np.uint8)
KIND[list(b" \t\n\v\f\r,;:?!\"()[]{}<>/\\|")] = BREAK
KIND[97:123] = KIND[128:] = LETTER
READ = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip(b"013457@$", b"oieastas"):
    KIND[_sign], READ[_sign] = LEET, _letter
_WHOLE = np.uint64(0x6A09E667F3BCC909)

FEATURES = ["words", "hits", "hit_rate", "strong_hits", "weight_rate", "top_weight", "kinds", "insult_rate", "insults", "person_rate", "near_person", "near_rate", "capitals", "shouted", "marks", "exclamations", "questions", "disguised", "disguised_hits", "repeated", "single"]


@dataclass
class Words:
    """The tokens of some texts as they read: letters in ``data``, one word at [start, end) of text ``text``."""

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    disguised: np.ndarray
    at: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return self.end - self.start

    def whole(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end) ^ _WHOLE

    def head(self) -> np.ndarray:
        """16 bits of the first three bytes of each word of three or more."""
        a, b, c = (self.data[np.minimum(self.start + k, len(self.data) - 1)].astype(np.int64) for k in range(3))
        return (a * 2551 + b * 331 + c * 17) & 0xFFFF

    def only(self, mask: np.ndarray) -> Words:
        return Words(self.data, *(x[mask] for x in (self.text, self.start, self.end, self.disguised, self.at)))


def tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts in lower case, each of which ends with a line break. A sign is a letter if a letter follows, or
    a sign that stands for one after a letter; points and other joiners inside a token are passed over."""
    kind = KIND[data]
    letter = kind == LETTER
    after, before = np.append(kind[1:], BREAK), np.append(BREAK, kind[:-1])[: len(kind)]
    as_letter = (kind == LEET) & ((after == LETTER) | (before == LETTER) & (after == LEET))
    inside = kind != BREAK
    token = np.cumsum(inside & (before == BREAK))
    pos = np.flatnonzero(letter | as_letter)
    if not len(pos):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(1, np.uint8), none, none, none, none.astype(bool), none)
    own = token[pos]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    end = np.append(first[1:], len(pos))
    signs = np.append(0, np.cumsum(as_letter[pos]))
    gap = pos[end - 1] - pos[first] + 1 != end - first
    return Words(READ[data[pos]], np.searchsorted(offsets, pos[first], "right") - 1, first, end, gap | (signs[end] > signs[first]), pos[first])


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, each followed by a line break."""
    texts = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    return common.buffers(pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))


def entries(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of whole words and of each length of beginnings."""
    yield np.arange(len(words.start)), words.whole()
    for n in HEADS:
        long = np.flatnonzero(words.size >= n)
        yield long, span_hashes(words.data, words.start[long], words.start[long] + n)


class Lexicon:
    """Hashes of words and beginnings with a weight each."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, heads: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.heads = np.zeros(1 << 16, bool)
        self.heads[heads] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The greatest weight of each word (0: none) and the entry that has it."""
        weight, which = np.zeros(len(words.start)), np.full(len(words.start), -1, np.int64)
        near = np.flatnonzero((words.size >= 3) & self.heads[words.head()]) if len(self.keys) else np.zeros(0, np.int64)
        if len(near):
            for own, h in entries(words.only(near)):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                better = (self.keys[at] == h) & (self.weights[at] > weight[near[own]])
                weight[near[own[better]]], which[near[own[better]]] = self.weights[at[better]], at[better]
        return weight, which


def _listed(text: str) -> np.ndarray:
    data, offsets = lowered(pa.array(text.split()))
    return np.unique(tokens(data, offsets).whole())


def _is_in(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)] == hashes


def features(column: pa.Array, lexicons: list[Lexicon], which: np.ndarray, reach: int = 5) -> np.ndarray:
    """A row of ``FEATURES`` for each text; ``which`` says by what lexicon it is read. A text without words has zeros."""
    data, offsets = lowered(column)
    raw, raw_offsets = common.buffers(column)
    n = len(offsets) - 1
    w = tokens(data, offsets)
    weight, entry = np.zeros(len(w.start)), np.full(len(w.start), -1, np.int64)
    for k in np.unique(which).tolist():
        own = which[w.text] == k
        weight[own], entry[own] = lexicons[k].hits(w.only(own))
    count = lambda mask: np.bincount(w.text[mask], minlength=n).astype(float)
    hit, whole = weight > 0, w.whole()
    person, insult = _is_in(whole, _listed(PERSONS)), _is_in(whole, _listed(INSULTS))
    # nearness: a second person within ``reach`` words of a hit, in the same text
    spoken, struck = np.flatnonzero(person), np.flatnonzero(hit | insult)
    close = np.zeros(len(w.start), bool)
    if len(spoken) and len(struck):
        at = np.searchsorted(spoken, struck)
        for side in (np.maximum(at - 1, 0), np.minimum(at, len(spoken) - 1)):
            mate = spoken[side]
            close[struck] |= (np.abs(mate - struck) <= reach) & (w.text[mate] == w.text[struck])
    kinds = np.bincount(np.unique(np.stack([w.text[hit], entry[hit]]), axis=1)[0], minlength=n) if hit.any() else np.zeros(n)
    top = np.zeros(n)
    np.maximum.at(top, w.text, weight)
    # every text ends with one added byte in ``data`` and none in ``raw``
    per_text = lambda mask, o: np.diff(np.append(0, np.cumsum(mask))[o]).astype(float)
    upper, alpha = (raw >= 65) & (raw <= 90), (raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122) | (raw >= 128)
    both = np.append(upper[1:] & upper[:-1], False)
    mark = (data > 32) & (data < 127) & (KIND[data] != LETTER) & ~((data >= 48) & (data <= 57))
    again = np.append(np.append(False, (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (KIND[data[2:]] == LETTER)), False)[: len(data)] if len(data) > 2 else np.zeros(len(data), bool)
    words, size = count(np.ones(len(w.start), bool)), np.maximum(per_text(np.ones(len(raw), bool), raw_offsets), 1)
    each, letters = np.maximum(words, 1), np.maximum(per_text(alpha, raw_offsets), 1)
    hits, insults, near = count(hit), count(insult), count(close)
    sums = np.bincount(w.text, weights=weight, minlength=n)
    columns = [
        np.log1p(words), np.log1p(hits), hits / each, np.log1p(count(weight >= 3)), sums / each, top, np.log1p(kinds), insults / each, np.log1p(insults), count(person) / each,
        np.log1p(near), near / each, per_text(upper, raw_offsets) / letters, per_text(both, raw_offsets) / letters, per_text(mark, offsets) / size, per_text(data == 33, offsets) / size,
        per_text(data == 63, offsets) / size, count(w.disguised) / each, np.log1p(count(w.disguised & (hit | insult))), per_text(again, offsets) / letters, count(w.size == 1) / each,
    ]
    return np.stack(columns, 1)


def _texts(batch: pa.RecordBatch) -> Words:
    w = tokens(*lowered(batch.column("text")))
    return w.only(w.size >= 3)


def _beginnings(wanted: np.ndarray | None):
    """Counts of texts by entry, fold and label; of the ``wanted`` entries, with the heads of their words, if given."""

    def run(batches):
        for batch in sliced(batches):
            w = _texts(batch)
            head, docs = w.head(), np.asarray(batch.column("fold")).astype(np.int64) * 2 + np.asarray(batch.column("label")).astype(np.int64)
            found = []
            for own, h in entries(w):
                if wanted is not None and len(wanted):
                    good = _is_in(h, wanted)
                    own, h = own[good], h[good]
                elif wanted is not None:
                    own, h = own[:0], h[:0]
                found.append((w.text[own], h, head[own]))
            text, key, head = (np.concatenate(x) for x in zip(*found))
            once = np.unique(common.mixed(key + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            text, key, head = text[once], key[once], head[once]
            group = docs[text]
            order = np.lexsort((group, key))
            key, group, head = key[order], group[order], head[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(head[first].astype(np.int32)), pa.array(group[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "head", "grp", "n"])

    return run


def learnt(counts: np.ndarray, keys: np.ndarray, heads: np.ndarray, totals: np.ndarray) -> Lexicon:
    """The entries whose log odds ratio is at least ``LEAST`` at its lower end. counts, totals: clean and toxic texts."""
    clean, toxic = counts[:, 0] + 0.5, counts[:, 1] + 0.5
    ratio = np.log(toxic / (totals[1] + 1)) - np.log(clean / (totals[0] + 1)) - 1.64 * np.sqrt(1 / toxic + 1 / clean)
    keep = (ratio >= LEAST) & (counts[:, 1] >= SEEN)
    return Lexicon(keys[keep], ratio[keep], heads[keep])


@dataclass
class Model:
    """Lexicons (one without each fold, the last of all), trees and calibration; without trees every text has ``constant``."""

    lexicons: list[Lexicon]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0


def _measured(lexicons: list[Lexicon], spark):
    held = spark.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, fold in batches:
            rows = [np.zeros((0, len(FEATURES)))]
            for batch in sliced([pa.RecordBatch.from_arrays([texts, fold], ["text", "fold"])], SLICE_BYTES):
                rows.append(features(batch.column(0), held.value, np.asarray(batch.column(1)).astype(np.int64)))
            flat = np.concatenate(rows)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(FEATURES)), pa.int32()), pa.array(flat.ravel()))

    return F.arrow_udf(run, "array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model learnt from at most ``most`` labelled documents, those with the least hash of their id.

    The bound keeps lexicon and trees small whatever the corpus holds. An id with several labels is toxic if one says so;
    null labels and ids are none. Rows that share an id are each learnt from. With no toxic or no clean text the score is a
    constant: 1 if all are toxic, else 0."""
    spark = docs.sparkSession
    lean(spark)
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    ids = ids.where("label in (0, 1)").orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(ids), "_id")
    rows = saved(rows.select("_id", "text", "label", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")))
    size = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "label").count().collect():
        size[r["fold"], r["label"]] = r["count"]
    total = size.sum(0)
    if not total.all():
        return Model([], None, None, float(total[1] > 0))
    schema, text = "key long, head int, grp int, n long", rows.select("text", "label", "fold")
    common_keys = text.where("label = 1").mapInArrow(_beginnings(None), schema).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN).select("key").toArrow()
    wanted = np.sort(common_keys.column("key").to_numpy().view(np.uint64))
    held = spark.sparkContext.broadcast(wanted)
    found = text.mapInArrow(lambda batches: _beginnings(held.value)(batches), schema).groupBy("key", "grp").agg(F.sum("n").alias("n"), F.min("head").alias("head")).toArrow()
    key, head, group, n = (found.column(c).to_numpy() for c in ("key", "head", "grp", "n"))
    keys, at = np.unique(key.view(np.uint64), return_inverse=True)
    counts, heads = np.zeros((len(keys), FOLDS, 2)), np.zeros(len(keys), np.int64)
    np.add.at(counts, (at, group // 2, group % 2), n)
    heads[at] = head
    lexicons = [learnt(counts.sum(1) - counts[:, k], keys, heads, total - size[k]) for k in range(FOLDS)] + [learnt(counts.sum(1), keys, heads, total)]
    table = saved(rows.select("_id", F.xxhash64("text").alias("h"), F.col("label").cast("double").alias("label"), "fold", _measured(lexicons, spark)("text", "fold").alias("x")).coalesce(1).sortWithinPartitions("_id", "h"))
    table = table.coalesce(1).withColumn("features", array_to_vector("x"))
    apart = size[: FOLDS - 1].sum(0).all() and size[FOLDS - 1].all()
    fit, check = (table.where(F.col("fold") < FOLDS - 1), table.where(F.col("fold") == FOLDS - 1)) if apart else (table, table)
    trees = GBTClassifier(maxIter=30, maxDepth=3, stepSize=0.2, maxBins=64, seed=7, checkpointInterval=-1, minInstancesPerNode=3).fit(fit)
    calibration = IsotonicRegression(featuresCol="raw", predictionCol="calibrated").fit(_raw(trees, check))
    return Model(lexicons, trees, calibration)


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    out = trees.transform(rows)
    return out.withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def scored(docs: DataFrame, model: Model, row: Column, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """_row (the value of ``row``, as a struct), score (0 to 1) and predicted (1 from ``threshold`` on) of every row.

    Null texts count as empty; repeated rows are judged each for itself; an empty table gives no rows. Only texts go to
    Python, in slices; trees and calibration run in the JVM, and nothing is shuffled."""
    lean(docs.sparkSession)
    if model.trees is None:
        out = docs.select(row.alias("_row"), F.lit(model.constant).alias("score"))
    else:
        x = _measured(model.lexicons, docs.sparkSession)(text_or_empty(text_col), F.lit(FOLDS))
        rows = docs.select(row.alias("_row"), array_to_vector(x).alias("features"))
        out = model.calibration.transform(_raw(model.trees, rows)).select("_row", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
