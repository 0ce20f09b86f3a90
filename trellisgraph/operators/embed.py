"""The embedding step: a model opened once a worker, texts in batches, and only texts that changed."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisgraph.operators.search import embedding_text

#: What a model is: it takes texts and gives one vector for each.
Model = Callable[[list[str]], np.ndarray]
TOKEN = re.compile(r"[一-鿿]|[^\s一-鿿]+")

_open: dict[str, Model] = {}


def hashed_model(dim: int = 64) -> Model:
    """A deterministic stand-in for an embedding model: signed word hashes."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+|[一-鿿]", text.lower()):
                h = hashlib.md5(word.encode()).digest()
                out[i, int.from_bytes(h[:4], "big") % dim] += 1 if h[4] & 1 else -1
        return out

    return run


def cut_to_tokens(text: str, most: int) -> str:
    """The text up to the end of its token number ``most``: Han characters and runs of other visible characters."""
    if len(text) <= most:
        return text
    for n, m in enumerate(TOKEN.finditer(text), 1):
        if n == most:
            return text[: m.end()]
    return text


def embedding(text: Column, opened: Callable[[], Model], batch: int = 32, tokens: int = 8192) -> Column:
    """The vector of each text, of length one (zeros stay zeros). ``opened`` gives the model; a worker calls it once."""
    key = uuid.uuid4().hex

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _open:
            _open.clear()
            _open[key] = opened()
        model = _open[key]
        for part in parts:
            texts = [cut_to_tokens(t or "", tokens) for t in part]
            rows: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                x = np.asarray(model(texts[i : i + batch]), np.float64)
                rows += list((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32))
            yield pd.Series(rows)

    return run(text)


def _text() -> Column:
    return embedding_text(F.col("label"), F.col("name"), F.col("props")["description"])


def with_embeddings(old: DataFrame, nodes: DataFrame, written: DataFrame, opened: Callable[[], Model], batch: int = 32, tokens: int = 8192) -> DataFrame:
    """``nodes`` with embeddings of the nodes ``written`` (node_id) whose text is not that of ``old`` or had none yet.

    The model sees no other row; all others keep what they have, whatever their number."""
    before = old.select("node_id", F.sha2(_text(), 256).alias("_hash"), F.col("embedding").alias("_had"))
    ids = written.select("node_id").distinct().withColumn("_new", F.lit(True))
    rows = nodes.join(before, "node_id", "left").join(ids, "node_id", "left")
    stale = F.col("_new").isNotNull() & (F.col("_had").isNull() | ~F.col("_hash").eqNullSafe(F.sha2(_text(), 256)))
    rows = rows.withColumn("_stale", stale)
    kept = rows.where("not _stale").withColumn("embedding", F.coalesce("_had", "embedding")).select(*nodes.columns)
    done = rows.where("_stale").withColumn("embedding", embedding(_text(), opened, batch, tokens)).select(*nodes.columns)
    return kept.unionByName(done)
