"""Many names in many texts: an Aho-Corasick automaton over the names, run once over each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.lineage import cut

#: Bytes of names that one automaton holds; more names make more blocks, each of which reads the texts once.
BLOCK_BYTES = 16 << 20
#: Rows of an output batch.
ROWS = 1 << 15

_built: dict[str, object] = {}


def _automaton(key: str, names: list[str]):
    """The automaton of a block, built once in a worker; the one before it is let go."""
    if key not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for name in names:
            made.add_word(name, name)
        made.make_automaton()
        _built.clear()
        _built[key] = made
    return _built[key]


def _found(key: str, held, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, held.value)
        for batch in batches:
            rows, names, starts, lengths = [], [], [], []

            def full() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["id", "name", "start", "length"])
                for x in (rows, names, starts, lengths):
                    x.clear()
                return out

            for i, text in enumerate(batch.column(1).to_pylist()):
                seen: set[str] = set()
                for end, name in automaton.iter(text or ""):
                    if first:
                        if name in seen:
                            continue
                        seen.add(name)
                    rows.append(i)
                    names.append(name)
                    starts.append(end - len(name) + 1)
                    lengths.append(len(text))
                    if len(rows) >= ROWS:
                        yield full()
            if rows:
                yield full()

    return run


def occurrences(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str = "name", first: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, name, start, length): every place (from 0) where a name is in a text, of ``length`` characters; overlaps too.

    first: only the first place of each name in a text. Letters count as they are; null and empty names are in no text.
    Names are measured and dealt into blocks of about ``block_bytes``; the driver holds one block at a time. Texts are not
    shuffled: a block costs one reading of them, and a text one pass, whatever the number of names.
    """
    spark = texts.sparkSession
    names = names.select(F.col(name_col).cast("string").alias("name")).where("name <> ''").distinct()
    blocks = 1 + int(names.agg(F.coalesce(F.sum(F.octet_length("name") + 16), F.lit(0))).first()[0]) // block_bytes
    if blocks > 1:
        names = cut(names)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, name string, start int, length int"
    out = None
    for b in range(blocks):
        own = names if blocks == 1 else names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        listed = own.toArrow().column("name").to_pylist()
        if listed:
            part = rows.mapInArrow(_found(uuid.uuid4().hex, spark.sparkContext.broadcast(listed), first), schema)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
