"""Keyed merges in a stream: what each row does to the last known row of its key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Merge(StatefulProcessor):
    """Holds, for each key, the last value of every column as text, until ``ttl_ms`` after its last change."""

    def __init__(self, key: list[str], columns: list[str], order: str, ttl_ms: int | None):
        self.key, self.columns, self.order, self.ttl_ms = key, columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("row", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the rows of one key in one batch
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        old = self.held.get()
        known = json.loads(old[0]) if old is not None else None
        out = []
        for row in batch[[*self.columns, self.order]].astype(object).where(batch[[*self.columns, self.order]].notna(), None).itertuples(index=False):
            new = {c: v for c, v in zip(self.columns, row) if v is not None}
            if known is None:
                status, known = "new", new
            else:
                status = "updated" if any((known.get(c) or "") != v for c, v in new.items()) else "unchanged"
                known = known | new
            out.append((*key, *[known.get(c) for c in self.columns], row[-1], status))
        if out[-1][-1] != "unchanged" or len({x[-1] for x in out}) > 1:
            self.held.update((json.dumps(known, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=[*self.key, *self.columns, self.order, "status"])

    def close(self) -> None:
        pass


def able(spark: SparkSession) -> None:
    """Lets the session keep arbitrary state: it needs the RocksDB store, set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def upserts(rows: DataFrame, key: list[str], columns: list[str], order: str = "ord", ttl_ms: int | None = None) -> DataFrame:
    """(key, columns, order, status) for every row of a stream: new, updated or unchanged, as ``write.compared`` says it,
    and the merged values after it.

    Values are compared as text; a null changes nothing. Rows of a key in one batch count one after another by ``order``, a
    number. State is one row a key, in the RocksDB store of the query's checkpoint, dropped ``ttl_ms`` after its last change
    (null: never); a restart from the checkpoint goes on with it. Rows with a null key are left out.
    """
    able(rows.sparkSession)
    wanted = rows.select(*[F.col(c).cast("string").alias(c) for c in (*key, *columns)], F.col(order).cast("long").alias(order))
    for c in key:
        wanted = wanted.where(F.col(c).isNotNull())
    schema = ", ".join([*[f"`{c}` string" for c in (*key, *columns)], f"`{order}` long", "status string"])
    return wanted.groupBy(*key).transformWithStateInPandas(statefulProcessor=_Merge(key, columns, order, ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
