"""A stream of writes to keys: each key's state has the place of its first write and the values of its last.

An extension: the same rows as operators.store.upsert has for all writes so far, without reading any again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    """A value of a pandas row as state takes it."""
    if value is None or value is pd.NaT or (isinstance(value, float) and pd.isna(value)):
        return None
    return value.item() if hasattr(value, "item") else value


class _Upsert(StatefulProcessor):
    """State of a key: (place of the first write, place of the last, values of the last)."""

    def __init__(self, state: StructType, columns: list[str], order: str, id_col: str):
        self._schema, self._columns, self._order, self._id = state, columns, order, id_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("last", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self._state.get() if self._state.exists() else None
        for frame in rows:
            orders = frame[self._order]
            last = frame.loc[orders.idxmax()]
            first, place = _plain(orders.min()), _plain(last[self._order])
            pos = first if now is None else min(now[0], first)
            if now is None or place >= now[1]:
                now = (pos, place, *[_plain(last[c]) for c in self._columns])
            else:
                now = (pos, *now[1:])
        self._state.update(now)
        yield pd.DataFrame({self._id: [key[0]], **{c: pd.Series([v], dtype=object) for c, v in zip(self._columns, now[2:], strict=True)}, "pos": [now[0]]})

    def close(self) -> None:
        pass


def keyed_upsert(writes: DataFrame, id_col: str = "id", order_col: str = "wseq") -> DataFrame:
    """A streaming DataFrame of (id, the other columns, pos): a row for each key that a micro-batch writes, as it then is.

    Writes may come in any order of ``order_col`` (a number that is not null); of equal orders the later to come counts.
    """
    writes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    fields = {f.name: f for f in writes.schema}
    columns = [c for c in writes.columns if c not in (id_col, order_col)]
    order = fields[order_col].dataType
    state = StructType([StructField("_first", order), StructField("_last", order), *[StructField(c, fields[c].dataType) for c in columns]])
    out = StructType([fields[id_col], *[StructField(c, fields[c].dataType) for c in columns], StructField("pos", order)])
    return writes.groupBy(id_col).transformWithStateInPandas(statefulProcessor=_Upsert(state, columns, order_col, id_col), outputStructType=out, outputMode="Update", timeMode="None")


def upsert_to(writes: DataFrame, path: str, checkpoint: str, id_col: str = "id", order_col: str = "wseq") -> StreamingQuery:
    """Keeps a table of changes at ``path``: ``batch=<number>`` holds the keys that a micro-batch wrote. A replayed batch replaces its own."""

    def change(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keyed_upsert(writes, id_col, order_col).writeStream.foreachBatch(change).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
