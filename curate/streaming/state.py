"""Stateful streams: the latest version per key, kept in the state store, with only changes as output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: State stores that keep state off the heap and write changes only, which this needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that keys are dealt to by hash; a checkpoint belongs to one number of them.
BUCKETS = 1 << 12


class _Latest(StatefulProcessor):
    """Per key of a bucket the highest version seen and how often it has changed, as one table per bucket."""

    def __init__(self, key: str, version: str):
        self.key, self.version = key, version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("latest", StructType([StructField("body", BinaryType())]))

    def _best(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The first row of the highest version of each key."""
        code = pd.factorize(rows[self.key], use_na_sentinel=False)[0]
        order = np.lexsort((np.arange(len(rows)), -rows[self.version].to_numpy(), code))
        first = np.r_[True, np.diff(code[order]) != 0]
        return rows.iloc[order[first]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:  # a bucket's rows of one batch, a piece at a time
            best = self._best(part if best is None else pd.concat([best, part]))
        if best is None or best.empty:
            return
        best = best.reset_index(drop=True)
        keys = pa.Array.from_pandas(best[self.key])
        version, changes = best[self.version].to_numpy(np.int64), np.ones(len(best), np.int64)
        known = pa.ipc.open_stream(self.kept.get()[0]).read_all() if self.kept.exists() else None
        at = np.full(len(best), -1)
        if known is not None:
            at = pc.index_in(keys.cast(known["key"].type), known["key"].combine_chunks(), skip_nulls=False).fill_null(-1).to_numpy()
            before, times = known["version"].to_numpy().copy(), known["changes"].to_numpy().copy()
            changes = np.where(at >= 0, times[at] + 1, 1)
            higher = (at < 0) | (version > before[at])
            best, keys, version, changes, at = best[higher], keys.filter(pa.array(higher)), version[higher], changes[higher], at[higher]
        if best.empty:
            return
        new = at < 0
        table = pa.table({"key": keys.filter(pa.array(new)), "version": version[new], "changes": changes[new]})
        if known is not None:
            before[at[~new]], times[at[~new]] = version[~new], changes[~new]
            table = pa.concat_tables([pa.table({"key": known["key"], "version": before, "changes": times}), table.cast(known.schema)])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.kept.update((sink.getvalue().to_pybytes(),))
        yield best.assign(changes=changes)

    def close(self) -> None:
        pass


def latest_changes(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of a stream that bring a higher version of their key than any before, with ``changes``, the number of such rows so far.

    Late, repeated and equal versions give nothing, in the same batch or in any later run with the same checkpoint. The state is one pair
    of numbers per key; ``version`` is a whole number without nulls. Output goes to any sink, in append mode.

    Keys are dealt to ``BUCKETS`` groups, whose state is read and written as a whole, since a call of the state store per key
    costs far more than its pair of numbers. Null keys have a group of their own.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = StructType([*rows.schema.fields, StructField("changes", LongType())])
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int")
    return rows.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=_Latest(key, version), outputStructType=schema, outputMode="Append", timeMode="None"
    )
