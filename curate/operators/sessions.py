"""Generators over ordered groups: a table function that turns a group's rows into 0, 1 or more without holding the group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(rows: DataFrame, by: str, at: str, gap_seconds: int, least: int = 1) -> DataFrame:
    """Runs of a group's rows with at most ``gap_seconds`` between neighbours: ``by, start, end, n``.

    Runs of fewer than ``least`` rows give nothing. Rows reach the function by group and in order, a batch at a time; it keeps
    only the run that is open, so a group may have any number of rows. Rows without a time are left out.
    """
    kind = rows.schema[by].dataType.simpleString()
    limit = gap_seconds * 1_000_000

    class Sessions:
        def __init__(self):
            self.open = None  # group, start, end, rows

        def _closed(self, done: list) -> pa.Table:
            names, types = ("group", "start", "end", "n"), (self.kind, pa.int64(), pa.int64(), pa.int64())
            return pa.table({n: pa.array([d[i] for d in done], t) for i, (n, t) in enumerate(zip(names, types))})

        def eval(self, batch: pa.RecordBatch):
            groups, times = batch.column("_by"), batch.column("_at").to_numpy()
            self.kind = groups.type
            if not len(times):
                return
            # A batch may hold the end of one group and the beginning of the next.
            named = groups.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = np.flatnonzero((np.diff(times) > limit) | (np.diff(named) != 0)) + 1
            edges = [0, *cut.tolist(), len(times)]
            done = []
            for a, b in zip(edges, edges[1:]):
                group, start, end = groups[a].as_py(), int(times[a]), int(times[b - 1])
                if self.open and self.open[0] == group and start - self.open[2] <= limit and start >= self.open[2]:
                    self.open = (group, self.open[1], end, self.open[3] + b - a)
                    continue
                if self.open and self.open[3] >= least:
                    done.append(self.open)
                self.open = (group, start, end, b - a)
            if done:
                yield self._closed(done)

        def terminate(self):
            if self.open and self.open[3] >= least:
                yield self._closed([self.open])

    function = F.arrow_udtf(Sessions, returnType=f"group {kind}, start long, end long, n long")
    given = rows.filter(F.col(at).isNotNull()).select(F.col(by).alias("_by"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"))
    found = function(given.asTable().partitionBy("_by").orderBy("_at"))
    time = {c: F.timestamp_micros(c).cast(rows.schema[at].dataType) for c in ("start", "end")}
    return found.select(F.col("group").alias(by), time["start"].alias("start"), time["end"].alias("end"), "n")
