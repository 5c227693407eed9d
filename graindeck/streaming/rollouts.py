"""Rollout logs as streams: an append-only log, windowed rewards with late rows, and runs of criticals with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import status


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Each row once, as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, by: str, value: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Mean and count of a value by window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def stops(stream: DataFrame, by: str, order: str, value: str, good: float, warning: float, after: int = 3, higher: bool = True) -> DataFrame:
    """A row (key, at) whenever a key has had so many criticals in a row; rows of a batch are taken in order."""
    marked = stream.withColumn("status", status(F.col(value), good, warning, higher))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        out = []
        for at, s in pd.concat(batches).sort_values(order)[[order, "status"]].itertuples(index=False):
            run = run + 1 if s == "CRITICAL" else 0
            if run == after:
                out.append((key[0], str(at)))
        state.update((run,))
        yield pd.DataFrame(out, columns=["key", "at"])

    return marked.groupBy(by).applyInPandasWithState(step, "key string, at string", "run int", "append", GroupStateTimeout.NoTimeout)
