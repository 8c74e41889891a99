"""Plates that become complete while their files arrive.

State per plate is the set of wells seen, at most the plate format's size. A plate is
emitted once; a plate that stays incomplete past the event-time timeout is reported as
late and its state dropped. Arrivals of wells outside the plate format are reported as
invalid, with their number, and don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from platewise.session import fresh_path

STATE = "wells array<long>, last timestamp, done boolean"
OUTPUT = "plate long, n_wells long, status string"


def plate_completeness(stream: DataFrame, n_wells: int, patience: str = "2 hours", timeout_ms: int = 7_200_000) -> DataFrame:
    """(plate, n_wells, status) from a stream of (plate long, well long, ts timestamp).

    Repeated (plate, well) arrivals within the watermark are dropped by the engine
    first, so a plate re-sent many times does not flow into its state.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            wells, _, done = state.get
            state.remove()
            if not done:
                yield pd.DataFrame({"plate": [key[0]], "n_wells": [len(wells)], "status": ["late"]})
            return
        wells, last, done = state.get if state.exists else ([], None, False)
        seen = set(wells)
        for pdf in batches:
            outside = pdf["well"].isna() | (pdf["well"] < 0) | (pdf["well"] >= n_wells)
            if outside.any():
                yield pd.DataFrame({"plate": [key[0]], "n_wells": [int(outside.sum())], "status": ["invalid"]})
            seen.update(int(w) for w in pdf.loc[~outside, "well"])
            top = pdf["ts"].max()
            last = top if last is None or top > last else last
        now = len(seen) == n_wells
        # a finished plate keeps only its flag, so that later copies stay silent
        state.update(([] if now or done else sorted(seen), last, bool(now or done)))
        deadline = int(pd.Timestamp(last).timestamp() * 1000) + timeout_ms
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        if now and not done:
            yield pd.DataFrame({"plate": [key[0]], "n_wells": [n_wells], "status": ["complete"]})

    arrivals = stream.select("plate", "well", "ts").withWatermark("ts", patience).dropDuplicatesWithinWatermark(["plate", "well"])
    return arrivals.groupBy("plate").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream over what is there, into a Parquet table with exactly-once files, and read it."""
    path, check = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
