"""Keyed state on streams: micro-batches that update a state table, and triggers with cooldown as a stateful operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "key string, feature string, total double, events bigint, last timestamp"


def updated_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state (see STATE) with the events of a batch (key, feature, value, ts) added: totals and counts add up, the last time
    is the later one."""
    new = batch.groupBy("key", "feature").agg(F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("total"), F.count("*").alias("events"), F.max("ts").alias("last"))
    return state.unionByName(new).groupBy("key", "feature").agg(F.sum("total").alias("total"), F.sum("events").alias("events"), F.max("last").alias("last"))


def maintain_state(events: DataFrame, path: str, checkpoint: str, and_then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps the state of a stream of (key, feature, value, ts) under path, one version for each batch number, so a batch
    that is run again after a failure starts from the version before it. Earlier versions may be deleted."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATE).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], STATE)
        updated_state(before, batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        if and_then:
            and_then(spark.read.schema(STATE).parquet(f"{path}/v{number}"))

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def trigger_stream(events: DataFrame, key: str, time: str, cooldown_seconds: int, daily_cap: int = 3) -> DataFrame:
    """(key, fired_at) for a stream that holds matching events only: an event fires unless it comes within the cooldown of
    the last one that did, or the day's cap is reached. State is three numbers for each key. Events of a micro-batch
    are taken in order of time; those older than the last firing never fire."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, day, n = state.get if state.exists else (-(1 << 62), -1, 0)
        fired = []
        for at in sorted(int(x.value // 1000) if isinstance(x, pd.Timestamp) else int(x) for f in frames for x in f["micros"]):
            today = at // 86_400_000_000
            n = n if today == day else 0
            if at - last >= cooldown_seconds * 1_000_000 and n < daily_cap:
                last, day, n = at, today, n + 1
                fired.append(at // 1_000_000)
        state.update((last, day, n))
        yield pd.DataFrame({"key": [str(k[0])] * len(fired), "fired_at": fired})

    plain = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"))
    return plain.groupBy("key").applyInPandasWithState(step, "key string, fired_at bigint", "last bigint, day bigint, n int", "append", GroupStateTimeout.NoTimeout)
