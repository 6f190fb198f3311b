"""Streams: a sliding limiter per client, append-only logs and a base refreshed by an overlay stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALLOWED = "client long, event_id long, ts timestamp, allowed boolean"


def hits_in_window(events: DataFrame, client: str = "user_id", ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Batch: each event with the client's events of the last `seconds`, itself included."""
    at = F.col(ts).cast("timestamp").cast("double")
    w = Window.partitionBy(client).orderBy(at).rangeBetween(-seconds, 0)
    return events.withColumn("hits", F.count(F.lit(1)).over(w))


def _decide(times: list[float], at: float, limit: int, seconds: float) -> tuple[list[float], bool]:
    """Times of allowed hits that still count, and whether one at `at` is allowed. Only allowed hits count."""
    kept = [t for t in times if t >= at - seconds]
    if len(kept) >= limit:
        return kept, False
    return [*kept, at], True


def limited(events: DataFrame, limit: int, seconds: float = 60.0, client: str = "user_id", event: str = "event_id", ts: str = "ts") -> DataFrame:
    """Batch form of the recursive limiter: client, event_id, ts, allowed. A client's events are walked in order of time and id; state is at most `limit` times."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, times = None, []
        for f in frames:
            out = []
            for c, e, t in zip(f["client"], f["event_id"], f["ts"]):
                if c != who:
                    who, times = c, []
                times, ok = _decide(times, t.timestamp(), limit, seconds)
                out.append(ok)
            yield f.assign(allowed=out)

    rows = events.select(F.col(client).cast("long").alias("client"), F.col(event).cast("long").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.repartition("client").sortWithinPartitions("client", "ts", "event_id").mapInPandas(run, ALLOWED)


def limited_stream(events: DataFrame, limit: int, seconds: float = 60.0, client: str = "user_id", event: str = "event_id", ts: str = "ts", lateness: float = 0.0) -> DataFrame:
    """The limiter over a stream, with the times of allowed hits as each client's state: at most `limit` numbers, dropped once the watermark (`lateness` seconds behind) has passed the last of them by `seconds`."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for t in rows["ts"]:
            times, ok = _decide(times, t.timestamp(), limit, seconds)
            out.append(ok)
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(int((max(times) + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(client=key[0], allowed=out)[["client", "event_id", "ts", "allowed"]]

    rows = events.select(F.col(client).cast("long").alias("client"), F.col(event).cast("long").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", f"{lateness} seconds")
    return rows.groupBy("client").applyInPandasWithState(run, ALLOWED, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def append_log(stream: DataFrame, folder: str, checkpoint: str):
    """An append-only log: each micro-batch's rows as JSON files."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refreshed(base: DataFrame, overlay_stream: DataFrame, use, checkpoint: str):
    """Calls `use` with base and overlay merged, for each micro-batch of the overlay."""

    def merge(batch: DataFrame, epoch: int) -> None:
        use(base.withColumn("source", F.lit("base")).unionByName(batch.withColumn("source", F.lit("overlay"))), epoch)

    return overlay_stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
