"""Streams: arrivals without repeats, throughput by window, and the state of each file with a watchdog."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STUCK_SECONDS = 1800


def jobs(arrivals: DataFrame, late: str = "1 hour") -> DataFrame:
    """One job per file within the watermark, however often it is listed. arrivals: id, ts."""
    named = arrivals.withColumn("job", F.concat(F.lit("file-"), F.col("id").cast("string")))
    return named.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job"])


def throughput(done: DataFrame, late: str = "10 minutes", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Files and bytes by sliding window. done: ts, size."""
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    out = done.withWatermark("ts", late).groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "files", "bytes", F.round(F.col("bytes") / 1048576.0 / seconds, 3).alias("mb_per_sec"))


def lifecycle(events: DataFrame, stuck_seconds: int = STUCK_SECONDS, late: str = "0 seconds") -> DataFrame:
    """State changes of each file: file_id, status, attempts, reason.

    events: file_id, ts, event (claim, done, failed, missing). Only pending or failed files can be
    claimed; a file in processing that stays silent for ``stuck_seconds`` of event time is pending again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("pending", 0)
        out = []
        if state.hasTimedOut:
            if status == "processing":
                status = "pending"
                out.append((key[0], status, attempts, "stuck"))
            state.update((status, attempts))
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event"])
            for ts, event in zip(rows["ts"], rows["event"], strict=True):
                if event == "claim":
                    if status not in ("pending", "failed"):
                        continue
                    status, attempts = "processing", attempts + 1
                else:
                    status = event
                out.append((key[0], status, attempts, event))
            state.update((status, attempts))
            if status == "processing":
                due = int(ts.timestamp() * 1000) + stuck_seconds * 1000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["file_id", "status", "attempts", "reason"])

    return events.withWatermark("ts", late).groupBy("file_id").applyInPandasWithState(
        step, "file_id long, status string, attempts int, reason string", "status string, attempts int", "append", GroupStateTimeout.EventTimeTimeout
    )
