"""Periodic runs over a stream: what has arrived is taken in batches, each written once under its number.

A batch that runs again (its writer was lost before the stream's checkpoint knew of it) replaces its own folder and
nothing else, so what is read is as if each batch had run once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def land(path: str, make: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes ``make`` of each batch to its own partition of ``path``."""

    def put(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def take_in(arrivals: DataFrame, path: str, progress: str, make: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Takes in all that has arrived since the last run, and ends. For a scheduler to call at each period; ``progress``
    is the stream's checkpoint folder, which tells one run from the next."""
    return arrivals.writeStream.foreachBatch(land(path, make)).option("checkpointLocation", progress).trigger(availableNow=True).start()


def landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that were taken in, with the number of their ``batch``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by batch, then ``order``; sums have a map-side half, so a hot key is no burden."""
    columns = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("batch", order)).alias("r"))
    return last.select("r.*")
