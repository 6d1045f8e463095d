"""Where results go: Parquet tables rebuilt by partition, and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuild(groups: DataFrame, path: str) -> None:
    """Replace the groups of the (match_type, media_type) that ``groups`` holds, and no others."""
    groups.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_type", "media_type").parquet(path)


def replace_all(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def action_log(results: DataFrame, now) -> DataFrame:
    """Log rows of executed moves: file_id, path, outcome (moved, missing, mkdir_failed, move_failed), size, error."""
    moved = F.col("outcome") == "moved"
    return results.select(
        "file_id",
        "path",
        F.when(F.col("outcome") == "missing", "missing").otherwise("delete").alias("action"),
        moved.alias("succeeded"),
        F.when(~moved & (F.col("outcome") != "missing"), F.concat_ws(": ", "outcome", "error")).alias("error"),
        F.when(moved, F.col("size")).otherwise(0).alias("bytes_freed"),
        now.alias("performed_at"),
    )


def run_log(kind: str, stats: DataFrame, error: str | None = None) -> DataFrame:
    """One finished run with its statistics as JSON; the error is cut at 2000 characters."""
    return stats.limit(1).select(F.lit(kind).alias("kind"), F.lit(error is None).alias("succeeded"), F.lit(error[:2000] if error else None).cast("string").alias("error"), F.to_json(F.struct("*")).alias("stats"))


def call_log(calls: DataFrame, most: int = 50_000) -> DataFrame:
    return calls.withColumns({c: F.substring(c, 1, most) for c in ("prompt", "response")})
