"""Telling rows apart, and keeping one row of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key() -> Column:
    """128 bits of doc_id and text. Rows that agree in both are repeated rows."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(named, F.when(F.col("text").isNull(), "-").otherwise("+"), F.coalesce("text", F.lit("")))))


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``decided`` (row, kept; a row for each of ``docs``) doesn't keep,
    and of repeated rows one."""
    keys = decided.groupBy("row").agg(F.max("kept").alias("kept"), F.count("*").alias("m"))
    gone = keys.filter("not kept").select("row")
    columns = docs.columns
    out = docs.withColumn("row", row_key()).join(gone, "row", "left_anti")
    if not keys.filter("kept and m > 1").isEmpty():
        out = out.dropDuplicates(["row"])
    return out.select(*columns)
