"""Which member of a group stays. Five rules; each is a struct whose largest value wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.names import resolution_rank


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint")


def _pixels() -> Column:
    return _n("width") * _n("height")


def oldest() -> Column:
    """Exact groups when matched: the lowest id."""
    return F.struct(-F.col("id"))


def perceptual() -> Column:
    return F.struct(F.col("size"), F.length("path"), -F.col("id"))


def acoustic() -> Column:
    return F.struct(_n("bitrate"), F.col("size"), -F.col("id"))


def filename() -> Column:
    return F.struct(F.coalesce("priority", F.lit(-1)), resolution_rank("path"), _pixels(), _n("bitrate"), F.col("size"), -F.col("id"))


def proposed() -> Column:
    return F.struct(F.coalesce("priority", F.lit(-1)), _pixels(), _n("bitrate"), F.col("size"), -F.col("id"))


MATCH_RULES = {"exact": oldest, "perceptual": perceptual, "chromaprint": acoustic, "filename": filename, "llm": proposed}


def keeper(rule: str) -> Column:
    """Aggregate: the id of the best row of a group."""
    return F.max_by("id", MATCH_RULES[rule]())


def _marking_order() -> Column:
    """The order for marking: source priority first, then by the kind of match; an unknown kind goes as exact."""
    kind = F.col("match_type")
    area = F.when(kind.isin("perceptual", "filename", "llm"), _pixels())
    path = F.when(kind.isin("perceptual", "filename", "llm", "chromaprint"), F.lit(0)).otherwise(F.length("path"))
    rate = F.when(kind.isin("perceptual", "filename", "llm", "chromaprint"), _n("bitrate")).otherwise(F.lit(0))
    return F.struct(F.coalesce("priority", F.lit(-1)), path, F.coalesce(area, F.lit(0)), rate, F.col("size"), -F.col("id"))


def auto_mark(members: DataFrame) -> DataFrame:
    """Marks keepers anew. members: group_id, match_type, id, path, size, width, height, bitrate, priority.

    Returns group_id, file_id, is_keeper and action (keep or delete). Groups of fewer than two are left
    out. The best row comes from an aggregate with a map-side half, so a large group needs no sort.
    """
    best = members.groupBy("group_id").agg(F.max_by("id", _marking_order()).alias("best"), F.count("*").alias("held")).filter("held > 1")
    out = members.join(best, "group_id").withColumn("is_keeper", F.col("id") == F.col("best"))
    return out.select("group_id", F.col("id").alias("file_id"), "is_keeper", F.when(F.col("is_keeper"), "keep").otherwise("delete").alias("action"))


def auto_mark_ranked(members: DataFrame) -> DataFrame:
    """All members in marking order: group_id, file_id, rank."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(_marking_order().desc()))
    return members.select("group_id", F.col("id").alias("file_id"), rank.alias("rank"))
