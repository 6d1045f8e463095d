"""The table of sources: create, update, delete, look up. Each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDITABLE = ("name", "path", "media_type", "priority", "enabled", "notes")


def _trimmed(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def by_id(sources: DataFrame, source_id: int) -> DataFrame:
    return sources.filter(F.col("id") == source_id)


def by_name(sources: DataFrame, name: str) -> DataFrame:
    return sources.filter(F.col("name") == name)


def create(sources: DataFrame, **values) -> DataFrame:
    """A new source with the next id; a trailing slash of the path goes. Name and path must be new."""
    taken = sources.filter((F.col("name") == values["name"]) | (F.col("path") == values["path"].rstrip("/")))
    if not taken.isEmpty():
        raise ValueError("a source has this name or path")
    defaults = {"priority": 0, "enabled": True, "media_type": "both"}
    new = sources.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    given = defaults | values | {"path": values["path"].rstrip("/")}
    return sources.unionByName(new.select("id", *[F.lit(given.get(c)).cast(sources.schema[c].dataType).alias(c) for c in sources.columns if c != "id"]))


def update(sources: DataFrame, source_id: int, **values) -> DataFrame:
    """Fields that are given change; None leaves a field as it is, so none can be cleared."""
    own = F.col("id") == source_id
    set_ = {c: v for c, v in values.items() if v is not None and c in EDITABLE}
    if "path" in set_:
        set_["path"] = set_["path"].rstrip("/")
    return sources.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in set_.items()}) if set_ else sources


def delete(sources: DataFrame, files: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame]:
    """The tables without the source; its files have none any more."""
    left = files.withColumn("source_id", F.when(~F.coalesce(F.col("source_id") == source_id, F.lit(False)), F.col("source_id")))
    return sources.filter(F.col("id") != source_id), left


def usable(sources: DataFrame, folders: DataFrame) -> DataFrame:
    """Enabled sources whose path is among ``folders`` (path), which the caller has listed."""
    return sources.filter("enabled").join(folders.select(_trimmed(F.col("path")).alias("path")).distinct(), "path", "left_semi")
