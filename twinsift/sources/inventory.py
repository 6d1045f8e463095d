"""Where files come from: directory trees, and the metadata that a prober printed as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift import schema
from twinsift.functions import names


def listing(spark: SparkSession, root: str, media_type: str = "both") -> DataFrame:
    """path, size, mtime, media_type of the media files below ``root``.

    Hidden files and folders, other extensions and empty files are left out. Content isn't read: the
    scan's only columns are path, length and time.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?/*", "/")
    return media_only(found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")), media_type)


def media_only(found: DataFrame, media_type: str = "both") -> DataFrame:
    """The same for a listing that something else made: path, size, mtime."""
    visible = ~F.col("path").rlike(r"/\.[^/]")
    media = names.extension("path").isin(*names.extensions_for(media_type))
    return found.filter(visible & media & (F.col("size") > 0)).withColumn("media_type", names.media_type_of("path"))


_STREAM = schema.table_of("codec_type string, codec_name string, width string, height string, sample_rate string, channels string, bit_rate string")
_PROBE = T.StructType([T.StructField("streams", T.ArrayType(_STREAM)), T.StructField("format", schema.table_of("duration string, bit_rate string"))])


def media_info(probe: Column) -> Column:
    """A prober's JSON as a struct of ``schema.MEDIA_INFO``: the first video and the first audio stream;
    numbers that aren't any are null, as is a duration of 0."""
    p = F.from_json(probe, _PROBE)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = first("video"), first("audio")
    whole = lambda c: F.when(c.rlike(r"^[0-9]+$"), c).try_cast("int")
    seconds = p["format"]["duration"].try_cast("double")
    values = {
        "duration": F.when(seconds != 0, seconds), "width": whole(v["width"]), "height": whole(v["height"]), "video_codec": v["codec_name"], "audio_codec": a["codec_name"],
        "bitrate": whole(p["format"]["bit_rate"]), "sample_rate": whole(a["sample_rate"]), "channels": whole(a["channels"]),
    }
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in schema.MEDIA_INFO.fields])


def with_fingerprints(files: DataFrame, decode, column: str = "frames") -> DataFrame:
    """Plug point for a decoder: ``decode`` maps pandas batches of (id, path) to (id, frames), an array of
    32 x 32 grey frames each; the frames are hashed in order."""
    from twinsift.functions.images import phash_column

    frames = files.select("id", "path").mapInPandas(decode, f"id long, {column} array<array<double>>")
    each = frames.select("id", F.posexplode_outer(column).alias("nth", "frame")).withColumn("h", phash_column("frame"))
    hashes = each.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("nth", "h")))).alias("l"))
    return files.drop("phashes").join(hashes.select("id", F.transform("l", lambda x: x["h"]).alias("phashes")), "id", "left")
