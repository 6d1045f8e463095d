"""Logical tables. Every operator takes and returns frames with these columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEDIA_TYPES = ("video", "audio")
STATUSES = ("pending", "processing", "done", "failed", "missing", "deleted")
MATCH_TYPES = ("exact", "perceptual", "chromaprint", "filename", "llm")
ACTIONS = ("keep", "delete", "ignore")


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<bigint>": T.ArrayType(T.LongType()),
}


def table_of(columns: str) -> T.StructType:
    """``name type [not null]`` by commas; needs no session."""
    fields = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], f[2:] != ["not", "null"]) for f in fields])


FILES = table_of(
    "id bigint not null, path string not null, media_type string not null, size bigint not null, mtime timestamp, sha256 string, "
    "duration double, width int, height int, video_codec string, audio_codec string, bitrate int, sample_rate int, channels int, "
    "phashes array<bigint>, chromaprint string, chromaprint_dur double, discovered_at timestamp, processing_started_at timestamp, "
    "fingerprinted_at timestamp, status string not null, error string, attempts int not null, source_id bigint"
)
SOURCES = table_of("id bigint not null, name string not null, path string not null, media_type string not null, priority int not null, enabled boolean not null, created_at timestamp, notes string")
GROUPS = table_of("id bigint not null, media_type string not null, match_type string not null, similarity double, created_at timestamp, reviewed boolean not null, notes string")
MEMBERS = table_of("group_id bigint not null, file_id bigint not null, is_keeper boolean not null, action string")
ACTION_LOG = table_of("id bigint, file_id bigint, path string not null, action string not null, succeeded boolean not null, error string, bytes_freed bigint, performed_at timestamp")
RUNS = table_of("id bigint not null, kind string not null, triggered_by string not null, started_at timestamp not null, finished_at timestamp, succeeded boolean, error string, stats string")
SETTINGS = table_of("key string not null, value string, updated_at timestamp not null")
PROPOSAL_LOG = table_of("id bigint not null, created_at timestamp not null, model string, bucket_key string, n_files int, prompt string, response string, error string, elapsed_ms int")
PROPOSALS = T.StructType(
    [T.StructField("groups", T.ArrayType(T.StructType([T.StructField("members", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType())])))]
)
MEDIA_INFO = table_of("duration double, width int, height int, video_codec string, audio_codec string, bitrate int, sample_rate int, channels int")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order; those that ``df`` lacks are null. Others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def violations(df: DataFrame, schema: T.StructType, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows that break a not-null column or an enumeration, with the names of what they break."""
    bad = [F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable and f.name in df.columns]
    bad += [F.when(~F.col(c).isin(*values), F.lit(c)) for c, values in (allowed or {}).items()]
    return df.withColumn("broken", F.array_compact(F.array(*bad))).filter(F.size("broken") > 0)
