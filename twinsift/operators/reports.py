"""Reports over files, groups, runs and calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift import schema
from twinsift.functions import kernels
from twinsift.operators import actions


def file_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("media_type", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n"))


def status_matrix(files: DataFrame) -> DataFrame:
    """A row for each media type and a column for each status, 0 where there is none."""
    spark = files.sparkSession
    rows = spark.createDataFrame([(m,) for m in schema.MEDIA_TYPES], "media_type string")
    pivot = files.groupBy("media_type").pivot("status", list(schema.STATUSES)).count()
    return rows.join(pivot, "media_type", "left").na.fill(0, list(schema.STATUSES))


def source_counts(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Every source with its files by status."""
    counts = files.groupBy("source_id").agg(F.count("*").alias("files"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in schema.STATUSES])
    return sources.select("id", "name", "priority").join(counts.withColumnRenamed("source_id", "id"), "id", "left").na.fill(0, ["files", *schema.STATUSES])


def listed_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    out = sources.filter("enabled") if enabled_only else sources
    return out.orderBy(F.col("priority").desc(), F.col("name").asc())


def group_stats(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups and members by media and match type; groups without members count."""
    held = members.groupBy("group_id").agg(F.count("*").alias("held"))
    rows = groups.join(held.withColumnRenamed("group_id", "id"), "id", "left")
    return rows.groupBy("media_type", "match_type").agg(F.countDistinct("id").alias("groups"), F.coalesce(F.sum("held"), F.lit(0)).alias("members"))


def wasted_space(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of all members but the keeper; a group without keeper wastes all of it."""
    each = actions.joined(groups, members, files).groupBy("group_id", "media_type").agg(F.sum("size").alias("total"), F.max(F.when(F.col("is_keeper"), F.col("size"))).alias("kept"))
    return each.groupBy("media_type").agg(F.sum(F.col("total") - F.coalesce("kept", F.lit(0))).alias("wasted"))


_SORTS = ("reclaimable", "size", "similarity", "members", "id")


def group_list(groups: DataFrame, members: DataFrame, files: DataFrame, sort: str = "reclaimable", order: str = "desc", page: int = 1, per_page: int = 50, media_type: str | None = None, match_type: str | None = None, reviewed: str | None = None) -> DataFrame:
    """One page of groups with their sizes. An unknown sort is by reclaimable bytes, an unknown filter
    doesn't filter; pages start at 1 and hold 1 to 200 groups; nulls come last, ties by id."""
    if media_type in schema.MEDIA_TYPES:
        groups = groups.filter(F.col("media_type") == media_type)
    if match_type in ("exact", "perceptual", "chromaprint"):
        groups = groups.filter(F.col("match_type") == match_type)
    if reviewed in ("yes", "no"):
        groups = groups.filter(F.col("reviewed") == (reviewed == "yes"))
    keys = ("group_id", "media_type", "match_type", "similarity", "reviewed")
    rows = actions.joined(groups, members, files).groupBy(*keys).agg(F.count("*").alias("n_members"), F.sum("size").alias("total_size"), F.max(F.when(F.col("is_keeper"), F.col("size"))).alias("keeper_size"))
    rows = rows.withColumn("reclaimable", F.col("total_size") - F.coalesce("keeper_size", F.lit(0)))
    by = {"size": "total_size", "members": "n_members", "id": "group_id", "similarity": "similarity"}.get(sort if sort in _SORTS else "", "reclaimable")
    by = F.col(by).asc_nulls_last() if order == "asc" else F.col(by).desc_nulls_last()
    per_page, page = max(1, min(200, per_page)), max(1, page)
    return rows.orderBy(by, "group_id").offset((page - 1) * per_page).limit(per_page)


def group_detail(group_id: int, members: DataFrame, files: DataFrame) -> DataFrame:
    own = members.filter(F.col("group_id") == group_id).join(files, F.col("file_id") == F.col("id"))
    return own.select("file_id", "path", "size", "is_keeper", "action").orderBy(F.col("is_keeper").desc(), F.col("size").desc(), "file_id")


def in_flight(files: DataFrame, now: Column) -> DataFrame:
    took = F.floor((F.unix_micros(now) - F.unix_micros("processing_started_at")) / 1_000_000).cast("bigint")
    out = files.filter("status = 'processing'").orderBy(F.col("processing_started_at").asc_nulls_last(), "id")
    return out.select("id", kernels.basename("path").alias("name"), "media_type", "size", took.alias("elapsed_s"))


def recent_done(files: DataFrame, n: int = 10) -> DataFrame:
    took = F.round((F.unix_micros("fingerprinted_at") - F.unix_micros("processing_started_at")) / 1_000_000, 1)
    out = files.filter("status = 'done' and fingerprinted_at is not null").orderBy(F.col("fingerprinted_at").desc(), "id").limit(n)
    return out.select("id", kernels.basename("path").alias("name"), "media_type", "size", took.alias("took_s"))


def recent_failed(files: DataFrame, n: int = 5, most: int = 200) -> DataFrame:
    out = files.filter("status = 'failed'").orderBy(F.col("id").desc()).limit(n)
    return out.select("id", kernels.basename("path").alias("name"), "media_type", kernels.first_line("error", most).alias("error"))


def throughput(done: DataFrame, now: Column, at: str = "fingerprinted_at", size: str = "size", minutes: int = 5) -> DataFrame:
    """Files and bytes of the last minutes, per minute and second."""
    last = done.filter(F.col(at) >= now - F.make_dt_interval(mins=F.lit(minutes))).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return last.select("files", "bytes", F.round(F.col("files") / float(minutes), 1).alias("files_per_min"), F.round(F.col("bytes") / 1048576.0 / (60.0 * minutes), 1).alias("mb_per_sec"))


def recent_runs(runs: DataFrame, n: int = 20, kind: str | None = None) -> DataFrame:
    out = runs if kind is None else runs.filter(F.col("kind") == kind)
    return out.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)


def recent_calls(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(max(1, min(100, n)))


def calls_since(log: DataFrame, start: Column) -> DataFrame:
    return log.filter(F.col("created_at") >= start).agg(F.count("*").alias("calls"), F.avg("elapsed_ms").alias("avg_ms"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("files"))


def _one_row(*counts: DataFrame) -> DataFrame:
    """One-row frames of counts side by side, without a join."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def landed(groups: DataFrame, members: DataFrame, match_type: str = "llm") -> DataFrame:
    own = groups.filter(F.col("match_type") == match_type)
    held = members.join(own.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    return _one_row(own.agg(F.count("*").alias("groups")), held.agg(F.count("*").alias("members")))


def distance_histogram(counts: DataFrame) -> DataFrame:
    """(distance, n) with running totals; at most 65 rows meet in the window."""
    return counts.withColumn("cumulative", F.sum("n").over(Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)))


def closest_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    return pairs.orderBy("score", "a", "b").limit(n)


def coverage(files: DataFrame) -> DataFrame:
    video = (F.col("media_type") == "video") & (F.col("status") == "done") & (F.size("phashes") > 0)
    audio = (F.col("media_type") == "audio") & F.col("chromaprint").isNotNull()
    return files.agg(F.count(F.when(video, 1)).alias("videos_hashed"), F.count(F.when(audio, 1)).alias("audio_fingerprinted"), F.count("*").alias("files"))


def match_stats(groups: DataFrame, members: DataFrame, candidates: DataFrame) -> DataFrame:
    """What a name pass reports: candidates, groups by key and by tokens, members."""
    g = groups.agg(F.count(F.when(F.col("notes") == "resolution_only", 1)).alias("exact_key_groups"), F.count(F.when(F.col("notes") == "name_differs", 1)).alias("token_set_groups"))
    return _one_row(candidates.agg(F.count("*").alias("candidates")), g, members.agg(F.count("*").alias("members")))


def note_buckets(groups: DataFrame, members: DataFrame, files: DataFrame, by: Sequence[str] = ("note",)) -> DataFrame:
    """The preview of groups by name, by their notes."""
    own = actions.selected(groups, ["filename"]).withColumn("notes", F.coalesce("notes", F.lit("unknown")))
    rows = actions.joined(own, members, files).withColumnRenamed("notes", "note")
    each = rows.groupBy("group_id", *by).agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max("size").alias("largest"))
    return each.groupBy(*by).agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("files_to_delete"), F.sum(F.col("total") - F.col("largest")).alias("bytes_to_free"))
