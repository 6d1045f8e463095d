"""Change capture over inventories: listings against files, lifecycle, sources by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_SHARE = 0.10


def upsert(files: DataFrame, listing: DataFrame, source_id: Column) -> DataFrame:
    """Files after a listing (path, size, mtime, media_type) was taken in, with ``change``.

    new: not known before, pending. changed: size or mtime differ; back to pending without hash and
    fingerprints, with its old source. same: only a null source is filled in. unseen: not listed.
    An unchanged missing or deleted file stays so; duration and picture size stay with changed ones.
    """
    seen = listing.select("path", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime"), F.col("media_type").alias("new_media"), F.lit(True).alias("listed"))
    both = files.withColumn("known", F.lit(True)).join(seen, "path", "full_outer")
    differs = (F.col("size") != F.col("new_size")) | (F.col("mtime") != F.col("new_mtime"))
    change = F.when(F.col("known").isNull(), "new").when(F.col("listed").isNull(), "unseen").when(differs, "changed").otherwise("same")
    both = both.withColumn("change", change)
    fresh = F.col("change").isin("new", "changed")
    reset = ("sha256", "phashes", "chromaprint", "error", "fingerprinted_at")
    filled = {c: F.when(~fresh, F.col(c)) for c in reset if c in files.columns}
    filled |= {
        "size": F.when(fresh, F.col("new_size")).otherwise(F.col("size")),
        "mtime": F.when(fresh, F.col("new_mtime")).otherwise(F.col("mtime")),
        "media_type": F.coalesce("media_type", "new_media"),
        "status": F.when(fresh, "pending").otherwise(F.col("status")),
        "source_id": F.when(F.col("change") == "new", source_id).when(F.col("change") == "same", F.coalesce(F.col("source_id"), source_id)).otherwise(F.col("source_id")),
    }
    if "attempts" in files.columns:
        filled["attempts"] = F.when(fresh, 0).otherwise(F.col("attempts"))
    return both.withColumns(filled).select(*files.columns, "change")


def missing_guard(files: DataFrame, listing: DataFrame, share: float = MISSING_SHARE, in_grace: bool = False, root_empty: bool = False) -> DataFrame:
    """live, missing, share and allowed: whether files not listed may be marked missing.

    Live files are neither missing nor deleted. Nothing is allowed within the grace after start-up, when
    the root is empty, or above the share (exactly the share still is)."""
    live = files.filter(~F.col("status").isin("missing", "deleted")).select("path")
    seen = listing.select("path").distinct().withColumn("listed", F.lit(1))
    n = live.join(seen, "path", "left").agg(F.count("*").alias("live"), F.count(F.when(F.col("listed").isNull(), 1)).alias("missing"))
    part = F.when(F.col("live") > 0, F.col("missing") / F.col("live")).otherwise(F.lit(0.0))
    return n.withColumn("share", part).withColumn("allowed", (F.col("share") <= share) & F.lit(not (in_grace or root_empty)))


def mark_missing(files: DataFrame, listing: DataFrame, **guard) -> DataFrame:
    """``files`` with unlisted live ones missing, if the guard allows it; the guard is one row."""
    allowed = missing_guard(files, listing, **guard).first()["allowed"]
    if not allowed:
        return files
    seen = listing.select("path").distinct().withColumn("listed", F.lit(True))
    gone = F.col("listed").isNull() & ~F.col("status").isin("missing", "deleted")
    return files.join(seen, "path", "left").withColumn("status", F.when(gone, "missing").otherwise(F.col("status"))).select(*files.columns)


def resolve_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``files`` with source_id and source_path of the source whose path is the longest prefix, at a
    path boundary; null if none. A root source ``/`` holds every path.

    Each path's own prefixes (as many as it has parts) meet the sources by equality, so there is no
    join by comparison; sources that share a path resolve to the smallest id.
    """
    s = sources.select(F.regexp_replace("path", "/+$", "").alias("prefix"), F.col("id").alias("found")).groupBy("prefix").agg(F.min("found").alias("found"))
    paths = files.select("path").distinct()
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    prefixes = paths.withColumn("parts", parts).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice(F.col("parts"), F.lit(1), n), "/"))).alias("prefix"))
    best = prefixes.join(s, "prefix").groupBy("path").agg(F.max_by(F.struct("found", "prefix"), F.length("prefix")).alias("best"))
    return files.drop("source_id").join(best, "path", "left").withColumns({"source_id": F.col("best.found"), "source_path": F.col("best.prefix")}).drop("best")


def backfill_sources(files: DataFrame, sources: DataFrame, only_null: bool = True) -> DataFrame:
    found = resolve_sources(files.withColumnRenamed("source_id", "old_id"), sources)
    source = F.coalesce("old_id", "source_id") if only_null else F.coalesce("source_id", "old_id")
    return found.withColumn("source_id", source).drop("old_id", "source_path").select(*files.columns)


def claim(files: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Pending and failed files of ``ids`` start processing; others stay."""
    asked = ids.select("id").distinct().withColumn("asked", F.lit(True))
    take = F.coalesce("asked", F.lit(False)) & F.col("status").isin("pending", "failed")
    return files.join(asked, "id", "left").withColumns({"attempts": F.when(take, F.col("attempts") + 1).otherwise(F.col("attempts")), "processing_started_at": F.when(take, now).otherwise(F.col("processing_started_at")), "status": F.when(take, "processing").otherwise(F.col("status"))}).select(*files.columns)


def finish(files: DataFrame, results: DataFrame) -> DataFrame:
    """``results``: id, outcome (done, failed, missing), error, at. Errors are cut at 2000 characters."""
    out = files.join(results.select("id", "outcome", F.substring("error", 1, 2000).alias("why"), "at"), "id", "left")
    ended = F.col("outcome").isNotNull()
    done = F.col("outcome") == "done"
    return out.withColumns({"status": F.coalesce("outcome", "status"), "error": F.when(ended, F.when(done, F.lit(None)).otherwise(F.col("why"))).otherwise(F.col("error")), "fingerprinted_at": F.when(done, F.col("at")).otherwise(F.col("fingerprinted_at"))}).select(*files.columns)


def reap(files: DataFrame, now: Column, seconds: int = 1800) -> DataFrame:
    """Files in processing for over ``seconds`` are pending again, with a line added to their error.
    Those without a start are never reaped."""
    stuck = (F.col("status") == "processing") & (F.col("processing_started_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    stuck = F.coalesce(stuck, F.lit(False))
    note = F.concat_ws("\n", F.nullif("error", F.lit("")), F.lit(f"requeued: processing for more than {seconds} s"))
    return files.withColumns({"error": F.when(stuck, note).otherwise(F.col("error")), "processing_started_at": F.when(~stuck, F.col("processing_started_at")), "status": F.when(stuck, "pending").otherwise(F.col("status"))})


def latest(settings: DataFrame, order: str = "updated_at") -> DataFrame:
    """Last value of each key."""
    return settings.groupBy("key").agg(F.max_by("value", order).alias("value"), F.max("updated_at").alias("updated_at"))


def with_prefix(settings: DataFrame, prefix: str) -> DataFrame:
    """Settings whose key begins with ``prefix``, taken literally."""
    return settings.filter(F.col("key").startswith(prefix))


def fold_status(events: DataFrame) -> DataFrame:
    """State of each file from its log (file_id, seq, status): last status, and how often it was claimed."""
    return events.groupBy("file_id").agg(F.max_by("status", "seq").alias("status"), F.count(F.when(F.col("status") == "processing", 1)).alias("attempts"))


def work_queue(files: DataFrame) -> DataFrame:
    """Pending files with their job names, largest first."""
    return files.filter("status = 'pending'").select("id", F.concat(F.lit("file-"), F.col("id").cast("string")).alias("job"), "size").orderBy(F.col("size").desc(), "id")
