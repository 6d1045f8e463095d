"""What to do with groups: effective actions, previews, plans. Nothing here touches a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import kernels
from twinsift.operators import changes, keepers

AUTO_RANGE = (0.70, 1.0)


def effective_action() -> Column:
    """An action given by hand, else keep for the keeper and delete for the others."""
    return F.coalesce("action", F.when(F.col("is_keeper"), "keep").otherwise("delete"))


def selected(groups: DataFrame, match_types: Sequence[str] | None = None, media_type: str | None = None, min_similarity: float | None = None) -> DataFrame:
    """Groups not yet reviewed that fit; an unknown media type doesn't filter, a null similarity fits no bound."""
    out = groups.filter("not reviewed")
    if match_types:
        out = out.filter(F.col("match_type").isin(*match_types))
    if media_type in ("video", "audio"):
        out = out.filter(F.col("media_type") == media_type)
    return out if min_similarity is None else out.filter(F.col("similarity") >= min_similarity)


def checked_similarity(value: float) -> float:
    low, high = AUTO_RANGE
    if not low <= value <= high:
        raise ValueError(f"similarity must be from {low} to {high}")
    return value


def joined(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Groups with their members' files."""
    g = groups.select(F.col("id").alias("group_id"), "media_type", "match_type", "similarity", "reviewed", "notes")
    return members.join(g, "group_id").join(files.drop("media_type"), F.col("file_id") == F.col("id"))


def preview(groups: DataFrame, members: DataFrame, files: DataFrame, by: Sequence[str] = ("media_type", "match_type")) -> DataFrame:
    """Groups, files to delete (all but one) and bytes to free (all but the largest file)."""
    each = joined(groups, members, files).groupBy("group_id", *by).agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max("size").alias("largest"), F.first("similarity").alias("similarity"))
    return each.groupBy(*by).agg(
        F.count("*").alias("groups"),
        F.sum(F.col("n") - 1).alias("files_to_delete"),
        F.sum(F.col("total") - F.col("largest")).alias("bytes_to_free"),
        F.avg("similarity").alias("avg_similarity"),
    )


def with_total(summary: DataFrame) -> DataFrame:
    """A preview and its total row."""
    total = summary.agg(F.lit("TOTAL").alias("media_type"), F.lit("").alias("match_type"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("groups", "files_to_delete", "bytes_to_free")])
    return summary.select(total.columns).unionByName(total).withColumn("reclaimable", kernels.human_bytes("bytes_to_free"))


def marked(groups: DataFrame, members: DataFrame, files: DataFrame, sources: DataFrame, live_only: bool = False) -> DataFrame:
    """Keepers and actions chosen anew for ``groups``; with ``live_only`` missing and deleted files can't stay."""
    rows = joined(groups, members, files).join(sources.select(F.col("id").alias("source_id"), "priority"), "source_id", "left")
    if live_only:
        rows = rows.filter(~F.col("status").isin("missing", "deleted"))
    return keepers.auto_mark(rows.select("group_id", "match_type", "id", "path", "size", "width", "height", "bitrate", "priority"))


def mark_by_hand(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` (group_id, keeper, actions: map of file id to action) over ``members``.

    The keeper must be a member, or the decision doesn't count. Without an action of its own the keeper
    is kept and the others are deleted.
    """
    valid = decisions.join(members.select("group_id", F.col("file_id").alias("keeper")), ["group_id", "keeper"], "left_semi")
    out = members.join(valid, "group_id", "left")
    own = F.col("actions")[F.col("file_id")]
    now = F.col("file_id") == F.col("keeper")
    action = F.coalesce(own, F.when(now, "keep").otherwise("delete"))
    return out.select("group_id", "file_id", F.coalesce(now, "is_keeper").alias("is_keeper"), F.when(F.col("keeper").isNotNull(), action).otherwise(F.col("action")).alias("action"))


def plan(groups: DataFrame, members: DataFrame, files: DataFrame, roots: DataFrame, day: str) -> DataFrame:
    """Files to move: group_id, file_id, src, dst, bytes_freed, outcome (``move``, or ``missing`` when
    the file is gone). roots: id, path of sources; a file's trash is its source's, found by source_id or
    by the longest path prefix."""
    rows = joined(groups, members, files).withColumn("effective", effective_action()).filter("effective = 'delete' and not is_keeper")
    by_id = rows.join(roots.select(F.col("id").alias("source_id"), F.col("path").alias("own_root")), "source_id", "left")
    by_path = changes.resolve_sources(rows.filter("source_id is null").select("file_id", "path").distinct(), roots)
    out = by_id.join(by_path.select("file_id", F.col("source_path").alias("found_root")), "file_id", "left")
    root = F.coalesce("own_root", "found_root", F.concat(F.lit("/"), F.col("media_type")))
    dst = F.concat(root, F.lit(f"/.trash/{day}/"), F.col("file_id").cast("string"), F.lit("__"), kernels.basename("path"))
    gone = F.col("status").isin("missing", "deleted")
    return out.select("group_id", "file_id", F.col("path").alias("src"), dst.alias("dst"), F.when(gone, 0).otherwise(F.col("size")).alias("bytes_freed"), F.when(gone, "missing").otherwise("move").alias("outcome"))


def summary(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members by effective action with their bytes; only files that aren't keepers are ever deleted."""
    rows = members.join(files.select(F.col("id").alias("file_id"), "size", "media_type"), "file_id").withColumn("effective", effective_action())
    rows = rows.withColumn("deleted", (F.col("effective") == "delete") & ~F.col("is_keeper"))
    return rows.groupBy("media_type", "effective").agg(F.count("*").alias("files"), F.count(F.when(F.col("deleted"), 1)).alias("to_delete"), F.coalesce(F.sum(F.when(F.col("deleted"), F.col("size"))), F.lit(0)).alias("bytes_freed"))


def reviewed(groups: DataFrame, executed: DataFrame) -> DataFrame:
    """Groups after execution: those in ``executed`` (id) are reviewed, whatever became of their files."""
    done = executed.select("id").distinct().withColumn("done", F.lit(True))
    return groups.join(done, "id", "left").withColumn("reviewed", F.col("reviewed") | F.coalesce("done", F.lit(False))).drop("done")


def settle(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files after an action log: moved ones are deleted, and those not found are missing."""
    last = log.groupBy("file_id").agg(F.max_by(F.struct("action", "succeeded"), "performed_at").alias("last"))
    out = files.join(last, F.col("id") == F.col("file_id"), "left")
    status = F.when(F.col("last.action") == "missing", "missing").when((F.col("last.action") == "delete") & F.col("last.succeeded"), "deleted").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("file_id", "last")


def auto_delete(groups: DataFrame, members: DataFrame, files: DataFrame, sources: DataFrame, day: str, match_types: Sequence[str] = ("perceptual", "chromaprint"), media_type: str | None = None, threshold: float | None = None, mark: bool = True) -> tuple[DataFrame, DataFrame]:
    """(plan, groups after it). Exact and similarity runs mark keepers anew; runs by name or proposal
    (``mark=False``) take the keepers that their matcher chose. The threshold must be in AUTO_RANGE."""
    if threshold is not None:
        checked_similarity(threshold)
    chosen = selected(groups, match_types, media_type, threshold)
    rows = marked(chosen, members, files, sources) if mark else members.join(chosen.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    return plan(chosen, rows, files, sources, day), reviewed(groups, chosen.select("id"))


def auto_delete_exact(groups: DataFrame, members: DataFrame, files: DataFrame, sources: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    return auto_delete(groups, members, files, sources, day, ["exact"])
