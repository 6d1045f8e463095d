"""Groups that a model proposes: buckets and batches to ask about, and what is accepted of the answers.

The model is a provider outside: it gets a prompt a batch and returns text. Batches don't overlap,
so components stay within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift import schema
from twinsift.functions import kernels
from twinsift.functions.images import balanced_column
from twinsift.operators import keepers
from twinsift.operators.graph import connected_components

BATCH, MIN_BUCKET, CONFIDENCE, RATIO, MOST = 30, 2, 0.80, 0.50, 8


def bucket_key(path: Column | str, by: str = "parent_dir") -> Column:
    parent = kernels.dirname(path)
    if by == "all":
        return F.lit("_all_")
    key = kernels.dirname(parent) if by == "grandparent_dir" else parent
    return F.when(key == "", "/").otherwise(key)


def ungrouped(files: DataFrame, members: DataFrame, media_type: str = "video") -> DataFrame:
    """Files to ask about: of the media type, live, in no group of any kind."""
    live = files.filter((F.col("media_type") == media_type) & F.col("status").isin("done", "pending", "processing"))
    return live.join(members.select(F.col("file_id").alias("id")), "id", "left_anti")


def batches(files: DataFrame, by: str = "parent_dir", batch: int = BATCH, least: int = MIN_BUCKET, most_buckets: int | None = None) -> DataFrame:
    """id, bucket, batch, pos (from 1), batch_size. Files stand by path, then id; the largest buckets go
    first. All are asked about, unless ``most_buckets`` bounds the calls of a run (ties by name)."""
    rows = files.select("id", "path", bucket_key("path", by).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("held")).filter(F.col("held") >= least)
    sizes = sizes if most_buckets is None else sizes.orderBy(F.col("held").desc(), "bucket").limit(most_buckets)
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("path", "id"))
    rows = rows.join(sizes, "bucket").withColumn("at", at - 1)
    number = F.floor(F.col("at") / batch)
    return rows.select("id", "path", "bucket", number.alias("batch"), (F.col("at") % batch + 1).cast("bigint").alias("pos"), F.least(F.lit(batch), F.col("held") - number * batch).alias("batch_size"))


def prompts(rows: DataFrame) -> DataFrame:
    """bucket, batch, n_files, listing: numbered base names."""
    lines = F.sort_array(F.collect_list(F.struct("pos", kernels.basename("path").alias("name"))))
    out = rows.groupBy("bucket", "batch").agg(lines.alias("l"), F.count("*").alias("n_files"))
    return out.select("bucket", "batch", "n_files", F.array_join(F.transform("l", lambda x: F.concat(x["pos"].cast("string"), F.lit(". "), x["name"])), "\n").alias("listing"))


def json_text(text: Column | str) -> Column:
    """The JSON in a model's answer, or null: without comment lines, thoughts and fences; braces that
    balance if there is more around."""
    x = F.regexp_replace(kernels._col(text), r"(?m)^[ \t]*#.*(?:\r?\n|$)", "")
    x = F.regexp_replace(x, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"```(?:json)?\s*", ""), r"```\s*$", "")
    return balanced_column(x)


def parsed(text: Column | str) -> Column:
    return F.from_json(json_text(text), schema.PROPOSALS)


def outcomes(log: DataFrame) -> DataFrame:
    """Per call: state (ok, errored, empty, unparseable), groups of two or more, their members."""
    error = F.coalesce("error", F.lit("")) != ""
    p = F.from_json(F.col("body"), schema.PROPOSALS)["groups"]
    real = F.filter("p", lambda g: F.size(g["members"]) >= 2)
    out = log.withColumn("body", json_text("response")).withColumn("p", p)
    state = F.when(error, "errored").when(F.trim(F.coalesce("response", F.lit(""))) == "", "empty").when(F.col("p").isNull(), "unparseable").otherwise("ok")
    ok = F.col("state") == "ok"
    count = F.aggregate(real, F.lit(0), lambda s, g: s + F.size(g["members"]))
    return out.withColumn("state", state).select("id", "state", F.when(ok, F.size(real)).alias("groups_found"), F.when(ok, count).alias("members_found"))


def accepted(proposals: DataFrame, rows: DataFrame, confidence: float = CONFIDENCE, ratio: float = RATIO, most: int = MOST) -> DataFrame:
    """bucket, batch, proposal, confidence, id for proposals that pass.

    proposals: bucket, batch, proposal (number), members (positions as strings), confidence. Repeated
    members count towards the length; positions out of range or no numbers are left out, and two must
    remain.
    """
    sizes = rows.groupBy("bucket", "batch").agg(F.first("batch_size").alias("batch_size"))
    held = F.size("members")
    sane = (F.coalesce("confidence", F.lit(0.0)) >= confidence) & (held >= 2) & (held <= F.col("batch_size") * ratio) & (held <= most)
    good = proposals.join(sizes, ["bucket", "batch"]).filter(sane)
    named = good.select("bucket", "batch", "proposal", "confidence", F.posexplode("members").alias("nth", "m"))
    named = named.withColumn("pos", F.when(F.col("m").rlike(r"^\s*[0-9]+\s*$"), F.trim("m").cast("bigint")))
    ids = named.join(rows.select("bucket", "batch", "pos", "id"), ["bucket", "batch", "pos"])
    two = ids.groupBy("bucket", "batch", "proposal").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return ids.join(two, ["bucket", "batch", "proposal"], "left_semi").select("bucket", "batch", "proposal", "confidence", "nth", "id")


def proposal_clusters(taken: DataFrame, files: DataFrame, media_type: str = "video") -> DataFrame:
    """Components of accepted proposals; similarity is the largest confidence among them."""
    first = taken.groupBy("bucket", "batch", "proposal").agg(F.min_by("id", "nth").alias("a"), F.max("confidence").alias("confidence"))
    edges = taken.join(first.drop("confidence"), ["bucket", "batch", "proposal"]).select("a", F.col("id").alias("b")).filter("a <> b")
    at = connected_components(edges, "a", "b")
    conf = first.join(at.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.max("confidence").alias("similarity"))
    rows = at.withColumnRenamed("node", "id").join(files, "id")
    best = rows.groupBy("component").agg(keepers.keeper("llm").alias("keeper")).join(conf, "component")
    out = rows.select("component", "id").join(best, "component")
    return out.select(F.lit(media_type).alias("media_type"), F.col("component").alias("group_id"), "id", "similarity", "keeper")
